"""Key hashes: a stable pseudo-random order that any engine can reproduce."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col


def key_hash(keys: Sequence[str], digits: int = 15, seed: int | None = None) -> Column:
    """First ``digits`` hex digits of the md5 of the key text, as a bigint.

    15 digits span 0 to 2**60 - 1. A seed is put in front of the key.
    """
    parts = [col(k).cast("string") for k in keys]
    if seed is not None:
        parts = [F.lit(str(seed)), *parts]
    text = parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")
