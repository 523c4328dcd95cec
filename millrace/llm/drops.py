"""Dropping documents by id without moving the documents where the ids are few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.functions.storage import stored

from .names import fresh

#: Ids that are broadcast at most (checked by a count; more are shuffled, with the documents).
BROADCAST_IDS = 1 << 20


def without(docs: DataFrame, lost: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in the one-column table ``lost``; a null id matches a null id."""
    other = fresh(docs, "_lost")
    lost = stored(lost.toDF(other).distinct(), "lost")
    few = lost.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(lost) if few else lost, col(id_col).eqNullSafe(F.col(other)), "left_anti")
