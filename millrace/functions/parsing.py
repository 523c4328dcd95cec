"""Lenient text-to-number and text-to-time parsing; bad text becomes NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col, is_number, is_text, is_time

# Fixed pattern: the texts that count as a number. Spark's own cast would also
# take '1d' and '1.5f', hence the guard in front of it.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"

# Fixed pattern: ISO dates, with or without a time. Spark's cast reads these without
# raising per bad row, unlike format-driven parsing; it would also take a bare year.
ISO_PATTERN = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\S.*)?\s*$"


def text_number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def num_parse(field: T.StructField) -> Column:
    """The column as a double; times become their position on the time line."""
    c, dtype = col(field.name), field.dataType
    if is_text(dtype):
        return text_number(c)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    if is_time(dtype):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    return c.cast("double") if is_number(dtype) else F.lit(None).cast("double")


def time_parse(field: T.StructField, formats: Sequence[str] = ()) -> Column:
    """The column as a zone-free timestamp: ISO text, or text in the first of ``formats``
    that fits. Plain numbers are not read as times."""
    c, dtype = col(field.name), field.dataType
    if is_time(dtype):
        return c.cast("timestamp_ntz")
    if is_text(dtype):
        if not formats:
            return F.when(c.rlike(ISO_PATTERN), F.trim(c).try_cast("timestamp_ntz"))
        return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats])
    return F.lit(None).cast("timestamp_ntz")
