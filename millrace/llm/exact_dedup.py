"""Exact dedup with a heavy-hitter split.

Texts are equal when they are identical after deleting white space. Only digests move: a Misra-Gries sketch finds
the digests that may be frequent, exact counts verify them, and the few verified winners are broadcast so that rows
of huge groups never meet in one task. All other digests go through an ordinary grouped shuffle.

Everything is DataFrame functions. Defined cases: a null text counts as empty; empty texts form one group like any
other; ties go to the smallest id (null ids last); rows with the same id and text are one document listed twice, and
``drop_copies`` keeps one of them; an empty table gives an empty result; other columns are ignored or passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.functions.storage import stored

from .drops import without
from .names import fresh

WHITE = " \t\n\x0b\x0c\r"
#: A digest held by more than this share of the rows is surely among the sketched ones; 1 / SUPPORT rows are broadcast at most.
SUPPORT = 0.0005


def normalised(text: Column) -> Column:
    """The text without white space; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars (code points of the original text) and the 32-byte digest of the normalised text."""
    text = col(text_col)
    return docs.select(
        col(id_col).alias("id"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"),
        F.unhex(F.sha2(normalised(text), 256)).alias("digest"))


def _winners(rows: DataFrame) -> DataFrame:
    """Per digest the group's size and the row that stays: most code points, then smallest id."""
    first = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), first["id"].alias("keep_id"))


def frequent_digests(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The digests that a Misra-Gries sketch of ``rows`` holds: at most 1 / support, among them all of a larger share.

    The sketch takes hex strings, as its map would tell equal byte arrays apart.
    """
    sketched = rows.select(F.hex("digest").alias("hex")).stat.freqItems(["hex"], support)
    return sketched.select(F.explode("hex_freqItems").alias("hex")).select(F.unhex("hex").alias("digest"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, n_chars, digest, keep_id, group_size."""
    rows = stored(fingerprints(docs, id_col, text_col), "digests")
    frequent = frequent_digests(rows, support)
    heavy = stored(_winners(rows.join(F.broadcast(frequent), "digest", "left_semi")), "heavy-digests")
    heavy = F.broadcast(heavy.filter(F.col("group_size") > 1))  # at most 1 / support rows
    rest = rows.join(heavy, "digest", "left_anti")
    columns = ["id", "n_chars", "digest", "keep_id", "group_size"]
    return (rows.join(heavy, "digest").select(*columns)
            .unionAll(rest.join(_winners(rest), "digest").select(*columns)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (lower-case hex)."""
    return exact_groups(docs, id_col, text_col, support).select(
        F.col("id"), F.col("keep_id"), F.col("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """``docs`` without the rows that lose to an equal text. Ids must tell documents apart."""
    groups = stored(exact_groups(docs, id_col, text_col, support), "exact-groups")
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    out = without(docs, groups.filter(~kept).select("id"), id_col)
    twice = groups.filter(kept).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not twice.isEmpty():  # a document listed more than once
        other = fresh(docs, "_twice")
        twice = stored(twice.select(F.col("id").alias(other)), "listed-twice")
        same = col(id_col).eqNullSafe(F.col(other))
        listed = out.join(twice, same, "left_semi").dropDuplicates([id_col])
        out = out.join(twice, same, "left_anti").unionByName(listed)
    return out
