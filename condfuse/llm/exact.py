"""Exact deduplication with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condfuse.llm.common import SPACE


def squeezed(text: Column) -> Column:
    """The text without any white space of SPACE; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def exact_dedup(docs: DataFrame, content_hash=F.md5) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their squeezed forms are.  Groups form on the 128-bit ``content_hash`` and,
    inside it, on the bytes themselves, so a hash collision splits the group; tasks fold their own
    copies first, so a hot text reaches the shuffle once per task.  Of equal texts the row with the
    most code points in its original text stays, then the one with the smallest ``doc_id`` (null last).
    Rows then find their group by both hashes, without their text.

    A null text counts as empty and empty texts are equal to each other.  Repeated rows count one by
    one in ``group_size``; repeated rows of the kept id are all marked kept, as they carry one id.
    A null ``doc_id`` can only be kept in a group without any id.  An empty table gives no rows;
    other columns of ``docs`` are not read.
    """
    base = docs.select("doc_id", "text").select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_points"), squeezed(F.col("text")).alias("body")
    )
    # bitwise not turns the smallest id into the largest without overflow; null stays the smallest
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("not_id")))
    groups = (
        base.withColumn("h", content_hash("body"))
        .groupBy("h", "body")
        .agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
        .select(F.col("h").alias("g_h"), F.sha2("body", 256).alias("g_sha"), "group_size", F.col("best.n_points").alias("best_points"), F.bitwise_not("best.not_id").alias("keep_id"))
    )
    rows = base.select("doc_id", "n_points", content_hash("body").alias("h"), F.sha2("body", 256).alias("text_sha256"))
    return rows.join(groups, (F.col("h") == F.col("g_h")) & (F.col("text_sha256") == F.col("g_sha"))).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("best_points"))).alias("kept"),
        "text_sha256",
    )
