"""The corpus pipeline: language id, line dedup, near-dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written before the next
stage reads it; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from condfuse.llm import langid, linedup, mixing, packing, simhash
from condfuse.llm.common import carried, cut, read_table, released


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; texts that are null or have no letter go.  A document
    without ``lang`` gets the predicted one.  Where no document is labelled there is nothing to predict;
    all texts with a letter then stay as they are."""
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = ("stage held out", "stage language", "stage score")
    found = langid.identify(docs, model, names=names).where(F.col("`stage language`") != langid.UNKNOWN)
    lang = F.coalesce("lang", F.col("`stage language`")).alias("lang")
    return found.select(*[lang if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages of 50 words or more that an earlier one has; ``n_chars`` follows the text."""
    out = linedup.line_dedup(docs, min_words=50)
    if "n_chars" not in docs.columns:
        return out.select(*docs.columns)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that with the smallest id, of several texts under it that with the
    smallest text hash.  A document without id stays only where its whole group has none.  Of rows that
    repeat id and text one stays."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("h"))
    groups = simhash.simhash_groups(docs.select(key.alias("doc_id"), "text"), shingle=3, radius=3)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id.doc_id", F.col("doc_id.h").alias("first_h")).distinct()
    rows = carried(docs).withColumn("id", F.col("row.doc_id")).withColumn("h", F.xxhash64("row.text"))
    kept = rows.join(first, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("first_h")), "left_semi")
    place = F.row_number().over(Window.partitionBy("id", "h").orderBy("h"))  # a task keeps one row of each before the shuffle
    return released(kept.withColumn("place", place).where("place = 1"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, weighted by its quality label."""
    weights = mixing.quality_weights(read_table(spark, sf_dir, "labels"))
    keys = ["doc_id", "source", "text_hash"]
    plan = mixing.mix(docs, weights).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0")
    rows = carried(docs).withColumn("h", F.xxhash64("row.text"))
    found = rows.join(plan, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")) & (F.col("h") == F.col("text_hash")))
    # rows that repeat id, source and text share their copies out evenly
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
    found = found.withColumn("place", place).withColumn("share", (F.floor(F.col("copies") / F.col("n")) + (F.col("place") <= F.col("copies") % F.col("n")).cast("long")).cast("int"))
    return released(found.where("share > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("share")))), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048."""
    return packing.pack(docs, capacity=2048)


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_common_lines),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenisation, alignment and language models have no SQL form; tests/llm has the brute-force check.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
