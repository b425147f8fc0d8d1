"""Helpers shared by the corpus operators: lineage cuts, two-level ranks, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters that separate words, as a Java regular expression class body.
SPACE = " \\x09-\\x0D"
_own_folder: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(value) -> str:
    """The text of a valid Arrow string; bytes that are no UTF-8 become replacement characters."""
    return value.as_buffer().to_pybytes().decode("utf-8", "replace")


def carried(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``row``, so that no column of it can clash with a name of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def released(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns out of ``row`` again, some of them ``changed``."""
    return df.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a session on one machine gets a folder of its own and any other is an error.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise RuntimeError("spark.checkpoint.dir is not set; a cluster needs a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="corpus-"))
    return _own_folder[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    Later jobs start from the files, so a lost executor costs a re-read and not a re-computation,
    and values drawn once (row ids, ranks) stay what they were.
    """
    path = f"{shared_dir(df.sparkSession)}/corpus/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed_rank(df: DataFrame, by: list[str], order: list[Column], spread: Column, *, name: str, per_task: int = 20_000) -> DataFrame:
    """Add ``name``: the 0-based gapless rank of each row within its ``by`` class.

    ``by`` must have few classes (its counts are broadcast); a class may hold any share of the rows.
    It is split into buckets of about ``per_task`` rows, ranges of the 64-bit hash ``spread``; bucket counts
    give the offsets and ``row_number`` runs inside a bucket only.  Rows go by ``spread``, then by the rest of ``order``
    (which must begin with it), whatever the number of buckets.
    ``df`` is read three times, so it should be a written table.
    """
    sizes = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(per_task)).cast("long").alias("_nb"))
    rows = df.join(F.broadcast(sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_nb")), [df[c].eqNullSafe(F.col(f"_by_{c}")) for c in by])
    rows = rows.drop(*[f"_by_{c}" for c in by]).withColumn("_bucket", F.floor((spread.cast("double") / 2.0**64 + 0.5) * F.col("_nb"))).drop("_nb")
    part = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = rows.join(part, [rows[c].eqNullSafe(F.col(f"_by_{c}")) for c in by] + [rows["_bucket"] == F.col("_b")])
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return joined.withColumn(name, F.col("_offset") + inside - 1).drop(*[f"_by_{c}" for c in by], "_b", "_bucket", "_offset")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``, root the smallest node reachable.

    Alternating large-star and small-star steps: each points a node's neighbours at its smallest
    neighbour.  Minima are pre-aggregated before the shuffle, only edges move, and each round is cut to
    a written table.  Nodes without edges do not appear.  The loop ends when a round changes nothing,
    known from two sums over the edges; the number of rounds grows with the logarithm of the diameter.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = state(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        was, seen = seen, state(e)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
