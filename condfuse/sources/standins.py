"""Stand-in inputs built from the driver's tables.

The protocol's own inputs (a float32 cube file and flag vectors) are not
shipped, so tests and registered queries derive equivalent inputs with Spark
from the given tables; their work grows with those tables.

Stand-in A (``embeddings``): 64 values per vector = 8 configs x 8 measures,
element i is config ``i div 8``, measure ``i mod 8``. Flags: missing where
``vec_id % 37 = 0``; label ``label % 2``, so every row is normal or anomalous.
Days of 50 points, trim below index 8.

Stand-in B (``orders``): 32 configs; the error of measure j, config c is
``((key*(c+7)*(j+3)) % 1009)/1009 + 0.01*bias``, bias = 31-c for status F
(anomalous, label 1) and c otherwise (label 0). No missing points, no day
structure; every order is ranked and tested.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from condfuse._ship import by_value
from condfuse.functions.columns import MEASURES
from condfuse.operators.points import prepare_points
from condfuse.sources.cube import BuiltCube

# Fixed values of the stand-ins (see the module docstring).
A_CONFIGS = 8
A_PER_DAY = 50
A_TRIM = 8
A_MISSING_MOD = 37
B_CONFIGS = 32
B_MOD = 1009
# Orders in one partition of the B stand-ins, at most (on average).
B_TASK_ROWS = 250_000

by_value(__import__(__name__, fromlist=["_"]))


def compute_partitions(spark: SparkSession) -> int:
    """Partition count for compute-heavy stages over narrow inputs: one per
    core of the cluster (the input rows are too narrow for size-based
    partitioning to reflect the work)."""
    from condfuse._ship import has_context

    if has_context(spark):
        return max(1, spark.sparkContext.defaultParallelism)
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- stand-in A

def a_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(global_index, missing, label)`` raw flags (before trim/override)."""
    e = _table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("global_index"),
        F.when(F.col("vec_id") % A_MISSING_MOD == 0, 1).otherwise(0).cast("int").alias("missing"),
        (F.col("label") % 2).cast("int").alias("label"))


def a_cube(spark: SparkSession, sf_dir: str, measures: Sequence[str] = MEASURES) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    nm = len(measures)
    return e.select(F.col("vec_id").alias("global_index"),
                    *[F.array(*[F.element_at("embedding", c * nm + j + 1) for c in range(A_CONFIGS)]).alias(m)
                      for j, m in enumerate(measures)])


def a_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed point table with label override and last-day mask."""
    return prepare_points(a_flags(spark, sf_dir), A_TRIM, per_day=A_PER_DAY)


# ---------------------------------------------------------------- stand-in B

def b_cube_from(orders: DataFrame, measures: Sequence[str] = MEASURES, n_config: int = B_CONFIGS, backwards: bool = False) -> DataFrame:
    """Array-form cube built from (already distributed) orders rows, as a
    ``BuiltCube``: a pass over it joins the narrow rows with its points and builds
    the arrays behind the join.

    Error of measure j, config c: ``((key*(c+7)*(j+3)) % 1009) / 1009`` plus
    ``0.01 * bias`` in double precision, rounded to float32; ``backwards`` puts
    the configs in reverse order. The values are generated per Arrow batch with
    numpy (int64 products, IEEE double division and rounding, so bit-identical
    to the same formula in SQL); an interpreted per-element SQL lambda costs
    far more than the protocol itself once there are hundreds of configs.
    """
    at = {m: j for j, m in enumerate(measures)}

    def gen(batch: pa.RecordBatch, wanted: Sequence[str]) -> list[pa.Array]:
        c = np.arange(n_config, dtype=np.int64)
        c = c[::-1] if backwards else c
        key = pc.fill_null(batch.column("global_index"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        anom = pc.fill_null(pc.equal(batch.column("o_orderstatus"), "F"), False).to_numpy(zero_copy_only=False)
        bias = np.where(anom[:, None], (n_config - 1) - c[None, :], c[None, :]).astype(np.float64)
        offsets = pa.array(np.arange(0, (len(key) + 1) * n_config, n_config, dtype=np.int32))
        cols = []
        for j in [at[m] for m in wanted]:
            frac = ((key[:, None] * (c[None, :] + 7) * (j + 3)) % B_MOD) / float(B_MOD)
            vals = (frac + bias * 0.01).astype(np.float32)
            cols.append(pa.ListArray.from_arrays(offsets, pa.array(vals.reshape(-1))))
        return cols

    rows = orders.select(F.col("o_orderkey").cast("long").alias("global_index"), "o_orderstatus")
    return BuiltCube(rows, gen, n_config, tuple(measures)).frame()


def b_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow orders columns the B stand-ins need, hash-distributed by
    key. Cube, points and scenario points all start from this, so one plan
    shares the exchange and every derived column (array building, fold
    hashing) is computed in parallel even though the source file is a single
    row group. One partition per core, more where that exceeds
    ``B_TASK_ROWS`` rows each: the join with points keeps these partitions and
    holds the points of one in memory."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    parts = max(compute_partitions(spark), -(-o.count() // B_TASK_ROWS))
    return o.repartition(parts, F.col("o_orderkey"))


def b_cube(spark: SparkSession, sf_dir: str, measures: Sequence[str] = MEASURES) -> DataFrame:
    """The orders file is a single row group; its two narrow columns are
    hash-distributed by key before the arrays are built, so building and
    ranking run in parallel. The partition count is explicit: the key rows
    are narrow, and adaptive execution would otherwise merge them into one
    task, sizing by bytes what is really compute-heavy. A pass shuffles
    the points to these partitions and builds the arrays there, so no built
    row is shuffled."""
    return b_cube_from(b_orders(spark, sf_dir), measures)


def b_cube_wide(spark: SparkSession, sf_dir: str, n_config: int, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Stand-in B with any config count (320 gives the protocol's own cube
    shape: 2,560 values per point), bias ``n_config-1-c`` for anomalous points."""
    return b_cube_from(b_orders(spark, sf_dir), measures, n_config)


def b_label(status: Column) -> Column:
    return F.when(status == "F", 1).otherwise(0).cast("int")


def b_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b_orders(spark, sf_dir)
    flags = o.select(F.col("o_orderkey").alias("global_index"), F.lit(0).alias("missing"),
                     b_label(F.col("o_orderstatus")).alias("label"))
    return prepare_points(flags, 0)


# Anomaly definitions of the stand-in B scenario sweep
# (scenario id -> which orders count as anomalous).
B_SCENARIOS = {1: "status F", 2: "status P", 3: "priority 1-URGENT"}


def b_scenario_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked point tables of the three stand-in B scenarios: anomalous =
    status F / status P / priority starting with '1'; every other order is
    normal (label 0)."""
    o = b_orders(spark, sf_dir)
    flags = F.array(
        F.struct(F.lit(1).alias("scenario"), (F.col("o_orderstatus") == "F").alias("a")),
        F.struct(F.lit(2).alias("scenario"), (F.col("o_orderstatus") == "P").alias("a")),
        F.struct(F.lit(3).alias("scenario"), F.col("o_orderpriority").startswith("1").alias("a")))
    return (o.select(F.col("o_orderkey").alias("global_index"), F.explode(flags).alias("s"))
            .select(F.col("s.scenario").alias("scenario"), "global_index",
                    F.when(F.col("s.a"), 1).otherwise(0).cast("int").alias("label"),
                    F.lit(0).alias("missing")))


def b_cube_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second stand-in cube over the same orders: configs in reverse order."""
    return b_cube_from(b_orders(spark, sf_dir), backwards=True)
