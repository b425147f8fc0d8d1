"""Direct forms of what the library computes by shortcuts, for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condfuse.functions.columns import MEASURES, fold_hash, score_cols
from condfuse.operators.folds import train_test_split
from condfuse.operators.points import state_of, usable
from condfuse.operators.scoring import membership_sums


def stratified_folds_simple(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """The fold contract with one global window."""
    w = Window.orderBy("label", "_h", "global_index")
    return (points.withColumn("_h", fold_hash("global_index", seed))
            .withColumn("fold", (((F.row_number().over(w) - 1) % F.lit(k)) + 1).cast("int")).drop("_h"))


def train_sums_direct(cube: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Training sums from explicit train lists, without the fold complement."""
    scores = score_cols(MEASURES)
    train = train_test_split(usable(points), k).filter(F.col("role") == "train")
    mem = train.groupBy("global_index").agg(
        F.collect_list(F.struct(F.col("cv_fold").cast("int").alias("fold"), F.col("label").cast("int").alias("label")))
        .alias("keys"))
    own = membership_sums(cube.join(mem, "global_index")).withColumn("state", state_of(F.col("label"))).drop("label")
    merged = (own.groupBy("fold", "config_index")
              .agg(F.sum("n_points").alias("n_points"), *[F.sum(s).cast("bigint").alias(s) for s in scores])
              .withColumn("state", F.lit("merged")))
    return own.unionByName(merged)
