"""Stratified k-fold assignment and train/test membership.

Contract: sort points by (label, h, global_index), where h is the md5 fold
hash of ``seed:global_index``; the point at 1-based position p gets fold
``(p - 1) mod k + 1``. Every class is then spread over the folds with counts
differing by at most one, and the assignment does not depend on
partitioning.

Scale: labels are few (a class can hold a third of all points or more), so a
window partitioned by label alone would put a whole class into one task.
``stratified_folds`` ranks in two levels instead: points are bucketed by the
leading bits of h (which keeps the order), a tiny (label, bucket) count table
gives each bucket its start position, and ``row_number`` only runs inside a
(label, bucket) partition.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condfuse.functions.columns import fold_hash
from condfuse.model import MAX_FOLDS, MIN_FOLDS, ProtocolError, ProtocolWarning

HASH_BITS = 32


def _check_k(k: int) -> None:
    if not (MIN_FOLDS <= k <= MAX_FOLDS):
        raise ProtocolError(f"fold count must be in {MIN_FOLDS}..{MAX_FOLDS}, got {k}")


def fold_positions(points: DataFrame, seed: int = 0, bucket_bits: int = 10, group_cols: Sequence[str] = ()) -> DataFrame:
    """Adds ``position``: the 1-based place of each point in the order of
    (label, hash, index). It does not depend on a fold count; ``fold_of``
    derives the fold of any count from it, so points are ranked once however
    many counts are used.

    ``group_cols`` rank independently per group (e.g. per scenario). The
    bucket table has at most (#groups x #labels x 2**bucket_bits) rows and is
    the only broadcast side; its size is bounded by the number of strata, not
    by the number of points. Points without a label are a stratum of their own.
    """
    g = list(group_cols)
    shift = HASH_BITS - bucket_bits
    h = fold_hash("global_index", seed)
    keyed = points.withColumns({"_h": h, "_b": F.shiftright(h, shift)})
    counts = keyed.groupBy(*g, "label", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*g).orderBy("label", "_b").rowsBetween(Window.unboundedPreceding, -1)
    same = [*g, "label", "_b"]
    offsets = counts.select(*[F.col(c).alias(f"_o_{c}") for c in same],
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*g, "label", "_b").orderBy("_h", "global_index")
    return (keyed.join(F.broadcast(offsets), [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in same])
            .withColumn("position", F.col("_start") + F.row_number().over(inside))
            .drop("_h", "_b", "_start", *[f"_o_{c}" for c in same]))


def fold_of(position: Column, k: int | Column) -> Column:
    """Fold (1..k) of a position: dealt round-robin."""
    return (((position - 1) % (F.lit(k) if isinstance(k, int) else k)) + 1).cast("int")


def stratified_folds(points: DataFrame, k: int | Column, seed: int = 0, bucket_bits: int = 10,
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """Adds ``fold`` (1..k) to ``points`` (needs ``global_index``, ``label``).

    ``group_cols`` assign folds independently per group; ``k`` may then be a
    column. See ``fold_positions``, whose place decides the fold.
    """
    if isinstance(k, int):
        _check_k(k)
    placed = fold_positions(points, seed, bucket_bits, group_cols)
    return placed.withColumn("fold", fold_of(F.col("position"), k)).drop("position")


def class_fold_check(points: DataFrame, k: int) -> list[str]:
    """Class-size checks of the fold split; returns warnings, raises when k
    exceeds the size of every class. Brings back one row."""
    sizes = points.groupBy("label").count().agg(F.min("count").alias("lo"), F.max("count").alias("hi")).first()
    return class_sizes_warnings(k, sizes["lo"], sizes["hi"])


def class_sizes_warnings(k: int, smallest: int | None, largest: int | None) -> list[str]:
    if largest is None or k > largest:
        raise ProtocolError(f"fold count {k} is greater than the number of members in each class")
    return [f"the smallest class has only {smallest} members, fewer than {k} folds"] if k > smallest else []


def train_test_split(points: DataFrame, k: int) -> DataFrame:
    """Explicit membership: every point is ``test`` in its own fold and
    ``train`` in the other k-1 folds. Emits k rows per point (a generator,
    not a join); the weighting protocol itself never needs it because
    training sums come from fold totals (see ``operators.scoring``)."""
    _check_k(k)
    folds = F.sequence(F.lit(1), F.lit(k))
    return (points.select("*", F.explode(folds).alias("cv_fold"))
            .withColumn("role", F.when(F.col("cv_fold") == F.col("fold"), F.lit("test")).otherwise(F.lit("train"))))


def split_sizes(points: DataFrame, k: int) -> DataFrame:
    """Set sizes per (cv_fold, role, label): test counts per fold, train
    counts as class total minus the fold's count. No k-fold expansion.
    An empty set is named in a ``ProtocolWarning`` (counts of at most k folds
    per label reach the driver for it)."""
    per_fold = points.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n_test"))
    totals = per_fold.groupBy("label").agg(F.sum("n_test").alias("n_total"))
    grid = totals.select("label", "n_total", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold"))
    j = grid.join(per_fold, ["fold", "label"], "left").fillna(0, ["n_test"])
    test = j.select(F.col("fold").alias("cv_fold"), F.lit("test").alias("role"), "label",
                    F.col("n_test").cast("bigint").alias("n_points"))
    train = j.select(F.col("fold").alias("cv_fold"), F.lit("train").alias("role"), "label",
                     (F.col("n_total") - F.col("n_test")).cast("bigint").alias("n_points"))
    for r in per_fold.groupBy("label").agg(F.count(F.lit(1)).alias("folds"), F.sum("n_test").alias("n")).collect():
        for text in empty_set_warnings(r["label"], r["folds"], k):
            warnings.warn(text, ProtocolWarning, stacklevel=2)
    return test.unionByName(train)


def empty_set_warnings(label: int | None, folds: int, k: int) -> list[str]:
    """What is empty when the points of a class stand in ``folds`` of ``k`` folds."""
    out = [f"class {label} has no test points in {k - folds} of {k} folds"] if folds < k else []
    return out + ([f"class {label} has no training points for one fold"] if folds == 1 else [])
