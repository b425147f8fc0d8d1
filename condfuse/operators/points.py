"""Point table: index range, day/slot arithmetic, labels, missing flags.

The point table is ``(global_index, label, missing)``; ``fold`` is added by
``operators.folds``. All operators here are narrow (no shuffle) except the
anti join / EXCEPT forms of missing removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from condfuse.functions.columns import not_missing
from condfuse.model import LABEL_ANOMALOUS, LABEL_MISSING, LABEL_NORMAL, STATE_LABELLED, STATE_NON_LABELLED


def point_range(spark: SparkSession, start: int, end: int) -> DataFrame:
    """Index range [start, end) as ``global_index``."""
    return spark.range(start, end).withColumnRenamed("id", "global_index")


def day_slot(df: DataFrame, per_day: int) -> DataFrame:
    """Adds ``day = gi div per_day`` and ``slot = gi mod per_day``."""
    gi = F.col("global_index")
    return df.withColumns({
        "day": F.floor(gi / F.lit(per_day)).cast("int"),
        "slot": (gi % F.lit(per_day)).cast("int"),
    })


def trim(df: DataFrame, lo: int | Column, hi: int | Column | None = None) -> DataFrame:
    """Keeps points with lo <= gi < hi (hi None: no upper bound)."""
    gi = F.col("global_index")
    cond = gi >= lo
    if hi is not None:
        cond = cond & (gi < hi)
    return df.filter(cond)


def override_label(df: DataFrame, missing_col: str = "missing") -> DataFrame:
    """label := 3 where the point is missing, so missing points form their own stratum."""
    return df.withColumn(
        "label", F.when(F.col(missing_col) == 1, F.lit(LABEL_MISSING)).otherwise(F.col("label")).cast("int"))


def mask_last_day(df: DataFrame, n_days: int | Column, per_day: int, vector_length: int | Column,
                  include_last: bool = False) -> DataFrame:
    """missing := 1 on the last complete day, i.e. for (n_days-1)*per_day <= gi < vector_length-1.

    The protocol's slice stops one short of the vector end, so the final
    element stays unmasked unless ``include_last`` is set.
    """
    gi = F.col("global_index")
    lo = (F.lit(n_days) if isinstance(n_days, int) else n_days) * F.lit(per_day) - F.lit(per_day)
    hi = F.lit(vector_length) if isinstance(vector_length, int) else vector_length
    if not include_last:
        hi = hi - F.lit(1)
    return df.withColumn("missing", F.when((gi >= lo) & (gi < hi), F.lit(1)).otherwise(F.col("missing")).cast("int"))


def prepare_points(flags: DataFrame, trim_start: int, per_day: int | None = None,
                   n_days: int | Column | None = None, vector_length: int | Column | None = None,
                   include_last: bool = False) -> DataFrame:
    """Flag table ``(global_index, missing, label)`` -> point table.

    Order of steps as in the protocol: trim to [trim_start, n_days*per_day),
    override labels of missing points with 3 (using the raw missing flag),
    then mask the last day (which keeps the label, so those points stay in
    their stratum but drop out of train and test sets).

    ``n_days`` and ``vector_length`` default to values derived from the flag
    table itself (scalar subqueries: no action, no driver round trip).
    """
    pts = flags.select("global_index", F.col("missing").cast("int"), F.col("label").cast("int"))
    if per_day is None:
        return override_label(trim(pts, trim_start))
    if vector_length is None:
        vector_length = flags.agg((F.max("global_index") + 1)).scalar()
    if n_days is None:
        n_days = F.floor(vector_length / F.lit(per_day)) if not isinstance(vector_length, int) \
            else vector_length // per_day
    hi = (F.lit(n_days) if isinstance(n_days, int) else n_days) * F.lit(per_day)
    pts = override_label(trim(pts, trim_start, hi))
    return mask_last_day(pts, n_days, per_day, vector_length, include_last)


def index_gaps(cube: DataFrame, start: int, end: int) -> DataFrame:
    """Indexes of [start, end) without a cube row."""
    return point_range(cube.sparkSession, start, end).join(cube.select("global_index"), "global_index", "left_anti")


def missing_points(points: DataFrame) -> DataFrame:
    """Indexes flagged missing."""
    return points.filter(F.col("missing") == 1).select("global_index")


def drop_missing(points: DataFrame, missing: DataFrame | None = None, how: str = "filter") -> DataFrame:
    """Removes missing points.

    ``filter`` uses the flag column (no shuffle, the default); ``anti`` is a
    left anti join against a missing-index table; ``except`` is EXCEPT
    DISTINCT on the index column (sorted-distinct set semantics).
    """
    if how == "filter":
        return points.filter(not_missing())
    if missing is None:
        missing = missing_points(points)
    if how == "anti":
        return points.join(missing.select("global_index"), "global_index", "left_anti")
    if how == "except":
        return points.select("global_index").subtract(missing.select("global_index"))
    raise ValueError(f"unknown how={how!r}")


def state_of(label: Column) -> Column:
    """Own-class state name of a label (1 -> labelled, 0 -> non_labelled)."""
    return (F.when(label == LABEL_ANOMALOUS, F.lit(STATE_LABELLED))
            .when(label == LABEL_NORMAL, F.lit(STATE_NON_LABELLED)))


def split_by_label(points: DataFrame) -> DataFrame:
    """Keeps labels 0 and 1 and names their state; other labels are dropped."""
    return (points.filter(F.col("label").isin(LABEL_NORMAL, LABEL_ANOMALOUS))
            .withColumn("state", state_of(F.col("label"))))


def usable(points: DataFrame) -> DataFrame:
    """Points that are ranked and tested: label 0 or 1, not missing."""
    return points.filter(F.col("label").isin(LABEL_NORMAL, LABEL_ANOMALOUS) & not_missing())
