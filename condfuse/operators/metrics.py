"""AVG / STD / MAE per report state and fold, and their fold averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condfuse.functions.columns import MEASURES, nan_to_null, weighted_cols

# Metric names of the report, in report order.
METRICS = ("AVG", "STD", "MAE")


def moment_cols(column: str) -> list[str]:
    """Names of the count, mean, sum of squared deviations and sum of
    absolute values of ``column``."""
    return [f"{p}_{column}" for p in ("n", "mean", "m2", "sabs")]


def moments_of(pred: DataFrame, measures: Sequence[str] = MEASURES, keys: Sequence[str] = ("fold", "label", "kind")) -> DataFrame:
    """Moments per group from a table of weighted errors (one row per point).
    NaN is skipped like pandas does; partial aggregation runs map-side."""
    aggs = [F.count(F.lit(1)).alias("n_points")]
    for o in weighted_cols(measures):
        v = nan_to_null(F.col(o))
        n, mean, m2, sabs = moment_cols(o)
        aggs += [F.count(v).cast("double").alias(n), F.coalesce(F.avg(v), F.lit(0.0)).alias(mean),
                 F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias(m2),
                 F.coalesce(F.sum(F.abs(v)), F.lit(0.0)).alias(sabs)]
    return pred.groupBy(*keys).agg(*aggs)


def merge_moments(parts: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Adds up moment rows per ``keys``. Deviations are taken from the mean
    of the whole group, so nothing cancels; a group holds one row per task or
    per group merged, never points."""
    group = Window.partitionBy(*keys)
    out = weighted_cols(measures)
    means = {}
    for o in out:
        n, mean, _, _ = moment_cols(o)
        total = F.sum(n).over(group)
        means[f"_all_{mean}"] = F.when(total > 0, F.sum(F.col(n) * F.col(mean)).over(group) / total).otherwise(0.0)
    df = parts.select("*", *[c.alias(k) for k, c in means.items()])
    aggs = [F.sum("n_points").cast("bigint").alias("n_points")]
    for o in out:
        n, mean, m2, sabs = moment_cols(o)
        away = F.col(mean) - F.col(f"_all_{mean}")
        aggs += [F.sum(n).alias(n), F.first(f"_all_{mean}").alias(mean),
                 F.sum(F.col(m2) + F.col(n) * away * away).alias(m2), F.sum(sabs).alias(sabs)]
    return df.groupBy(*keys).agg(*aggs)


def error_metrics(states: DataFrame, measures: Sequence[str] = MEASURES,
                  keys: Sequence[str] = ("fold", "label_state")) -> DataFrame:
    """Wide metrics from moments: ``n_points``, ``avg_*``, ``std_*`` (sample,
    ddof 1; null for one point) and ``mae_*`` (mean absolute value)."""
    cols = []
    for o in weighted_cols(measures):
        n, mean, m2, sabs = (F.col(c) for c in moment_cols(o))
        cols += [F.when(n > 0, mean).alias("avg_" + o), F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("std_" + o),
                 F.when(n > 0, sabs / n).alias("mae_" + o)]
    return states.select(*keys, "n_points", *cols)


def metrics_long(wide: DataFrame, measures: Sequence[str] = MEASURES, cv_fold_nr: int | None = None,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Wide metrics -> report rows ``(keys..., label, metric, cv_fold_order,
    cv_fold_nr, weighted_err_*)``, one row per metric."""
    out = weighted_cols(measures)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"),
                              *[F.col(f"{m.lower()}_{o}").alias(o) for o in out]) for m in METRICS])
    nr = F.lit(cv_fold_nr).cast("int") if cv_fold_nr is not None else F.col("cv_fold_nr").cast("int")
    return (wide.select(*keys, F.col("label_state").alias("label"), F.col("fold").cast("int").alias("cv_fold_order"),
                        nr.alias("cv_fold_nr"), F.explode(rows).alias("_r"))
            .select(*keys, "label", F.col("_r.metric").alias("metric"), "cv_fold_order", "cv_fold_nr",
                    *[F.col("_r." + o).alias(o) for o in out]))


def fold_average(metrics: DataFrame, measures: Sequence[str] = MEASURES, keys: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean over folds per (keys..., label, metric, cv_fold_nr)."""
    out = weighted_cols(measures)
    return metrics.groupBy(*keys, "label", "metric", "cv_fold_nr").agg(*[F.avg(o).alias(o) for o in out])


def running_fold_average(metrics: DataFrame, measures: Sequence[str] = MEASURES,
                         keys: Sequence[str] = ()) -> DataFrame:
    """Mean of folds 1..j after each fold j ("until now" report)."""
    out = weighted_cols(measures)
    w = (Window.partitionBy(*keys, "label", "metric", "cv_fold_nr").orderBy("cv_fold_order")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return metrics.select(*keys, "label", "metric", "cv_fold_order", "cv_fold_nr",
                          *[F.avg(o).over(w).alias(o) for o in out])


def summary(averaged: DataFrame, anomaly_method: str, score_method: str, top_tuple_method: str | None = None) -> DataFrame:
    """Fold-averaged report with the method columns."""
    out = averaged.withColumns({"anomaly_method": F.lit(anomaly_method), "score_method": F.lit(score_method)})
    if top_tuple_method is not None:
        out = out.withColumn("top_tuple_method", F.lit(top_tuple_method))
    return out


# aware/unaware report-state pairs compared by the improvement report.
IMPROVEMENT_PAIRS = (
    ("labelled", "labelled_aware", "labelled_unaware"),
    ("non_labelled", "non_labelled_aware", "non_labelled_unaware"),
    ("both", "both_aware", "both_unaware"),
    ("mixed", "mixed", "both_unaware"),
)


def improvement(averaged: DataFrame, measures: Sequence[str] = MEASURES, keys: Sequence[str] = ()) -> DataFrame:
    """MAE improvement of condition-aware over unaware weighting, in percent:
    ``100 * (mae_unaware - mae_aware) / mae_unaware`` per pair and measure.
    Conditional aggregation over the small fold-average table (no join)."""
    out = weighted_cols(measures)
    mae = averaged.filter(F.col("metric") == "MAE")
    rows = []
    for name, aware, unaware in IMPROVEMENT_PAIRS:
        aggs = []
        for o in out:
            a = F.max(F.when(F.col("label") == aware, F.col(o)))
            u = F.max(F.when(F.col("label") == unaware, F.col(o)))
            aggs.append(F.when(u != 0, F.lit(100.0) * (u - a) / u).alias(o.replace("weighted_err_", "improvement_")))
        rows.append(mae.groupBy(*keys, "cv_fold_nr").agg(*aggs).withColumn("comparison", F.lit(name)))
    res = rows[0]
    for r in rows[1:]:
        res = res.unionByName(r)
    return res
