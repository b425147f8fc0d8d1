"""Registered queries over the stand-in inputs (see ``sources.standins``).

Each callable takes (spark, sf_dir) and returns a DataFrame whose doubles
are rounded to 6 places, so an independent engine can be compared row by
row. Every query reads whole driver tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condfuse.functions.columns import MEASURES, round6, score_cols, weight_cols, weighted_cols
from condfuse.model import Protocol
from condfuse.operators import evaluate as ev
from condfuse.operators import folds as fo
from condfuse.operators import metrics as me
from condfuse.operators import points as po
from condfuse.operators import scoring as sc
from condfuse.operators import validate as va
from condfuse.operators import weights as we
from condfuse.plans import protocol as pr
from condfuse.sources import cube as cu
from condfuse.sources import standins as st
from condfuse.sources.configs import config_grid

SEED = 42
A_FOLDS = 3
A_FOLDS_AVG = 5
B_FOLDS = 3
TOPX_FRACTION = 0.4
SWEEP_FOLDS = (2, 3)
SWEEP_MODES = ("Top25Percent", "Top3", "All")
TWO_CUBES = {1: "plain", 2: "plain", 3: "reversed"}
# fold count, anomaly method, score method, search mode and top-k mode ids of the A runs
PREDICTION_PARAMS = (A_FOLDS, 0, 0, 0, 0)

PA = Protocol(folds=A_FOLDS, seed=SEED)
PB = Protocol(folds=B_FOLDS, seed=SEED)

S, W, O = score_cols(MEASURES), weight_cols(MEASURES), weighted_cols(MEASURES)


def _r(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: round6(c) for c in cols})


# ---------------------------------------------------------------- stand-in A inputs

def a_inputs(spark, d, k=A_FOLDS):
    cube = st.a_cube(spark, d)
    pts = fo.stratified_folds(st.a_points(spark, d), k, SEED)
    return cube, pts


def a_train(spark, d, p=PA):
    cube, pts = a_inputs(spark, d, p.folds)
    return sc.train_sums(sc.fold_sums(cube, pts, p.measures, p.order), p.folds, p.measures)


# ---------------------------------------------------------------- points and sources

def q_point_flags(spark, d):
    return st.a_flags(spark, d)


def q_point_range(spark, d):
    return st.a_points(spark, d).select("global_index")


def q_point_labels(spark, d):
    return st.a_points(spark, d).select("global_index", "label")


def q_day_slot(spark, d):
    return po.day_slot(st.a_points(spark, d), st.A_PER_DAY).select("global_index", "day", "slot")


def q_mask_last_day(spark, d):
    return st.a_points(spark, d).select("global_index", "missing")


def q_missing_points(spark, d):
    return po.missing_points(st.a_points(spark, d))


def q_drop_missing_anti(spark, d):
    pts = st.a_points(spark, d)
    return po.drop_missing(po.split_by_label(pts), po.missing_points(pts), how="anti").select("global_index", "label")


def q_drop_missing_except(spark, d):
    pts = st.a_points(spark, d)
    return po.drop_missing(po.split_by_label(pts), po.missing_points(pts), how="except")


def q_split_by_label(spark, d):
    return po.split_by_label(st.a_points(spark, d)).select("global_index", "label", "state")


def q_select_points_semi(spark, d):
    cube, pts = a_inputs(spark, d)
    test1 = po.usable(pts).filter(F.col("fold") == 1)
    return _r(cu.cube_to_long(cu.select_points(cube, test1)), MEASURES)


def q_cube_reshape(spark, d):
    cube = st.a_cube(spark, d)
    back = cu.long_to_cube(cu.cube_to_long(cube))
    return _r(cu.cube_to_long(back), MEASURES)


def q_validate_inputs(spark, d):
    """What ``validate_inputs`` looks at, over the cube without every 41st
    point, so that gaps and uncovered points are found."""
    cube = st.a_cube(spark, d).filter(F.col("global_index") % 41 != 7)
    return va.input_profile(cube, st.a_points(spark, d))


def q_index_gaps(spark, d):
    """Indexes of the whole range of vectors that a cube without every 41st point lacks."""
    cube = st.a_cube(spark, d)
    end = cube.agg(F.max("global_index")).first()[0] + 1
    return po.index_gaps(cube.filter(F.col("global_index") % 41 != 7), 0, end)


# ---------------------------------------------------------------- scoring and weights

def q_rank_scores(spark, d):
    return sc.rank_scores_long(st.a_cube(spark, d))


def q_rank_scores_abs(spark, d):
    return sc.rank_scores_long(st.a_cube(spark, d), order="abs")


def _a_cube_ties(spark, d):
    cube = st.a_cube(spark, d)
    return cube.select("global_index", *[F.transform(m, lambda x: F.floor(x * 10).cast("float")).alias(m) for m in MEASURES])


def _a_cube_nan(spark, d):
    cube = st.a_cube(spark, d)

    def poke(m):
        return F.transform(m, lambda x, c: F.when((F.col("global_index") + c) % 43 == 0, F.lit(None).cast("float"))
                           .when((F.col("global_index") + c) % 41 == 0, F.lit(float("nan")).cast("float"))
                           .otherwise(x))
    return cube.select("global_index", *[poke(m).alias(m) for m in MEASURES])


def q_rank_scores_ties(spark, d):
    return sc.rank_scores_long(_a_cube_ties(spark, d))


def q_rank_scores_nan(spark, d):
    return sc.rank_scores_long(_a_cube_nan(spark, d))


def q_config_score_sum(spark, d):
    return a_train(spark, d).filter(F.col("state") != "merged")


def q_merged_scores(spark, d):
    return a_train(spark, d).filter(F.col("state") == "merged").drop("state")


def q_score_shift(spark, d):
    return we.shift_scores(a_train(spark, d)).select("fold", "state", "config_index", *S)


def q_ensemble_weights(spark, d):
    w = we.make_weights(a_train(spark, d), MEASURES, PA.mode)
    return _r(w.select("fold", "state", "config_index", "last_rank", *S, *W), W)


def closeness(errors):
    """A scorer that is no rank: 1 for no error, falling with its square."""
    return 1.0 / (1.0 + errors.astype("float64") ** 2)


def q_scorer_weights(spark, d):
    """Weights from a scorer of the user's own, over all configs."""
    cube, pts = a_inputs(spark, d)
    w = pr.fit_weights(cube, pts, Protocol(folds=A_FOLDS, seed=SEED, mode="All"), scorer=closeness)
    return _r(w.select("fold", "state", "config_index", "n_points", *S, *W), [*S, *W])


def q_describe_weights(spark, d):
    """Weights of the 320-config cube with the parameters of each config."""
    cube = st.b_cube_wide(spark, d, 320)
    w = pr.fit_weights(cube, fo.stratified_folds(st.b_points(spark, d), B_FOLDS, SEED), PB)
    j = we.describe_weights(w, config_grid(spark))
    return _r(j.select("fold", "state", "config_index", "search_step_length", "window_size", "k_level1",
                       "weight_flow1", "weight_speed8"), ["weight_flow1", "weight_speed8"])


def _a_pred(spark, d, p=PA):
    cube, pts = a_inputs(spark, d, p.folds)
    return pr.predictions(cube, pts, p)


def q_weighted_error(spark, d):
    return _r(_a_pred(spark, d), O)


def q_weighted_error_lastrank(spark, d):
    return _r(_a_pred(spark, d, Protocol(folds=A_FOLDS, seed=SEED, align="last_rank")), O)


def _wide_cols():
    return [f"{p}_{o}" for o in O for p in ("avg", "std", "mae")]


def q_error_metrics(spark, d):
    cube, pts = a_inputs(spark, d)
    return _r(pr.evaluate(cube, pts, PA, wide=True), _wide_cols())


def q_metrics_long(spark, d):
    cube, pts = a_inputs(spark, d)
    return _r(pr.evaluate(cube, pts, PA), O)


def q_split_sizes(spark, d):
    _, pts = a_inputs(spark, d)
    return fo.split_sizes(po.usable(pts), A_FOLDS)


def q_prediction_table(spark, d):
    return _r(ev.prediction_table(_a_pred(spark, d), params=PREDICTION_PARAMS), O)


def q_report_states(spark, d):
    cube, pts = a_inputs(spark, d)
    states = ev.report_states(pr.moments(cube, pts, PA))
    return _r(states.select(F.col("fold").alias("cv_fold_order"), "label_state", "n_points",
                            (F.col("mean_weighted_err_flow1") * F.col("n_points")).alias("sum_flow1")), ["sum_flow1"])


def _a_metrics5(spark, d):
    p = Protocol(folds=A_FOLDS_AVG, seed=SEED)
    cube, pts = a_inputs(spark, d, p.folds)
    return pr.evaluate(cube, pts, p)


def q_fold_average(spark, d):
    return _r(me.fold_average(_a_metrics5(spark, d)), O)


def q_running_fold_average(spark, d):
    return _r(me.running_fold_average(_a_metrics5(spark, d)), O)


def q_cv_summary(spark, d):
    cube, pts = a_inputs(spark, d)
    avg = me.fold_average(pr.evaluate(cube, pts, PA))
    return _r(me.summary(avg, "embeddings_label_1", PA.score_method, PA.mode), O)


# ---------------------------------------------------------------- stand-in B

def b_inputs(spark, d, k=B_FOLDS):
    return st.b_cube(spark, d), fo.stratified_folds(st.b_points(spark, d), k, SEED)


def _b_weights(mode, fraction=None):
    def q(spark, d):
        cube, pts = b_inputs(spark, d)
        tr = sc.train_sums(sc.fold_sums(cube, pts), B_FOLDS)
        w = we.make_weights(tr, MEASURES, mode, fraction)
        return _r(w.select("fold", "state", "config_index", *W), W)
    return q


def q_stratified_folds(spark, d):
    _, pts = b_inputs(spark, d)
    return pts.select("global_index", "label", "fold")


def q_train_test_split(spark, d):
    _, pts = b_inputs(spark, d)
    tt = fo.train_test_split(po.usable(pts), B_FOLDS)
    return tt.groupBy("cv_fold", "role", "label").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("global_index").alias("min_index"),
        F.max("global_index").alias("max_index"), F.sum("global_index").alias("sum_index"))


def q_condition_aware_cv(spark, d):
    cube, pts = b_inputs(spark, d)
    return _r(pr.evaluate(cube, pts, PB), O)


def q_scenario_sweep(spark, d):
    res = pr.sweep(st.b_cube(spark, d), st.b_scenario_points(spark, d), sorted(st.B_SCENARIOS),
                   SWEEP_FOLDS, SWEEP_MODES, PB)
    return _r(res, O)


def q_sweep_topx(spark, d):
    """A sweep whose modes include a free fraction."""
    res = pr.sweep(st.b_cube(spark, d), st.b_scenario_points(spark, d), [1, 3], (2,), ("TopXPercent", "Top1"), PB,
                   fraction=TOPX_FRACTION)
    return _r(res, O)


def q_sweep_two_cubes(spark, d):
    """Scenarios 1 and 2 on the stand-in cube, 3 on the one with reversed configs."""
    cubes = {"plain": st.b_cube(spark, d), "reversed": st.b_cube_shifted(spark, d)}
    res = pr.sweep(cubes, st.b_scenario_points(spark, d), sorted(st.B_SCENARIOS), (3,), ("Top25Percent",), PB,
                   cube_of=TWO_CUBES)
    return _r(res, O)


def q_improvement_report(spark, d):
    cube, pts = b_inputs(spark, d)
    imp = me.improvement(me.fold_average(pr.evaluate(cube, pts, PB)))
    return _r(imp, [o.replace("weighted_err_", "improvement_") for o in O])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "point_flags": q_point_flags,
    "point_range": q_point_range,
    "point_labels": q_point_labels,
    "day_slot": q_day_slot,
    "mask_last_day": q_mask_last_day,
    "missing_points": q_missing_points,
    "drop_missing_anti": q_drop_missing_anti,
    "drop_missing_except": q_drop_missing_except,
    "split_by_label": q_split_by_label,
    "index_gaps": q_index_gaps,
    "select_points_semi": q_select_points_semi,
    "cube_reshape": q_cube_reshape,
    "validate_inputs": q_validate_inputs,
    "rank_scores": q_rank_scores,
    "rank_scores_abs": q_rank_scores_abs,
    "rank_scores_ties": q_rank_scores_ties,
    "rank_scores_nan": q_rank_scores_nan,
    "config_score_sum": q_config_score_sum,
    "merged_scores": q_merged_scores,
    "score_shift": q_score_shift,
    "ensemble_weights": q_ensemble_weights,
    "scorer_weights": q_scorer_weights,
    "describe_weights": q_describe_weights,
    "weighted_error": q_weighted_error,
    "weighted_error_lastrank": q_weighted_error_lastrank,
    "error_metrics": q_error_metrics,
    "metrics_long": q_metrics_long,
    "split_sizes": q_split_sizes,
    "prediction_table": q_prediction_table,
    "report_states": q_report_states,
    "fold_average": q_fold_average,
    "running_fold_average": q_running_fold_average,
    "cv_summary": q_cv_summary,
    "topk_weights_top25pct": _b_weights("Top25Percent"),
    "topk_weights_top50pct": _b_weights("Top50Percent"),
    "topk_weights_all": _b_weights("All"),
    "topk_weights_top1": _b_weights("Top1"),
    "topk_weights_top3": _b_weights("Top3"),
    "topk_weights_top10": _b_weights("Top10"),
    "topk_weights_topx": _b_weights("TopXPercent", TOPX_FRACTION),
    "stratified_folds": q_stratified_folds,
    "train_test_split": q_train_test_split,
    "condition_aware_cv": q_condition_aware_cv,
    "scenario_sweep": q_scenario_sweep,
    "sweep_topx": q_sweep_topx,
    "sweep_two_cubes": q_sweep_two_cubes,
    "improvement_report": q_improvement_report,
}
