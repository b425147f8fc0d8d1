import numpy as np
import pytest
from pyspark.sql import functions as F

from condfuse.functions.columns import MEASURES, score_cols, weight_cols, weighted_cols
from condfuse.model import Protocol, ProtocolError, top_k
from condfuse.operators import evaluate as ev
from condfuse.operators import folds as fo
from condfuse.operators import metrics as me
from condfuse.operators import points as po
from condfuse.operators import scoring as sc
from condfuse.operators import weights as we
from condfuse.plans import protocol as pr
from condfuse.sources import standins as st
from tests import brute
from tests.explicit import stratified_folds_simple, train_sums_direct
from tests.conftest import SF_MID, SF_SMALL

S, W, O = score_cols(MEASURES), weight_cols(MEASURES), weighted_cols(MEASURES)


def _inputs(spark, d=SF_SMALL, k=3):
    return st.a_cube(spark, d), fo.stratified_folds(st.a_points(spark, d), k, 42)


def test_scores_sum_per_point(spark):
    r = sc.rank_scores(st.a_cube(spark, SF_SMALL))
    n = 8
    bad = r.filter(F.exists(F.array(*[F.aggregate(s, F.lit(0), lambda a, x: a + x) != n * (n - 1) // 2 for s in S]),
                            lambda b: b)).count()
    assert bad == 0


def test_engines_agree(spark):
    cube, pts = _inputs(spark)
    a = sc.fold_sums(cube, pts, engine="arrow").orderBy("fold", "label", "config_index").collect()
    b = sc.fold_sums(cube, pts, engine="sql").orderBy("fold", "label", "config_index").collect()
    assert [tuple(x) for x in a] == [tuple(x) for x in b]
    for order in ("raw", "abs"):
        x = sc.rank_scores_long(cube, order=order).orderBy("global_index", "config_index").collect()
        y = sc.rank_scores_long(cube, order=order, engine="sql").orderBy("global_index", "config_index").collect()
        assert x == y


def test_rank_shift_invariance(spark):
    cube = st.a_cube(spark, SF_SMALL)
    shifted = cube.select("global_index", *[F.transform(m, lambda x: x + F.lit(5.0).cast("float")).alias(m)
                                             for m in MEASURES])
    a = sc.rank_scores_long(cube).orderBy("global_index", "config_index").collect()
    b = sc.rank_scores_long(shifted).orderBy("global_index", "config_index").collect()
    assert a == b


def test_fold_complement_equals_direct(spark):
    cube, pts = _inputs(spark)
    r1 = sc.train_sums(sc.fold_sums(cube, pts), 3)
    j3 = train_sums_direct(cube, pts, 3)
    key = ["fold", "state", "config_index"]
    assert sorted(map(tuple, r1.select(*key, "n_points", *S).collect())) == \
        sorted(map(tuple, j3.select(*key, "n_points", *S).collect()))


def test_two_level_folds_equal_simple(spark):
    pts = st.b_points(spark, SF_MID)
    a = fo.stratified_folds(pts, 5, 7, bucket_bits=6).select("global_index", "fold")
    b = stratified_folds_simple(pts, 5, 7).select("global_index", "fold")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    counts = fo.stratified_folds(pts, 5, 7).groupBy("label", "fold").count().groupBy("label") \
        .agg((F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in counts)


def test_points_without_label_keep_a_fold(spark):
    pts = st.b_points(spark, SF_SMALL).withColumn("label", F.when(F.col("global_index") % 4 > 0, F.col("label")))
    a = fo.stratified_folds(pts, 3, 7)
    b = stratified_folds_simple(pts, 3, 7)
    assert a.count() == pts.count() and a.select("global_index", "fold").exceptAll(b.select("global_index", "fold")).count() == 0


def test_weights_normalised_and_cut(spark):
    cube, pts = _inputs(spark, SF_MID)
    tr = sc.train_sums(sc.fold_sums(cube, pts), 3)
    for mode, keep in (("Top25Percent", 2), ("Top1", 1), ("All", 8)):
        w = we.make_weights(tr, MEASURES, mode)
        agg = w.groupBy("fold", "state").agg(
            *[F.sum(c).alias("s_" + c) for c in W], *[F.count(F.when(F.col(c) > 0, 1)).alias("n_" + c) for c in W])
        for r in agg.collect():
            for c in W:
                assert abs(r["s_" + c] - 1.0) < 1e-9
                assert r["n_" + c] <= keep


def test_top1_is_raw_error_of_best(spark):
    cube, pts = _inputs(spark)
    p = Protocol(folds=3, seed=42, mode="Top1")
    w = pr.fit_weights(cube, pts, p)
    best = w.filter(F.col("weight_flow1") == 1.0).select("fold", "state", F.col("config_index").alias("best"))
    pred = pr.predictions(cube, pts, p).withColumn(
        "state", F.when(F.col("kind") == "merged", "merged").otherwise(po.state_of(F.col("label"))))
    j = pred.join(best, ["fold", "state"]).join(cube, "global_index")
    diff = j.select(F.abs(F.col("weighted_err_flow1") - F.element_at("err_flow1", F.col("best") + 1)).alias("d"))
    assert diff.agg(F.max("d")).first()[0] < 1e-7


@pytest.mark.parametrize("align", ["config", "last_rank"])
def test_against_brute_force(spark, align):
    cube, pts = _inputs(spark)
    p = Protocol(folds=3, seed=42, align=align)
    got = {(r["fold"], r["global_index"], r["kind"]): np.array([r[o] for o in O])
           for r in pr.predictions(cube, pts, p).collect()}
    cube_rows = {r["global_index"]: np.stack([np.array(r[m], dtype=float) for m in MEASURES], axis=1)
                 for r in cube.collect()}
    prow = {r["global_index"]: r for r in pts.collect()}
    errors = {g: cube_rows[g] for g in prow}
    want = brute.evaluate(errors, {g: r["label"] for g, r in prow.items()}, {g: r["missing"] for g, r in prow.items()},
                          {g: r["fold"] for g, r in prow.items()}, 3, top_k("Top25Percent", 8), align)
    assert set(got) == set(want)
    for key, v in want.items():
        assert np.allclose(got[key], v, atol=1e-9), key


def test_report_state_counts(spark):
    cube, pts = _inputs(spark, SF_MID)
    w = pr.evaluate(cube, pts, Protocol(folds=3, seed=42), wide=True)
    rows = {(r["fold"], r["label_state"]): r for r in w.collect()}
    for f in (1, 2, 3):
        n = {s: rows[(f, s)]["n_points"] for s in ev.REPORT_STATES}
        assert n["both_unaware"] == n["labelled_unaware"] + n["non_labelled_unaware"]
        assert n["both_aware"] == n["labelled_aware"] + n["non_labelled_aware"]
        assert n["mixed"] == n["labelled_aware"] + n["non_labelled_unaware"]
        for s in ev.REPORT_STATES:
            for o in O:
                assert abs(rows[(f, s)]["avg_" + o]) <= rows[(f, s)]["mae_" + o] + 1e-12


def test_empty_state_has_no_rows(spark):
    cube, pts = _inputs(spark)
    pts0 = pts.filter(F.col("label") != 1)
    w = pr.fit_weights(cube, pts0, Protocol(folds=3, seed=42))
    assert w.filter(F.col("state") == "labelled").count() == 0
    m = pr.evaluate(cube, pts0, Protocol(folds=3, seed=42))
    labels = {r["label"] for r in m.select("label").distinct().collect()}
    assert labels == {"non_labelled_aware", "non_labelled_unaware", "both_aware", "both_unaware", "mixed"}


def test_all_equal_scores_give_null_weights(spark):
    df = spark.createDataFrame([(1, "labelled", c, 5) for c in range(4)], "fold int, state string, config_index int, score_flow1 bigint")
    w = we.make_weights(df, ["err_flow1"], "All").collect()
    assert all(r["weight_flow1"] is None for r in w)


def test_aware_beats_unaware_on_standin_b(spark):
    cube, pts = st.b_cube(spark, SF_MID), fo.stratified_folds(st.b_points(spark, SF_MID), 3, 42)
    avg = me.fold_average(pr.evaluate(cube, pts, Protocol(folds=3, seed=42, mode="Top25Percent")))
    mae = {r["label"]: r for r in avg.filter("metric = 'MAE'").collect()}
    for o in ("weighted_err_flow1", "weighted_err_speed1", "weighted_err_flow2"):
        assert mae["labelled_aware"][o] < mae["labelled_unaware"][o]
        assert mae["both_aware"][o] < mae["both_unaware"][o]


def test_running_average_last_equals_fold_average(spark):
    cube, pts = _inputs(spark, SF_MID, 5)
    m = pr.evaluate(cube, pts, Protocol(folds=5, seed=42))
    run = me.running_fold_average(m).filter("cv_fold_order = 5")
    avg = me.fold_average(m)
    a = {(r["label"], r["metric"]): r["weighted_err_flow1"] for r in run.collect()}
    b = {(r["label"], r["metric"]): r["weighted_err_flow1"] for r in avg.collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_protocol_validation():
    with pytest.raises(ProtocolError):
        Protocol(folds=11)
    with pytest.raises(ProtocolError):
        Protocol(mode="TopXPercent")
    with pytest.raises(ProtocolError):
        Protocol(mode="TopXPercent", fraction=1.5)
    with pytest.raises(ProtocolError):
        Protocol(mode="Top7")
    with pytest.raises(ProtocolError):
        Protocol(score_method="Reciprocal_Square")
    assert Protocol(mode=6, fraction=0.3).mode == "TopXPercent"
    assert top_k("Top25Percent", 320) == 80 and top_k("TopXPercent", 32, 0.4) == 12 and top_k("All", 5) is None


def test_sweep_equals_single_runs(spark):
    d = SF_MID
    cube = st.b_cube(spark, d)
    scen = st.b_scenario_points(spark, d)
    res = pr.sweep(cube, scen, [1, 2, 3], [2, 3], ["Top25Percent", "Top3"], Protocol(seed=42))
    got = {(r["scenario"], r["mode"], r["cv_fold_nr"], r["label"], r["metric"]): r["weighted_err_speed4"]
           for r in res.collect()}
    for s, k, mode in ((2, 3, "Top3"), (3, 2, "Top25Percent")):
        pts = fo.stratified_folds(scen.filter(F.col("scenario") == s).drop("scenario"), k, 42)
        one = me.fold_average(pr.evaluate(cube, pts, Protocol(folds=k, seed=42, mode=mode)))
        for r in one.collect():
            assert abs(got[(s, mode, k, r["label"], r["metric"])] - r["weighted_err_speed4"]) < 1e-9


def test_partitioning_does_not_change_results(spark):
    cube, pts = _inputs(spark)
    p = Protocol(folds=3, seed=42)
    a = pr.evaluate(cube, pts, p).collect()
    b = pr.evaluate(cube.repartition(7), st.a_points(spark, SF_SMALL).repartition(5)
                    .transform(lambda d: fo.stratified_folds(d, 3, 42, bucket_bits=3)), p).collect()
    norm = lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)
    assert norm(a) == norm(b)


@pytest.mark.parametrize("engine", ["arrow", "sql"])
def test_nan_cube_against_brute_force(spark, engine):
    from condfuse.plans.registry import _a_cube_nan

    cube = _a_cube_nan(spark, SF_SMALL)
    pts = fo.stratified_folds(st.a_points(spark, SF_SMALL), 3, 42)
    p = Protocol(folds=3, seed=42)
    got = {(r["fold"], r["global_index"], r["kind"]): np.array([r[o] for o in O])
           for r in pr.predictions(cube, pts, p, engine=engine).collect()}
    rows = {r["global_index"]: np.stack([np.array([np.nan if v is None else v for v in r[m]], dtype=float)
                                         for m in MEASURES], axis=1) for r in cube.collect()}
    prow = {r["global_index"]: r for r in pts.collect()}
    want = brute.evaluate({g: rows[g] for g in prow}, {g: r["label"] for g, r in prow.items()},
                          {g: r["missing"] for g, r in prow.items()}, {g: r["fold"] for g, r in prow.items()},
                          3, top_k("Top25Percent", 8))
    assert set(got) == set(want)
    for key, v in want.items():
        assert np.allclose(got[key], v, atol=1e-9), key


def _brute_inputs(cube, pts):
    rows = {r["global_index"]: np.stack([np.array([np.nan if v is None else v for v in r[m]], dtype=float)
                                         for m in MEASURES], axis=1) for r in cube.collect()}
    prow = {r["global_index"]: r for r in pts.collect()}
    return ({g: rows[g] for g in prow}, {g: r["label"] for g, r in prow.items()},
            {g: r["missing"] for g, r in prow.items()}, {g: r["fold"] for g, r in prow.items()})


def _same_metrics(rows, want):
    got = {(r["fold"], r["label_state"]): r for r in rows}
    assert set(got) == set(want)
    for key, (n, avg, std, mae) in want.items():
        r = got[key]
        assert r["n_points"] == n
        for j, o in enumerate(O):
            assert abs(r["avg_" + o] - avg[j]) < 1e-9 and abs(r["mae_" + o] - mae[j]) < 1e-9
            if n > 1:
                assert abs(r["std_" + o] - std[j]) < 1e-9
            else:
                assert r["std_" + o] is None


@pytest.mark.parametrize("align", ["config", "last_rank"])
def test_report_against_brute_force(spark, align):
    cube, pts = _inputs(spark)
    p = Protocol(folds=3, seed=42, align=align)
    errors, labels, missing, fold = _brute_inputs(cube, pts)
    weighted = brute.evaluate(errors, labels, missing, fold, 3, top_k("Top25Percent", 8), align)
    want = brute.report(weighted, labels, 3)
    _same_metrics(pr.evaluate(cube, pts, p, wide=True).collect(), want)
    # the same from the table of errors per point
    pred = pr.predictions(cube, pts, p)
    _same_metrics(pr.metrics_of(me.moments_of(pred), p, wide=True).collect(), want)


def test_one_point_has_no_deviation(spark):
    cube, pts = _inputs(spark)
    one = po.usable(pts).groupBy("fold").agg(F.min(F.when(F.col("label") == 1, F.col("global_index"))).alias("g"))
    few = pts.join(one, "fold").filter((F.col("label") == 0) | (F.col("global_index") == F.col("g"))).drop("g")
    p = Protocol(folds=3, seed=42)
    errors, labels, missing, fold = _brute_inputs(cube, few)
    weighted = brute.evaluate(errors, labels, missing, fold, 3, top_k("Top25Percent", 8))
    rows = pr.evaluate(cube, few, p, wide=True).collect()
    _same_metrics(rows, brute.report(weighted, labels, 3))
    assert all(r["std_weighted_err_flow1"] is None for r in rows if r["label_state"] == "labelled_aware")


def test_moments_of_large_offsets_do_not_cancel():
    rng = np.random.default_rng(1)
    x = 1e8 + rng.standard_normal((4000, 3))
    x[17, 1] = np.nan
    held = None
    for part in np.array_split(x, 37):
        held = ev.add_moments(held, part)
    assert np.allclose(held[0], (~np.isnan(x)).sum(0)) and np.allclose(held[1], np.nanmean(x, axis=0), rtol=1e-14)
    assert np.allclose(np.sqrt(held[2] / (held[0] - 1)), np.nanstd(x, axis=0, ddof=1), rtol=1e-6)


def test_merged_moments_of_large_offsets(spark):
    rng = np.random.default_rng(2)
    x = 1e8 + rng.standard_normal(3000)
    rows = [("g", len(q), float(len(q)), *(float(v[0]) for v in ev.add_moments(None, q[:, None])[1:])) for q in np.array_split(x, 40)]
    df = spark.createDataFrame(rows, "g string, n_points long, n_weighted_err_flow1 double, mean_weighted_err_flow1 double, "
                                     "m2_weighted_err_flow1 double, sabs_weighted_err_flow1 double")
    r = me.error_metrics(me.merge_moments(df, ["g"], ["err_flow1"]), ["err_flow1"], ["g"]).first()
    assert r["n_points"] == 3000 and abs(r["std_weighted_err_flow1"] / x.std(ddof=1) - 1) < 1e-6


# ---------------------------------------------------------------- inputs that must not be cut silently

def test_points_without_cube_row_are_an_error(spark):
    cube, pts = _inputs(spark)
    for call in (lambda c: pr.evaluate(c, pts, Protocol(folds=3, seed=42)),
                 lambda c: pr.sweep(c, pts.drop("fold").withColumn("scenario", F.lit(1)), [1], [3], ["Top3"], Protocol(seed=42))):
        with pytest.raises(ProtocolError, match="no cube row"):
            call(cube.filter("global_index < 250"))
        with pytest.raises(ProtocolError, match="repeat"):
            call(cube.unionByName(cube.filter("global_index = 100")))


def test_only_the_flag_one_is_missing(spark):
    pts = spark.createDataFrame([(1, 0, 0), (2, 0, 2), (3, 0, 1), (4, 0, None), (5, 1, 0)], "global_index long, label int, missing int")
    want = [1, 2, 4, 5]
    for how in ("filter", "anti", "except"):
        assert sorted(r[0] for r in po.drop_missing(pts, how=how).select("global_index").collect()) == want
    assert sorted(r[0] for r in po.usable(pts).select("global_index").collect()) == want
    cube, pts = _inputs(spark)
    odd = pts.withColumn("missing", F.when(F.col("missing") == 1, 1).when(F.col("global_index") % 3 == 0, F.lit(None)).otherwise(7))
    p = Protocol(folds=3, seed=42)
    norm = lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)
    assert norm(pr.evaluate(cube, odd, p).collect()) == norm(pr.evaluate(cube, pts, p).collect())


def test_sweep_checks_its_parameters(spark):
    cube, pts = _inputs(spark)
    scen = pts.drop("fold").withColumn("scenario", F.lit(1))
    ok = {"scenario_ids": [1], "fold_counts": [3], "modes": ["Top3"], "p": Protocol(seed=42)}
    for bad in ({"fold_counts": [1, 3]}, {"fold_counts": [12]}, {"fold_counts": []}, {"modes": ["Top7"]}, {"modes": ["TopXPercent"]},
                {"modes": ["TopXPercent"], "fraction": 1.5}, {"scenario_ids": []}):
        with pytest.raises(ProtocolError):
            pr.sweep(cube, scen, **{**ok, **bad})
    with pytest.raises(ProtocolError, match="no cube"):
        pr.sweep({"a": cube}, scen, cube_of={2: "a"}, **ok)


def test_mode_column_without_meaning_is_an_error(spark):
    rows = [(m, 1, "merged", c, 10 - c) for m in ("All", "TopXPercent") for c in range(4)]
    df = spark.createDataFrame(rows, "mode string, fold int, state string, config_index int, score_flow1 bigint")
    keys = ("mode", "fold", "state")
    fine = we.make_weights(df, ["err_flow1"], F.col("mode"), 0.5, keys=keys).collect()
    assert {m: sum(r["weight_flow1"] > 0 for r in fine if r["mode"] == m) for m in ("All", "TopXPercent")} == {"All": 3, "TopXPercent": 2}
    for bad, fraction in ((df, None), (df.withColumn("mode", F.lit("Top7")), 0.5), (df.withColumn("mode", F.lit(None).cast("string")), 0.5)):
        with pytest.raises(Exception, match="undefined top-k mode"):
            we.make_weights(bad, ["err_flow1"], F.col("mode"), fraction, keys=keys).collect()


def test_weight_vectors_are_measured_before_they_are_collected(spark):
    with pytest.raises(ProtocolError, match="weight vectors take"):
        ev.collect_weights(spark.range(1), 20_000, 320)


def test_sweep_over_two_cubes_equals_two_sweeps(spark):
    cube, other = st.b_cube(spark, SF_SMALL), st.b_cube_shifted(spark, SF_SMALL)
    scen = st.b_scenario_points(spark, SF_SMALL)
    args = ([2], ["Top3"], Protocol(seed=42))
    norm = lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)
    both = pr.sweep({"a": cube, "b": other}, scen, [1, 3], *args, cube_of={1: "a", 3: "b"}).collect()
    assert norm(both) == norm(pr.sweep(cube, scen, [1], *args).collect() + pr.sweep(other, scen, [3], *args).collect())


def test_task_sums_add_up_over_batches(spark):
    """Several Arrow batches per task give one block of sums, equal to single-row batches' sums."""
    cube, pts = _inputs(spark)
    key = ["fold", "label", "config_index"]
    want = sorted(map(tuple, sc.fold_sums(cube, pts).select(*key, "n_points", *S).collect()))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        keyed = sc.scoring_rows(cube, pts).coalesce(1)
        got = sorted(map(tuple, sc.membership_sums(keyed).select(*key, "n_points", *S).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == want
