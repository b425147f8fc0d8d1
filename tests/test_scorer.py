"""Scorers of the user's own in place of the rank."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from condfuse.functions.columns import MEASURES, score_cols, weight_cols
from condfuse.model import Protocol
from condfuse.operators import folds as fo
from condfuse.operators import scoring as sc
from condfuse.operators import weights as we
from condfuse.plans import protocol as pr
from condfuse.sources import standins as st
from tests.conftest import SF_SMALL

S, W = score_cols(MEASURES), weight_cols(MEASURES)
P = Protocol(folds=3, seed=42)


def linear_rank(errors):
    """The built-in rank, written as a scorer."""
    order = np.argsort(errors, axis=1, kind="stable")
    out = np.empty(errors.shape)
    np.put_along_axis(out, order, np.arange(errors.shape[1] - 1, -1, -1.0)[None, :], axis=1)
    return out


def closeness(errors):
    return 1.0 / (1.0 + np.nan_to_num(errors.astype(np.float64), nan=1e6) ** 2)


@pytest.fixture(scope="module")
def inputs(spark):
    return st.a_cube(spark, SF_SMALL), fo.stratified_folds(st.a_points(spark, SF_SMALL), 3, 42)


def table(df, cols):
    return {(r["fold"], r["state"], r["config_index"]): [r[c] for c in cols] for r in df.collect()}


def test_the_linear_rank_as_a_scorer_is_the_built_in_one(inputs):
    cube, pts = inputs
    for order in ("raw", "abs"):
        p = Protocol(folds=3, seed=42, order=order)
        want, got = table(pr.fit_weights(cube, pts, p), S + W), table(pr.fit_weights(cube, pts, p, scorer=linear_rank), S + W)
        assert want.keys() == got.keys() and all(got[k] == want[k] for k in want)


@pytest.mark.parametrize("mode", ["All", "Top3"])
def test_a_scorer_that_is_no_rank_against_a_loop(inputs, mode):
    cube, pts = inputs
    errors = {r["global_index"]: [np.array(r[m], np.float32) for m in MEASURES] for r in cube.collect()}
    rows = [r for r in pts.collect() if r["label"] in (0, 1) and r["missing"] != 1]
    got = table(pr.fit_weights(cube, pts, Protocol(folds=3, seed=42, mode=mode), scorer=closeness), W)
    for fold in (1, 2, 3):
        for state, labels in (("labelled", {1}), ("non_labelled", {0}), ("merged", {0, 1})):
            train = [r["global_index"] for r in rows if r["fold"] != fold and r["label"] in labels]
            for j in range(len(MEASURES)):
                sums = [sum(float(closeness(errors[g][j][None, :])[0, c]) for g in train) for c in range(8)]
                shifted = [x - min(sums) for x in sums]
                kept = sorted(range(8), key=lambda c: (-shifted[c], c))[:3 if mode == "Top3" else 8]
                total = sum(shifted[c] for c in kept)
                for c in range(8):
                    assert got[fold, state, c][j] == pytest.approx(shifted[c] / total if c in kept else 0.0, abs=1e-9)


def test_float_sums_do_not_depend_on_partitioning(spark, inputs):
    cube, pts = inputs
    # one point whose score dwarfs the others: plain sums would lose their digits in some orders
    big = lambda e: closeness(e) * np.where(np.abs(e[:, :1]) < 0.02, 1e12, 1.0)
    runs = [table_sums(sc.fold_sums(c, pts, scorer=big)) for c in (cube.coalesce(1), cube.repartition(7), cube.repartition(3).sortWithinPartitions(F.desc("global_index")))]
    for other in runs[1:]:
        assert other.keys() == runs[0].keys()
        assert all(np.allclose(other[k], runs[0][k], rtol=1e-13) for k in other)


def table_sums(df):
    return {(r["fold"], r["label"], r["config_index"]): [r["n_points"], *[r[s] for s in S]] for r in df.collect()}


def test_sums_keep_what_rounding_loses():
    total, carry = np.zeros(1), np.zeros(1)
    for x in [1e16, *[1.0] * 1000, -1e16]:
        total, carry = sc.add_with_carry(total, carry, np.array([x]))
    assert total + carry == 1000.0


def test_evaluate_and_sweep_with_a_scorer(spark, inputs):
    cube, pts = inputs
    rep = pr.cv_report(cube, pts, P, scorer=closeness)
    assert rep.count() == 21
    scen = st.a_points(spark, SF_SMALL).withColumn("scenario", F.lit(5))
    swept = pr.sweep(cube, scen, [5], [3], ["Top25Percent"], P, scorer=closeness)
    key = lambda r: (r["label"], r["metric"])
    want = {key(r): r["weighted_err_flow1"] for r in rep.collect()}
    assert {key(r): r["weighted_err_flow1"] for r in swept.collect()} == pytest.approx(want, rel=1e-9)
    assert want != pytest.approx({key(r): r["weighted_err_flow1"] for r in pr.cv_report(cube, pts, P).collect()}, rel=1e-6)


@pytest.mark.parametrize("bad", [lambda e: e[:, :2], lambda e: np.full(e.shape, np.nan), lambda e: 1.0])
def test_bad_scorers_are_errors(inputs, bad):
    cube, pts = inputs
    with pytest.raises(Exception, match="finite scores of shape"):
        pr.fit_weights(cube, pts, P, scorer=bad)


def test_float_weights_keep_their_type(spark):
    rows = spark.createDataFrame([(1, "merged", c, 1, 0.25 * c) for c in range(4)], "fold int, state string, config_index int, n_points long, score_flow1 double")
    got = {r["config_index"]: (r["score_flow1"], r["weight_flow1"]) for r in we.make_weights(rows, ("err_flow1",), "Top3").collect()}
    assert got == {0: (0.0, 0.0), 1: (0.25, 1 / 6), 2: (0.5, 2 / 6), 3: (0.75, 3 / 6)}
    assert we.shift_scores(rows, ("err_flow1",)).schema["score_flow1"].dataType.simpleString() == "double"
