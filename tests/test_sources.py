import os
import tempfile
import time
import uuid
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from condfuse.functions.columns import MEASURES, weighted_cols
from condfuse.model import Protocol, ProtocolError
from condfuse.operators import folds as fo
from condfuse.operators.validate import validate_inputs
from condfuse.plans import cli
from condfuse.plans import protocol as pr
from condfuse.session import shared_dir
from condfuse.sources import binary as bi
from condfuse.sources import cube as cu
from condfuse.sources import sinks as sk
from condfuse.sources import standins as st
from condfuse.sources.configs import SCENARIOS, config_grid, read_configs, scenarios
from tests import brute
from tests.conftest import SF_SMALL

O = weighted_cols(MEASURES)


def _scratch(spark, name):
    return f"{shared_dir(spark)}/tests-{name}-{os.getpid()}"


def _local(spark, name):
    d = tempfile.mkdtemp(prefix=f"condfuse-{name}-")
    return d


def _binary_cube(spark, name="bin", n=None):
    cube = st.a_cube(spark, SF_SMALL)
    rows = sorted(cube.collect(), key=lambda r: r["global_index"])[:n]
    block = np.stack([np.stack([np.array(r[m], dtype=np.float32) for m in MEASURES], axis=1) for r in rows])
    path = os.path.join(_local(spark, name), "cube.bin")
    block.astype(np.float32).tofile(path)
    return cube, rows, path


def test_binary_cube_roundtrip(spark):
    cube, rows, path = _binary_cube(spark)
    stride = 8 * len(MEASURES) * 4
    b = bi.read_binary_cube(spark, path, 8, partition_bytes=64 * stride)
    assert b.rdd.getNumPartitions() == -(-len(rows) // 64)
    got = {r["global_index"]: r for r in b.collect()}
    assert len(got) == len(rows)
    for r in rows:
        for m in MEASURES:
            assert np.allclose(got[r["global_index"]][m], r[m])
    same = bi.read_binary_cube(spark, f"file://{path}", 8)
    assert same.exceptAll(b).count() == 0 and same.count() == len(rows)
    # the binary source feeds the protocol like any cube
    pts = fo.stratified_folds(st.a_points(spark, SF_SMALL), 3, 42)
    p = Protocol(folds=3, seed=42)
    a = pr.evaluate(b, pts, p).orderBy("cv_fold_order", "label", "metric").collect()
    c = pr.evaluate(cube, pts, p).orderBy("cv_fold_order", "label", "metric").collect()
    assert [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in a] == \
        [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in c]


def test_binary_reads_do_not_leak_into_each_other(spark):
    _, _, path = _binary_cube(spark, n=100)
    b = bi.read_binary_cube(spark, path, 8)
    gi = F.col("global_index")
    counts = [b.filter(gi == 1).count(), b.count(), b.filter(gi < 10).count(), b.count(), b.filter(gi >= 90).count(), b.count()]
    assert counts == [1, 100, 10, 100, 10, 100]
    part = bi.read_binary_cube(spark, path, 8, start=20, end=30)
    assert [part.count(), part.agg(F.min("global_index")).first()[0], b.count()] == [10, 20, 100]
    vec = os.path.join(_local(spark, "leak"), "v.npy")
    np.save(vec, np.arange(50))
    f = bi.read_flags(spark, vec, column="missing")
    assert [f.filter(gi < 5).count(), f.count(), f.filter(F.col("missing") == 7).count(), f.count()] == [5, 50, 1, 50]


def test_binary_measure_subset_keeps_the_layout(spark):
    _, rows, path = _binary_cube(spark, n=100)
    two = bi.read_binary_cube(spark, path, 8, measures=["err_speed8", "err_flow1"])
    got = {r["global_index"]: r for r in two.collect()}
    assert len(got) == 100 and two.columns == ["global_index", "err_speed8", "err_flow1"]
    assert all(np.allclose(got[r["global_index"]][m], r[m]) for r in rows for m in ("err_speed8", "err_flow1"))
    assert bi.read_binary_cube(spark, path, 8, measures=[]).columns == ["global_index"]
    with pytest.raises(Exception, match="no measures"):
        bi.read_binary_cube(spark, path, 8, measures=["err_flow3"]).count()


def test_binary_length_must_fit_the_layout(spark):
    _, _, path = _binary_cube(spark, n=100)
    with pytest.raises(Exception, match="not a multiple"):
        bi.read_binary_cube(spark, path, 7).count()
    with open(path, "r+b") as f:
        f.truncate(os.path.getsize(path) - 10)
    with pytest.raises(Exception, match="not a multiple"):
        bi.read_binary_cube(spark, path, 8).count()
    with pytest.raises(Exception, match="outside the file"):
        bi.read_flags(spark, _raw_flags(spark), end=11).count()


def _raw_flags(spark):
    path = os.path.join(_local(spark, "raw"), "flags.bin")
    np.arange(10, dtype=np.int32).tofile(path)
    return path


def test_flag_vectors(spark):
    path = os.path.join(_local(spark, "npy"), "flags.npy")
    vec = (np.arange(1000) % 7 == 0).astype(np.int64)
    np.save(path, vec)
    df = bi.read_flags(spark, path, column="missing")
    assert df.count() == 1000 == bi.vector_length(path)
    assert df.agg(F.sum("missing")).first()[0] == int(vec.sum())
    assert df.filter(F.col("global_index") == 14).first()["missing"] == 1
    assert [r["flag"] for r in bi.read_flags(spark, _raw_flags(spark), start=3, end=6).collect()] == [3, 4, 5]
    floats = os.path.join(_local(spark, "npy"), "floats.npy")
    np.save(floats, np.ones(3))
    with pytest.raises(ProtocolError, match="no vector of integers"):
        bi.vector_length(floats)


def test_cube_parquet_roundtrip_and_long_form(spark):
    cube = st.a_cube(spark, SF_SMALL)
    path = _scratch(spark, "cube")
    cu.write_cube(cube, path, files=4)
    back = cu.read_cube(spark, path)
    assert back.exceptAll(cube).count() == 0 and cube.exceptAll(back).count() == 0
    again = cu.long_to_cube(cu.cube_to_long(cube))
    assert again.exceptAll(cube).count() == 0


def test_bucketed_cube_join_does_not_shuffle_cube(spark):
    from condfuse.operators.scoring import scoring_rows

    cube = st.a_cube(spark, SF_SMALL)
    path = _scratch(spark, "bucketed")
    assert cu.bucket_count(116_928, 320) == 5 and cu.bucket_count(10, 8) == 1
    cu.write_cube(cube, path, table="cube_bucketed_test", buckets=8)
    t = spark.table("cube_bucketed_test")
    pts = fo.stratified_folds(st.a_points(spark, SF_SMALL), 3, 42)
    plan = scoring_rows(t, pts)._jdf.queryExecution().executedPlan().toString()
    scan_lines = [ln for ln in plan.splitlines() if "cube_bucketed_test" in ln or "Bucketed: true" in ln]
    assert scan_lines, plan
    # the cube scan is bucketed, so no Exchange sits directly above it
    lines = plan.splitlines()
    for i, ln in enumerate(lines):
        if "FileScan parquet spark_catalog.default.cube_bucketed_test" in ln or "cube_bucketed_test" in ln:
            assert "Exchange" not in lines[i - 1]
    spark.sql("DROP TABLE IF EXISTS cube_bucketed_test")


def test_config_grid_and_scenarios(spark):
    g = config_grid(spark)
    assert g.count() == 320
    r = {x["config_index"]: x for x in g.collect()}
    assert (r[0]["search_step_length"], r[0]["window_size"], r[0]["k_level1"]) == (2, 0, 2)
    assert (r[1]["search_step_length"], r[1]["window_size"], r[1]["k_level1"]) == (2, 0, 4)
    assert (r[319]["search_step_length"], r[319]["window_size"], r[319]["k_level1"]) == (256, 32, 256)
    assert g.select("search_step_length", "window_size", "k_level1").distinct().count() == 320
    sc = scenarios(spark)
    assert sc.count() == 13 and sc.filter("anomaly_method = 'Ground_Truth_Incident'").count() == 2


def test_score_cache(spark):
    base = _scratch(spark, f"cache-{uuid.uuid4().hex[:6]}")
    path = _scratch(spark, f"cached-cube-{uuid.uuid4().hex[:6]}")
    cu.write_cube(st.a_cube(spark, SF_SMALL), path)
    pts = fo.stratified_folds(st.a_points(spark, SF_SMALL), 3, 42)

    def folders():
        return sorted(d for d in os.listdir(base) if not d.startswith("."))

    def report(p, cube=None, points=pts):
        rows = pr.evaluate(cu.read_cube(spark, path) if cube is None else cube, points, p, cache=base).collect()
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)

    first = report(Protocol(folds=3, seed=42))
    assert len(folders()) == 1
    assert report(Protocol(folds=3, seed=42)) == first and len(folders()) == 1
    # another top-k mode and alignment reuse the sums, other points, filters and orders do not
    report(Protocol(folds=3, seed=42, mode="Top3", align="last_rank"))
    assert len(folders()) == 1
    report(Protocol(folds=3, seed=42, order="abs"))
    report(Protocol(folds=3, seed=42), points=pts.filter("global_index > 20"))
    report(Protocol(folds=3, seed=42), cube=cu.read_cube(spark, path).filter("global_index >= 0"))
    assert len(folders()) == 4
    # a folder of a job that failed half-way is never read
    key = f"{base}/{folders()[0]}"
    for k in folders():
        spark.createDataFrame([(1,)], "broken int").write.parquet(f"{base}/{k}/half")
    assert report(Protocol(folds=3, seed=42)) == first
    # data rewritten at the same path miss
    neg = [F.transform(m, lambda x: -x).alias(m) for m in MEASURES]
    cu.write_cube(st.a_cube(spark, SF_SMALL).select("global_index", *neg), path)
    spark.catalog.refreshByPath(path)
    second = report(Protocol(folds=3, seed=42))
    assert len(folders()) == 5 and second != first and key
    assert second == report(Protocol(folds=3, seed=42), cube=st.a_cube(spark, SF_SMALL).select("global_index", *neg))


def test_cache_sees_changed_source_files(spark):
    _, _, path = _binary_cube(spark, n=100)
    cube = bi.read_binary_cube(spark, path, 8)
    key = sk.cache_key({}, [cube], [path])
    assert key == sk.cache_key({}, [bi.read_binary_cube(spark, path, 8)], [path])
    time.sleep(0.02)
    np.zeros(100 * 8 * 8, np.float32).tofile(path)
    assert key != sk.cache_key({}, [cube], [path])


def test_reports(spark):
    cube = st.a_cube(spark, SF_SMALL)
    pts = fo.stratified_folds(st.a_points(spark, SF_SMALL), 3, 42)
    rep = pr.cv_report(cube, pts, Protocol(folds=3, seed=42))
    out = _scratch(spark, "report")
    sk.write_report(rep, out, "csv", single_file=True)
    assert spark.read.option("header", True).csv(out).count() == 21
    assert len([f for f in os.listdir(out) if f.startswith("part-")]) == 1
    txt = sk.report_csv(rep, ["label", "metric"])
    assert txt.splitlines()[0].startswith("label,metric")
    with pytest.raises(ProtocolError, match="more than 5 rows"):
        sk.report_csv(spark.range(6), max_rows=5)


def test_config_table(spark):
    path = _scratch(spark, f"configs-{uuid.uuid4().hex[:6]}")
    config_grid(spark).write.parquet(path)
    assert read_configs(spark, path).count() == 320
    config_grid(spark).limit(1).write.mode("append").parquet(path)
    with pytest.raises(ProtocolError, match="repeats"):
        read_configs(spark, path)


def test_validate_inputs(spark):
    cube = st.a_cube(spark, SF_SMALL)
    pts = st.a_points(spark, SF_SMALL)
    assert validate_inputs(cube, pts, Protocol(folds=3)) == []
    with pytest.raises(ProtocolError):
        validate_inputs(cube.unionByName(cube.limit(1)), pts, Protocol(folds=3))
    with pytest.raises(ProtocolError):
        validate_inputs(cube.filter("global_index > 100"), pts, Protocol(folds=3))
    with pytest.raises(ProtocolError):
        validate_inputs(cube, pts, Protocol(folds=3), min_points=10_000)


def test_run_name():
    when = datetime(2018, 7, 10, 12, tzinfo=timezone.utc)
    assert sk.run_name([3, 2, 0, 0, 1], when) == "run-3-2-0-0-1-20180710T120000Z"
    assert sk.run_name([3]).startswith("run-3-2")


def test_validation_warnings(spark):
    cube = st.a_cube(spark, SF_SMALL)
    pts = st.a_points(spark, SF_SMALL)
    found = validate_inputs(cube.filter("global_index % 50 <> 7"), pts.filter("global_index % 50 <> 7"), Protocol(folds=3))
    assert found == ["the cube index has gaps, the first at 7"]
    with pytest.raises(ProtocolError, match="greater than"):
        validate_inputs(cube, pts.filter("global_index < 10"), Protocol(folds=3))


def _cli_files(spark):
    _, rows, path = _binary_cube(spark, "cli")
    d = os.path.dirname(path)
    _, cube_file, flag_file = SCENARIOS[2]
    os.link(path, os.path.join(d, cube_file))
    gi = np.array([r["global_index"] for r in rows])
    labels = {r["global_index"]: r["label"] for r in st.a_flags(spark, SF_SMALL).collect()}
    np.save(os.path.join(d, flag_file), np.array([labels[g] for g in gi]))
    np.save(os.path.join(d, "missing.npy"), (gi % 37 == 0).astype(np.int64))
    args = ["--cube-dir", d, "--flag-dir", d, "--missing-flags", os.path.join(d, "missing.npy"), "--out", os.path.join(d, "out"),
            "--n-config", "8", "--days", "9", "--per-day", "50"]
    return d, flag_file, args


@pytest.mark.parametrize("extra", [[], ["--align", "last_rank", "--weights", "--cube-table", "cli_cube"],
                                   ["--order", "abs", "--no-predictions", "--cache"]])
def test_cli_against_brute_force(spark, extra):
    d, flag_file, args = _cli_files(spark)
    if "--cache" in extra:
        extra = [*extra, os.path.join(d, "cache")]
    try:
        a = cli.parse(["3", "2", "0", "0", "0", *args, *extra])
        out = cli.run(spark, a)
        points = pr.with_folds(cli.read_points(spark, a, os.path.join(d, flag_file)), Protocol(folds=3, seed=0))
        prow = {r["global_index"]: r for r in points.collect()}
        rows = {r["global_index"]: np.stack([np.array(r[m], dtype=float) for m in MEASURES], axis=1) for r in st.a_cube(spark, SF_SMALL).collect()}
        labels = {g: r["label"] for g, r in prow.items()}
        weighted = brute.evaluate({g: rows[g] for g in prow}, labels, {g: r["missing"] for g, r in prow.items()},
                                  {g: r["fold"] for g, r in prow.items()}, 3, 2, a.align, a.order)
        want = brute.report(weighted, labels, 3)
        got = {(r["cv_fold_order"], r["label"], r["metric"]): r for r in spark.read.parquet(f"{out}/results_of_all_folds").collect()}
        assert len(got) == 63
        for (f, state), (_, avg, std, mae) in want.items():
            for metric, x in (("AVG", avg), ("STD", std), ("MAE", mae)):
                assert np.allclose([got[(f, state, metric)][c] for c in O], x, atol=1e-9)
        summary = spark.read.parquet(f"{out}/avg_results_of_all_folds")
        assert summary.count() == 21 and summary.first()["anomaly_method"] == "Ground_Truth_Incident"
        assert spark.read.option("header", True).csv(f"{out}/avg_results_of_all_folds_csv").count() == 21
        run = spark.read.parquet(f"{out}/running_average")
        assert run.count() == 63
        last = {(r["label"], r["metric"]): r[O[0]] for r in run.filter("cv_fold_order = 3").collect()}
        assert all(abs(last[(r["label"], r["metric"])] - r[O[0]]) < 1e-12 for r in summary.collect())
        if "--no-predictions" in extra:
            assert not os.path.exists(f"{out}/predictions")
        else:
            pred = spark.read.parquet(f"{out}/predictions").collect()
            assert len(pred) == len(weighted) and {r["param_string"] for r in pred} == {"3_2_0_0_0"}
            state = {("own", 1): "labelled_aware", ("own", 0): "non_labelled_aware", ("merged", 1): "labelled_unaware", ("merged", 0): "non_labelled_unaware"}
            table = {(r["fold"], r["test_index"], r["label_state"]): r for r in pred}
            for (f, g, kind), v in weighted.items():
                assert np.allclose([table[(f, g, state[(kind, labels[g])])][c] for c in O], v, atol=1e-9)
        assert os.path.exists(f"{out}/weights") == ("--weights" in extra)
    finally:
        spark.sql("DROP TABLE IF EXISTS cli_cube")


def test_cli_rejects_bad_inputs(spark):
    d, flag_file, args = _cli_files(spark)
    with pytest.raises(ProtocolError, match="unknown anomaly"):
        cli.run(spark, cli.parse(["3", "99", *args]))
    flags = np.load(os.path.join(d, flag_file))
    np.save(os.path.join(d, flag_file), flags[:449])
    with pytest.raises(ProtocolError, match="449 flags, fewer than 9 days x 50"):
        cli.run(spark, cli.parse(["3", "2", "0", "0", "0", *args]))
