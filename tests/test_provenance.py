"""Score cache keyed by content, cube tables with provenance, run manifests, shipping."""

import os
import subprocess
import sys
import tempfile
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from condfuse.functions.columns import MEASURES
from condfuse.model import Protocol
from condfuse.operators import folds as fo
from condfuse.operators import scoring as sc
from condfuse.plans import cli
from condfuse.plans import protocol as pr
from condfuse.session import shared_dir
from condfuse.sources import binary as bi
from condfuse.sources import cube as cu
from condfuse.sources import provenance as pv
from condfuse.sources import sinks as sk
from condfuse.sources import standins as st
from condfuse.sources.configs import SCENARIOS
from tests.conftest import ROOT, SF_SMALL

P = Protocol(folds=3, seed=42)


def cube_file(n=60, n_config=4, seed=0, folder=None, name="cube.bin"):
    folder = folder or tempfile.mkdtemp(prefix="condfuse-cube-")
    path = os.path.join(folder, name)
    np.random.default_rng(seed).normal(size=(n, n_config, 8)).astype(np.float32).tofile(path)
    return path


def some_points(spark, n=60, flip=False):
    rows = [(k, int(k % 3 == 0) ^ int(flip), 0) for k in range(n)]
    return fo.stratified_folds(spark.createDataFrame(rows, "global_index long, label int, missing int"), 3, 42)


def weights(df):
    return sorted((r["fold"], r["state"], r["config_index"], r["score_flow1"], r["weight_flow1"]) for r in df.collect())


# ---------------------------------------------------------------- the score cache


def test_other_data_have_other_keys(spark):
    """Pairs that plan texts cannot tell apart, or only in part."""
    a, b = cube_file(seed=1), cube_file(seed=2)
    ids = list(range(60))
    points = lambda last: st.a_points(spark, SF_SMALL).filter(F.col("global_index").isin([*ids, last]))
    one = bi.read_binary_cube(spark, a, 4)
    pairs = {
        "labels in memory": (some_points(spark), some_points(spark, flip=True)),
        "closure": (st.b_cube_wide(spark, SF_SMALL, 4), st.b_cube_wide(spark, SF_SMALL, 5)),
        "file": (one, bi.read_binary_cube(spark, b, 4)),
        "index range": (one, bi.read_binary_cube(spark, a, 4, start=10, end=50)),
        "derived index range": (one.filter("global_index > 5"), one.filter("global_index > 6")),
        "long list": (points(100), points(101)),
        "measures": (one, bi.read_binary_cube(spark, a, 4, measures=["err_flow1"])),
    }
    for name, (x, y) in pairs.items():
        assert sk.cache_key({}, [x]) != sk.cache_key({}, [y]), name
    assert sk.cache_key({}, [one]) == sk.cache_key({}, [bi.read_binary_cube(spark, a, 4)])
    assert sk.cache_key({}, [some_points(spark)]) == sk.cache_key({}, [some_points(spark).repartition(5)])
    assert sk.cache_key({"order": "raw"}, [one]) != sk.cache_key({"order": "abs"}, [one])


def test_checksum_sees_every_cell(spark):
    rows = [(1, [1.0, None], "a"), (2, [None, 1.0], None), (3, None, "c"), (3, None, "c")]
    shape = "i long, x array<double>, t string"
    base = pv.checksum(spark.createDataFrame(rows, shape))
    assert pv.checksum(spark.createDataFrame(rows[::-1], shape).repartition(3)) == base
    for k, other in enumerate([[(1, [None, 1.0], "a"), *rows[1:]], rows[:3], [*rows, rows[3]], [rows[0], (None, [None, 1.0], None), *rows[2:]],
                               [*rows[:2], (3, [], "c"), rows[3]], [*rows[:3], (3, None, "d")]]):
        assert pv.checksum(spark.createDataFrame(other, shape)) != base, k
    assert pv.checksum(spark.createDataFrame(rows, "i long, y array<double>, t string")) != base
    assert pv.checksum(spark.createDataFrame([], shape)) == pv.checksum(spark.createDataFrame([], shape))


def test_a_step_on_a_read_loses_its_note(spark):
    one = bi.read_binary_cube(spark, cube_file(), 4)
    assert isinstance(pv.source_of(one), bi.CubeFile)
    assert pv.source_of(one.filter("global_index > 3")) is None and pv.source_of(one.select("*")) is None


def test_cached_sums_belong_to_their_data(spark):
    """Flipped labels, another file and another scorer get their own weights; unchanged data hit."""
    cache = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex[:8]}"
    a, b = (bi.read_binary_cube(spark, cube_file(seed=s), 4) for s in (1, 2))
    runs = [(a, some_points(spark), None), (a, some_points(spark, flip=True), None), (b, some_points(spark), None), (a, some_points(spark), np.negative)]
    for k, (cube, points, scorer) in enumerate(runs):
        got = weights(pr.fit_weights(cube, points, P, cache=cache, scorer=scorer))
        assert got == weights(pr.fit_weights(cube, points, P, scorer=scorer))
        assert len(os.listdir(cache)) == k + 1
    stamps = {d: os.listdir(f"{cache}/{d}") for d in os.listdir(cache)}
    for cube, points, scorer in runs:
        pr.fit_weights(cube, points, P, cache=cache, scorer=scorer)
    assert {d: os.listdir(f"{cache}/{d}") for d in os.listdir(cache)} == stamps


def test_a_rewritten_file_misses(spark):
    path = cube_file(seed=3)
    before = sk.cache_key({}, [bi.read_binary_cube(spark, path, 4)])
    time.sleep(0.02)
    cube_file(seed=4, folder=os.path.dirname(path))
    assert sk.cache_key({}, [bi.read_binary_cube(spark, path, 4)]) != before


# ---------------------------------------------------------------- cube tables


def test_every_cube_file_has_its_own_table(spark):
    name = f"kept_{uuid.uuid4().hex[:8]}"
    one, two = (bi.CubeFile(cube_file(seed=s), 4) for s in (5, 6))
    rows = lambda df: sorted((r["global_index"], tuple(r["err_flow1"])) for r in df.collect())
    tables = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith(name)}
    try:
        for file in (one, two, one):
            assert rows(cu.stored_cube(spark, name, file, 3)) == rows(file.frame(spark))
        assert len(tables()) == 2
        files = cu.stored_cube(spark, name, one, 3).inputFiles()
        assert cu.stored_cube(spark, name, one, 3).inputFiles() == files  # read, not written again
        # another bucket count, another file at the same path, and a write that did not end
        assert cu.stored_cube(spark, name, one, 2).inputFiles() != files
        assert rows(cu.stored_cube(spark, name, bi.CubeFile(one.path, 2), 3)) == rows(bi.CubeFile(one.path, 2).frame(spark))
        time.sleep(0.02)
        cube_file(seed=7, folder=os.path.dirname(one.path))
        assert rows(cu.stored_cube(spark, name, one, 3)) == rows(one.frame(spark))
        files = cu.stored_cube(spark, name, one, 3).inputFiles()
        table = f"{name}_{pv.digest([one.path, one.n_config, one.layout])[:12]}"
        spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES ('{cu.VERSION}')")
        assert cu.stored_cube(spark, name, one, 3).inputFiles() != files
        assert isinstance(pv.source_of(cu.stored_cube(spark, name, one, 3)), pv.TableVersion)
    finally:
        for t in tables():
            spark.sql(f"DROP TABLE {t}")


def test_two_methods_with_one_cube_table(spark):
    """Methods 0 and 6 read different cube files; one --cube-table serves both."""
    d, name = tempfile.mkdtemp(prefix="condfuse-two-"), f"both_{uuid.uuid4().hex[:8]}"
    n = 12 * 24
    for seed, method in enumerate((0, 6)):
        cube_file(n, 4, seed, d, SCENARIOS[method][1])
        np.save(os.path.join(d, SCENARIOS[method][2]), (np.arange(n) % 5 == 0).astype(np.int64))
    np.save(os.path.join(d, "missing.npy"), (np.arange(n) % 37 == 0).astype(np.int64))
    args = ["--cube-dir", d, "--flag-dir", d, "--missing-flags", f"{d}/missing.npy", "--out", f"{d}/out", "--n-config", "4", "--days", "12", "--per-day", "24", "--no-predictions"]
    try:
        for method in ("0", "6"):
            reports = []
            for extra in ([], ["--cube-table", name]):
                out = cli.run(spark, cli.parse(["3", method, "0", "0", "0", *args, *extra]))
                reports.append(sorted(tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in spark.read.parquet(f"{out}/results_of_all_folds").collect()))
            assert reports[0] == reports[1]
        found = sk.complete_runs(spark, f"{d}/out")
        assert len(found) == 4 == len({r["started"] for r in found.values()})
        assert {r["anomaly_method"] for r in found.values()} == {SCENARIOS[0][0], SCENARIOS[6][0]}
        assert all("results_of_all_folds" in r["outputs"] for r in found.values())
    finally:
        for t in spark.catalog.listTables():
            if t.name.startswith(name):
                spark.sql(f"DROP TABLE {t.name}")


# ---------------------------------------------------------------- runs


def test_runs_of_one_second_and_killed_runs(spark):
    out = tempfile.mkdtemp(prefix="condfuse-runs-")
    assert sk.complete_runs(spark, out) == {}
    one, two, killed = (sk.run_folder(out, [3, 0, 0, 0, 0]) for _ in range(3))
    for k, folder in enumerate((one, two)):
        sk.write_report(spark.range(k + 1), f"{folder}/rows")
        sk.write_manifest(spark, folder, {"rows": k + 1})
    sk.write_report(spark.range(9), f"{killed}/rows")
    found = {k.split(":", 1)[-1].replace("//", "/"): v for k, v in sk.complete_runs(spark, out).items()}
    assert found == {one: {"rows": 1}, two: {"rows": 2}}
    assert [spark.read.parquet(f"{f}/rows").count() for f in (one, two, killed)] == [1, 2, 9]


def test_a_checkout_on_the_driver_is_enough(tmp_path):
    """Workers that cannot import the package run its functions, and report its errors."""
    path = cube_file()
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from condfuse.model import Protocol
from condfuse.operators import folds as fo
from condfuse.plans import protocol as pr
from condfuse.session import local_session
from condfuse.sources import binary as bi
spark = local_session(2, 2)
pts = spark.createDataFrame([(k, int(k % 3 == 0), 0) for k in range(60)], "global_index long, label int, missing int")
cube = bi.read_binary_cube(spark, {path!r}, 4)
assert cube.count() == 60 and pr.evaluate(cube, pts, Protocol(folds=3)).count() == 63
assert pr.evaluate(cube.filter("global_index >= 0"), pts, Protocol(folds=3), scorer=lambda e: -e).count() == 63
try:
    pr.fit_weights(cube, pts, Protocol(folds=3), scorer=lambda e: e[:, :1])
except Exception as e:
    assert "finite scores" in str(e), e
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "done" in done.stdout, done.stderr[-3000:]


def test_sums_of_a_table_version(spark):
    """A table written again with other rows has another version, so cached sums are not reused."""
    name, cache = f"versions_{uuid.uuid4().hex[:8]}", f"{shared_dir(spark)}/cache-{uuid.uuid4().hex[:8]}"
    try:
        got = []
        for seed in (1, 2):
            cu.write_cube(bi.read_binary_cube(spark, cube_file(seed=seed), 4), table=name, buckets=2)
            cube = cu.read_cube(spark, name)
            assert isinstance(pv.source_of(cube), pv.TableVersion)
            got.append(weights(pr.fit_weights(cube, some_points(spark), P, cache=cache)))
            assert got[-1] == weights(pr.fit_weights(cube, some_points(spark), P))
        assert got[0] != got[1] and len(os.listdir(cache)) == 2
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_fold_sums_of_the_seek_join(spark):
    path = cube_file()
    cube = bi.read_binary_cube(spark, path, 4)
    a = sc.fold_sums(cube, some_points(spark)).orderBy("fold", "label", "config_index").collect()
    b = sc.fold_sums(cube.select("*"), some_points(spark)).orderBy("fold", "label", "config_index").collect()
    assert a == b and len(a) == 3 * 2 * 4 and MEASURES
