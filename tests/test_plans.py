"""Plan-shape guards for the scale design (checked on the physical plan)."""

import os

from pyspark.sql import functions as F

from condfuse.model import Protocol
from condfuse.operators import folds as fo
from condfuse.operators import scoring as sc
from condfuse.plans import protocol as pr
from condfuse.session import shared_dir
from condfuse.sources import cube as cu
from condfuse.sources import standins as st
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _parquet_cube(spark):
    path = f"{shared_dir(spark)}/plans-cube-{os.getpid()}"
    cu.write_cube(st.b_cube(spark, SF_SMALL), path)
    return path


def _above(plan: str, scan: str) -> list[str]:
    """Operators between each scan of ``scan`` and the next join above it."""
    lines = plan.splitlines()
    out = []
    for i, line in enumerate(lines):
        if "FileScan parquet" in line and scan in line:
            above = []
            for up in reversed(lines[:i]):
                if "Join" in up:
                    break
                above.append(up.strip())
            out.append(" ".join(above))
    return out


def test_stored_cube_is_never_shuffled_or_broadcast(spark):
    """Both passes of evaluate and sweep read a bucketed cube in place."""
    table = "plans_bucketed"
    cu.write_cube(st.b_cube(spark, SF_SMALL), table=table, buckets=4)
    try:
        cube = cu.read_cube(spark, table)
        pts = fo.stratified_folds(st.b_points(spark, SF_SMALL), 3, 42)
        p = Protocol(folds=3, seed=42)
        plans = [_plan(sc.fold_sums(cube, pts)), _plan(pr.evaluate(cube, pts, p)),
                 _plan(pr.sweep(cube, st.b_scenario_points(spark, SF_SMALL), [1, 2], [2, 3], ["Top3"], p))]
        for plan in plans:
            assert plan.count("MapInArrow") == 1
            assert "ShuffledHashJoin" in plan
            found = _above(plan, table)
            assert found and not any("Exchange" in up for up in found), plan
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_test_pass_has_no_point_level_states(spark):
    """No generator above the test pass but on the merged moments, and no array lambdas."""
    path = _parquet_cube(spark)
    pts = fo.stratified_folds(st.b_points(spark, SF_SMALL), 3, 42)
    plan = _plan(pr.evaluate(cu.read_cube(spark, path), pts, Protocol(folds=3, seed=42)))
    assert "lambda" not in plan and "ArrowEvalPython" not in plan
    body = plan[:plan.index("MapInArrow")]
    assert body.index("Generate") < body.rindex("Aggregate")  # states come after the first merge of moments


def test_measure_subset_prunes_the_cube_scan(spark):
    path = _parquet_cube(spark)
    pts = fo.stratified_folds(st.b_points(spark, SF_SMALL), 3, 42)
    p = Protocol(folds=3, seed=42, measures=("err_flow1", "err_speed8"))
    plan = _plan(sc.fold_sums(cu.read_cube(spark, path), pts, p.measures))
    schemas = [ln[ln.find("ReadSchema"):] for ln in plan.splitlines() if "plans-cube" in ln and "ReadSchema" in ln]
    assert schemas and all("err_flow2" not in sch and "err_flow1" in sch for sch in schemas), schemas


def test_index_filter_reaches_the_parquet_scan(spark):
    path = _parquet_cube(spark)
    plan = _plan(cu.read_cube(spark, path).filter(F.col("global_index").between(100, 199)))
    assert "PushedFilters: [IsNotNull(global_index), GreaterThanOrEqual(global_index,100)" in plan, plan


def test_trimmed_points_are_not_read_from_the_cube(spark):
    path = _parquet_cube(spark)
    pts = fo.stratified_folds(st.b_points(spark, SF_SMALL).filter(F.col("global_index").between(300, 799)), 3, 42)
    plan = _plan(pr.evaluate(cu.read_cube(spark, path), pts, Protocol(folds=3, seed=42)))
    assert "GreaterThanOrEqual(global_index,300)" in plan and "LessThanOrEqual(global_index,799)" in plan


def test_built_cube_is_built_behind_the_join(spark):
    """Both passes shuffle narrow rows; the arrays are built in the task that uses them."""
    cube, pts = st.b_cube_shifted(spark, SF_SMALL), fo.stratified_folds(st.b_points(spark, SF_SMALL), 3, 42)
    p = Protocol(folds=3, seed=42)
    for df in (sc.fold_sums(sc.index_range(cube, pts), pts), pr.evaluate(cube, pts, p),
               pr.sweep(cube, st.b_scenario_points(spark, SF_SMALL), [1, 2], [2, 3], ["Top3"], p)):
        lines = _plan(df).splitlines()
        used, built = [i for i, line in enumerate(lines) if "MapInArrow" in line]
        assert not any("Exchange" in line or "Join" in line for line in lines[used + 1:built]), lines
        assert any("ShuffledHashJoin" in line for line in lines[built + 1:])


def test_built_cube_gives_the_rows_of_a_join(spark):
    """Repeated keys, null keys and null values, built in several pieces."""
    orders = spark.createDataFrame([(5, "F"), (5, "O"), (9, None), (None, "F"), (700001, "F")], "o_orderkey long, o_orderstatus string")
    cube = st.b_cube_from(orders, n_config=40)
    points = spark.createDataFrame([(5, 1), (9, 2), (9, 3), (10, 4)], "global_index long, tag int")
    limit, cu.BUILT_BYTES = cu.BUILT_BYTES, 4 * 40 * 8 * 2
    try:
        found = cu.source_of(cube).joined(points).select("global_index", "tag", *cube.columns[1:])
        assert sorted(found.collect()) == sorted(cube.join(points, "global_index").select(*found.columns).collect())
        assert [r[0] for r in found.select("global_index").orderBy("global_index").collect()] == [5, 5, 9, 9]
        row = found.filter("global_index = 9 AND tag = 2").first()
        for j, m in enumerate(cube.columns[1:]):
            assert all(abs(row[m][c] - (9 * (c + 7) * (j + 3) % 1009 / 1009 + 0.01 * c)) < 1e-6 for c in range(40))
        back = st.b_cube_from(orders, n_config=40, backwards=True)
        want = cube.select("global_index", *[F.reverse(m).alias(m) for m in cube.columns[1:]])
        assert sorted(back.dropna().collect()) == sorted(want.dropna().collect())
        assert cu.config_count(back, cube.columns[1]) == 40
    finally:
        cu.BUILT_BYTES = limit
