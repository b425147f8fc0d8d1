"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. The cubes (stand-in B over ``orders``: 32 configs, and
320 configs, the protocol's own shape) are written first, untimed, once as a
plain Parquet folder and once as a bucketed table. The headline lines read the
bucketed cube, which is never shuffled; ``plain_*`` lines read the plain one,
which each pass shuffles by its index. Timing covers building the plan and
running it: evaluations run their ranking job while they are built.
``points`` is the number of points ranked and tested: every order.

The files take about 4 GB at sf0.1, in the session's shared folder.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from condfuse.model import Protocol  # noqa: E402
from condfuse.operators import folds as fo  # noqa: E402
from condfuse.operators import points as po  # noqa: E402
from condfuse.operators import scoring as sc  # noqa: E402
from condfuse.plans import protocol as pr  # noqa: E402
from condfuse.plans.registry import QUERIES  # noqa: E402
from condfuse.session import local_session, shared_dir  # noqa: E402
from condfuse.sources import cube as cu  # noqa: E402
from condfuse.sources import standins as st  # noqa: E402


def timed(fn):
    t = time.time()
    fn()
    return round(time.time() - t, 3)


def run(build):
    """Builds and runs a query (building belongs in the timing)."""
    return lambda: build().write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, checkpoint=tempfile.mkdtemp(prefix="condfuse-bench-"))
    base = f"{shared_dir(spark)}/bench-{uuid.uuid4().hex[:8]}"
    p = Protocol(folds=3, seed=42)
    pts = fo.stratified_folds(st.b_points(spark, sf_dir), 3, 42)
    n_points = po.usable(pts).count()
    setup, plain, bucketed = {}, {}, {}
    for n in (32, 320):
        def cube(n=n):
            return st.b_cube_wide(spark, sf_dir, n)

        setup[f"write_plain_b{n}"] = timed(lambda: cu.write_cube(cube(), f"{base}/plain_b{n}"))
        buckets = max(int(cpus), cu.bucket_count(n_points, n))
        setup[f"write_bucketed_b{n}"] = timed(lambda: cu.write_cube(cube(), f"{base}/bucketed_b{n}", table=f"bench_b{n}", buckets=buckets))
        plain[n], bucketed[n] = cu.read_cube(spark, f"{base}/plain_b{n}"), spark.table(f"bench_b{n}")

    # warm-up (JVM, Python workers, codegen), untimed
    run(lambda: pr.evaluate(bucketed[32], pts, p))()

    scen = st.b_scenario_points(spark, sf_dir)
    q = {}
    for n in (32, 320):
        # scoring only (rank every point, sum per fold/label/config), as in BASELINE's own probe
        for cube in (bucketed[n], plain[n]):  # files of each cube are read once before any timing
            run(lambda cube=cube: sc.fold_sums(cube, pts))()
        q[f"score_b{n}"] = statistics.median(timed(run(lambda: sc.fold_sums(bucketed[n], pts))) for _ in range(3))
        q[f"cv_b{n}"] = timed(run(lambda: pr.evaluate(bucketed[n], pts, p)))
        q[f"plain_score_b{n}"] = statistics.median(timed(run(lambda: sc.fold_sums(plain[n], pts))) for _ in range(3))
        q[f"plain_cv_b{n}"] = timed(run(lambda: pr.evaluate(plain[n], pts, p)))
    sweep = ([1, 2, 3], [2, 3], ["Top25Percent", "Top3", "All"], p)
    q["sweep_b32"] = timed(run(lambda: pr.sweep(bucketed[32], scen, *sweep)))
    q["plain_sweep_b32"] = timed(run(lambda: pr.sweep(plain[32], scen, *sweep)))
    for name in ("condition_aware_cv", "scenario_sweep", "topk_weights_top25pct", "metrics_long", "rank_scores"):
        q[name] = timed(run(lambda name=name: QUERIES[name](spark, sf_dir)))
    for n in (32, 320):
        spark.sql(f"DROP TABLE IF EXISTS bench_b{n}")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(q.values()), 3), "unit": "sec", "queries": q,
                      "setup": setup, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": int(cpus),
                      "points": n_points}))
    spark.stop()


if __name__ == "__main__":
    main()
