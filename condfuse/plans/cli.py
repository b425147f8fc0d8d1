"""Command-line run of the protocol on the reference's own file layout.

    python -m condfuse.plans.cli CV_FOLD_NR ANOMALY_METHOD SCORE_METHOD SEARCHABLE TOP_MODE [X] \
        --cube-dir DIR --flag-dir DIR --missing-flags FILE --out DIR

The anomaly method id picks the cube file and the anomaly flag file from
the scenario catalog; both are read through the Spark data sources in
``sources.binary``. Every run has a folder of its own, ``--out/<run name>-<id>/``:

* ``results_of_all_folds`` and ``avg_results_of_all_folds`` (the latter also as CSV),
* ``running_average``: the average after each fold,
* ``predictions`` with ``param_string`` (unless ``--no-predictions``),
* ``weights`` per training set (with ``--weights``),
* ``manifest``, written last: arguments, inputs and outputs. A folder without
  it is of a run that goes on or was killed (``sinks.complete_runs`` lists the others).

``--align last_rank`` gives the reference's own result. The cube file is read
by seeking to the blocks of the usable points. ``--cube-table`` names
bucketed tables to read instead: a file is written to its own one, once, and
again when the file has changed. ``--cache`` names a folder for score sums
that later runs can reuse.
"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condfuse.model import SCORE_METHODS, SEARCHABLE_METHODS, TOP_MODES, Protocol, ProtocolError
from condfuse.operators import metrics as me
from condfuse.operators.evaluate import prediction_table
from condfuse.operators.points import prepare_points
from condfuse.plans import protocol as pr
from condfuse.sources import binary as bi
from condfuse.sources import cube as cu
from condfuse.sources import sinks
from condfuse.sources.configs import SCENARIOS

# Time layout and config count of the protocol's cube.
DAYS = 406
PER_DAY = 288
N_CONFIG = 320
MAX_HORIZON = 8


def parse(argv=None) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="condfuse", description=__doc__.splitlines()[0])
    ap.add_argument("cv_fold_nr", type=int, nargs="?", default=3)
    ap.add_argument("anomaly_method_int", type=int, nargs="?", default=0)
    ap.add_argument("score_method_int", type=int, nargs="?", default=0)
    ap.add_argument("searchable_method_int", type=int, nargs="?", default=0)
    ap.add_argument("top_tuple_method_int", type=int, nargs="?", default=0)
    ap.add_argument("top_tuple_percentage", type=float, nargs="?", default=None)
    ap.add_argument("--cube-dir", required=True)
    ap.add_argument("--flag-dir", required=True)
    ap.add_argument("--missing-flags", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--n-config", type=int, default=N_CONFIG)
    ap.add_argument("--days", type=int, default=DAYS)
    ap.add_argument("--per-day", type=int, default=PER_DAY)
    ap.add_argument("--align", choices=("config", "last_rank"), default="config")
    ap.add_argument("--order", choices=("raw", "abs"), default="raw")
    ap.add_argument("--no-predictions", action="store_true")
    ap.add_argument("--weights", action="store_true")
    ap.add_argument("--cube-table")
    ap.add_argument("--cache")
    return ap.parse_args(argv)


def protocol_of(a: argparse.Namespace) -> Protocol:
    for value, known, what in ((a.anomaly_method_int, SCENARIOS, "anomaly method"), (a.score_method_int, SCORE_METHODS, "score method"),
                               (a.searchable_method_int, SEARCHABLE_METHODS, "searchable method"), (a.top_tuple_method_int, TOP_MODES, "top tuple method")):
        if value not in known:
            raise ProtocolError(f"unknown {what} id {value}")
    return Protocol(folds=a.cv_fold_nr, seed=0, mode=TOP_MODES[a.top_tuple_method_int], fraction=a.top_tuple_percentage,
                    score_method=SCORE_METHODS[a.score_method_int], align=a.align, order=a.order)


def read_cube(spark: SparkSession, a: argparse.Namespace, path: str) -> DataFrame:
    """The cube file, read by seeking, or its bucketed table (see ``stored_cube``)."""
    file = bi.CubeFile(path, a.n_config)
    return cu.stored_cube(spark, a.cube_table, file) if a.cube_table else file.frame(spark)


def read_points(spark: SparkSession, a: argparse.Namespace, flag_path: str) -> DataFrame:
    """Point table from the two flag vectors, read side by side; both must cover all days."""
    need = a.days * a.per_day
    lengths = {path: bi.vector_length(path) for path in (a.missing_flags, flag_path)}
    for path, n in lengths.items():
        if n < need:
            raise ProtocolError(f"{path} has {n} flags, fewer than {a.days} days x {a.per_day}")
    flags = bi.read_vectors(spark, {"missing": a.missing_flags, "label": flag_path}, end=need)
    # trim, missing -> label 3 and the last-day mask happen in prepare_points, in the protocol's order
    return prepare_points(flags, a.per_day + MAX_HORIZON, per_day=a.per_day, n_days=a.days,
                          vector_length=lengths[a.missing_flags])


def run(spark: SparkSession, a: argparse.Namespace) -> str:
    p = protocol_of(a)
    started = datetime.now(timezone.utc)
    method, cube_file, flag_file = SCENARIOS[a.anomaly_method_int]
    cube_path, flag_path = f"{a.cube_dir.rstrip('/')}/{cube_file}", f"{a.flag_dir.rstrip('/')}/{flag_file}"
    cube = read_cube(spark, a, cube_path)
    params = [a.cv_fold_nr, a.anomaly_method_int, a.score_method_int, a.searchable_method_int, a.top_tuple_method_int]
    params += [a.top_tuple_percentage] if a.top_tuple_percentage is not None else []
    out = sinks.run_folder(a.out, params)
    folded = pr.with_folds(read_points(spark, a, flag_path), p)
    points = sinks.materialize(lambda: folded)

    weights = sinks.materialize(lambda: pr.fit_weights(cube, points, p, cache=a.cache, sources=(cube_path, flag_path, a.missing_flags)))
    written = []

    def write(df: DataFrame, name: str, *how, **options) -> None:
        sinks.write_report(df, f"{out}/{name}", *how, **options)
        written.append(name)

    if a.weights:
        write(weights, "weights")
    # the fit has checked that every point has its cube row
    keyed, table = pr.test_inputs(cube, points, weights, p)
    if a.no_predictions:
        moments = pr.error_moments(keyed, table, p.measures)
    else:
        # the test pass runs once: its errors are written, and the metrics are taken from them
        write(pr.weighted_errors(keyed, table, p.measures), "test_errors")
        errors = spark.read.parquet(f"{out}/test_errors")
        write(prediction_table(errors, p.measures, params=params), "predictions")
        moments = me.moments_of(errors, p.measures)
    names = {"anomaly_method": F.lit(method), "score_method": F.lit(p.score_method), "top_tuple_method": F.lit(p.mode)}
    write(pr.metrics_of(moments, p).withColumns(names), "results_of_all_folds")
    per_fold = spark.read.parquet(f"{out}/results_of_all_folds").drop(*names)
    write(me.running_fold_average(per_fold), "running_average", single_file=True)
    summary = me.summary(me.fold_average(per_fold), method, p.score_method, p.mode)
    write(summary, "avg_results_of_all_folds", single_file=True)
    write(spark.read.parquet(f"{out}/avg_results_of_all_folds"), "avg_results_of_all_folds_csv", "csv", single_file=True)
    sinks.write_manifest(spark, out, {
        "arguments": vars(a), "params": params, "anomaly_method": method, "outputs": written, "started": started.isoformat(),
        "finished": datetime.now(timezone.utc).isoformat(), "cube": bi.CubeFile(cube_path, a.n_config).identity(),
        "flags": {path: bi.file_info(path) for path in (flag_path, a.missing_flags)}})
    return out


def main(argv=None) -> None:
    a = parse(argv)
    spark = SparkSession.builder.appName("condfuse").getOrCreate()
    out = run(spark, a)
    print(sinks.report_csv(spark.read.parquet(f"{out}/avg_results_of_all_folds"), ["label", "metric"]))


if __name__ == "__main__":
    main()
