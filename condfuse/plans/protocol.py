"""The condition-aware cross-validation protocol.

points -> stratified folds -> ranking pass over the cube (score sums per
fold and class, one small table) -> training sums by fold complement ->
top-k weights -> test pass over the cube (own + merged weights per point,
moments per task) -> seven report states -> AVG/STD/MAE per fold -> fold
average.

The point table with its folds is written once and read by all passes. The
ranking pass is a job of its own: its sums are written to shared storage (and
found there again by a later run with the same inputs, if a cache folder is
given), their point counts are checked against the point table, and the
weight vectors, whose size follows from the parameters, are collected from
them. The test pass then is one lazy plan. A cube in a bucketed table is read
in place by both passes and a cube file by seeking; only the narrow point
table is shuffled.

The ranking pass validates its inputs as it goes: points without a cube row,
repeated cube rows, configs of unequal number and a fold count above every
class are a ``ProtocolError``; gaps of the cube, small classes and empty sets are a
``ProtocolWarning``. No scan is added for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from condfuse.functions.columns import score_cols
from condfuse.model import MAX_FOLDS, MIN_FOLDS, Protocol, ProtocolError, top_k, top_mode_name
from condfuse.operators import evaluate as ev
from condfuse.operators import scoring as sc
from condfuse.operators.evaluate import collect_weights, error_moments, report_states, weighted_errors
from condfuse.operators.folds import fold_of, fold_positions, stratified_folds
from condfuse.operators.metrics import error_metrics, fold_average, metrics_long
from condfuse.operators.scoring import Scorer, check_coverage, check_covered, fold_sums, index_range, scoring_rows, train_sums
from condfuse.operators.validate import CubeWatch, class_notes, warn
from condfuse.operators.weights import make_weights, weight_arrays
from condfuse.sources.cube import config_count
from condfuse.sources.sinks import materialize


def with_folds(points: DataFrame, p: Protocol) -> DataFrame:
    return points if "fold" in points.columns else stratified_folds(points, p.folds, p.seed)


def _scorer_key(scorer: Scorer | None) -> str | None:
    """What the cache knows a scorer by: its code and what that refers to."""
    return None if scorer is None else hashlib.sha256(cloudpickle.dumps(scorer)).hexdigest()


def score_sums(cube: DataFrame, points: DataFrame, p: Protocol, run_cols: Sequence[str] = (),
               cache: str | None = None, sources: Sequence[str] = (), engine: str = "arrow",
               written: DataFrame | None = None, scorer: Scorer | None = None, keys: Column | None = None,
               runs: Sequence = (), k_of: Callable[[Row], int] | None = None) -> DataFrame:
    """Score sums per (run..., fold, label, config) as a written table, checked
    for coverage and class sizes (see the module text). With ``cache`` (a
    folder) sums of the same parameters, scorer and data are read instead of
    computed; ``sources`` are further files whose change must miss the cache
    (inputs that Spark does not read itself). Neither the top-k mode nor the
    alignment is part of the key. ``written`` is a written copy of ``points``
    to read instead of them. ``keys`` gives the memberships of a point row
    (see ``scoring.membership``), which ``runs`` describes for the cache."""
    pts = points if written is None else written
    params = {"order": p.order, "measures": list(p.measures), "runs": list(run_cols), "of": list(runs),
              "scorer": _scorer_key(scorer)}
    watch = CubeWatch(p.measures)
    sums = materialize(lambda: fold_sums(watch.on(index_range(cube, pts)), pts, p.measures, p.order, run_cols, engine, keys, scorer),
                       cache, params, (cube, pts), sources)
    counts = check_coverage(sums, pts, run_cols, keys)
    for text in watch.notes() + class_notes(counts, run_cols, k_of or (lambda r: p.folds)):
        warn(text)
    return sums


def weights_of(sums: DataFrame, p: Protocol) -> DataFrame:
    """Weights per (fold, state, config_index) from the score sums of one run."""
    return make_weights(train_sums(sums, p.folds, p.measures), p.measures, p.mode, p.fraction, p.min_zero)


def fit_weights(cube: DataFrame, points: DataFrame, p: Protocol = Protocol(), engine: str = "arrow",
                cache: str | None = None, sources: Sequence[str] = (), scorer: Scorer | None = None) -> DataFrame:
    """Weights per (fold, state, config_index) for the training set of every
    fold. ``scorer`` takes the errors of one measure (points by configs) and
    returns a score for each, more for better; default is the linear rank."""
    return weights_of(score_sums(cube, with_folds(points, p), p, (), cache, sources, engine, None, scorer), p)


def _n_config(table: DataFrame) -> int:
    return (table.agg(F.max("config_index")).first()[0] or 0) + 1


def test_inputs(cube: DataFrame, points: DataFrame, weights: DataFrame, p: Protocol,
                n_config: int | None = None) -> tuple[DataFrame, dict]:
    """Cube rows with memberships, and the weight vectors, for a test pass.
    Only the part of the cube from the first to the last usable point is read."""
    warr = weight_arrays(weights, p.measures, ("fold", "state"), p.align)
    table = collect_weights(warr, 3 * p.folds, n_config or _n_config(weights), p.measures)
    folded = with_folds(points, p)
    return scoring_rows(index_range(cube, folded), folded, measures=p.measures), table


def _fit_and_test(cube, points, p, engine, cache, sources, scorer) -> tuple[DataFrame, dict]:
    folded = with_folds(points, p)
    pts = materialize(lambda: folded)  # read by the ranking pass, the coverage check and the test pass
    sums = score_sums(cube, folded, p, (), cache, sources, engine, pts, scorer)
    return test_inputs(cube, pts, weights_of(sums, p), p, _n_config(sums))


def apply_weights(cube: DataFrame, points: DataFrame, weights: DataFrame, p: Protocol = Protocol()) -> DataFrame:
    """Weighted errors of every test point: ``(global_index, fold, label, kind, weighted_err_*)``.
    ``ProtocolError`` unless every usable point has exactly one cube row; this
    reads the cube's index column, and nothing of a cube file."""
    folded = with_folds(points, p)
    pts = materialize(lambda: folded)
    check_covered(index_range(cube, pts), pts)
    return weighted_errors(*test_inputs(cube, pts, weights, p), p.measures)


def predictions(cube: DataFrame, points: DataFrame, p: Protocol = Protocol(), engine: str = "arrow",
                cache: str | None = None, sources: Sequence[str] = (), scorer: Scorer | None = None) -> DataFrame:
    """Weights of every training set, applied to its test points (one row per point and kind)."""
    return weighted_errors(*_fit_and_test(cube, points, p, engine, cache, sources, scorer), p.measures)


def moments(cube: DataFrame, points: DataFrame, p: Protocol = Protocol(), engine: str = "arrow",
            cache: str | None = None, sources: Sequence[str] = (), scorer: Scorer | None = None) -> DataFrame:
    """Moments of the weighted errors per (fold, label, kind)."""
    return error_moments(*_fit_and_test(cube, points, p, engine, cache, sources, scorer), p.measures)


def metrics_of(moments: DataFrame, p: Protocol, wide: bool = False) -> DataFrame:
    """Report rows (or the wide per-fold table) of the seven states."""
    w = error_metrics(report_states(moments, p.measures), p.measures)
    return w if wide else metrics_long(w, p.measures, p.folds)


def evaluate(cube: DataFrame, points: DataFrame, p: Protocol = Protocol(), engine: str = "arrow", wide: bool = False,
             cache: str | None = None, sources: Sequence[str] = (), scorer: Scorer | None = None) -> DataFrame:
    """Flagship: metrics per fold and report state, in report rows
    ``(label, metric, cv_fold_order, cv_fold_nr, weighted_err_*)`` (or the
    wide per-fold table with ``wide=True``). ``engine`` picks the ranking
    engine, ``scorer`` replaces the rank (see ``fit_weights``). Raises
    ``ProtocolError`` when a usable point has no cube row."""
    return metrics_of(moments(cube, points, p, engine, cache, sources, scorer), p, wide)


def cv_report(cube: DataFrame, points: DataFrame, p: Protocol = Protocol(), engine: str = "arrow",
              scorer: Scorer | None = None) -> DataFrame:
    return fold_average(evaluate(cube, points, p, engine, scorer=scorer), p.measures)


# ---------------------------------------------------------------- scenario sweep

RUN = ("scenario", "cv_fold_nr")


def packed(items: Iterable, size: Callable[[object], int], limit: int) -> list[list]:
    """Consecutive groups of ``items`` whose sizes add up to at most ``limit``;
    an item beyond it is a group of its own."""
    out: list[list] = []
    room = 0
    for x in items:
        if not out or size(x) > room:
            out.append([])
            room = limit
        out[-1].append(x)
        room -= size(x)
    return out


def run_keys(runs: Sequence[tuple[int, int]]) -> Column:
    """Memberships ``(scenario, cv_fold_nr, fold, label)`` of a point row of a
    scenario in all fold counts of ``runs``, from the point's position: points are
    ranked once per scenario and never copied per fold count."""
    def key(k: int) -> Column:
        return F.struct(F.col("scenario").cast("int").alias("scenario"), F.lit(k).alias("cv_fold_nr"),
                        fold_of(F.col("position"), k).alias("fold"), F.col("label").cast("int").alias("label"))

    of: dict[int, list[int]] = {}
    for s, k in runs:
        of.setdefault(s, []).append(k)
    cases = [(F.col("scenario") == s, F.array(*[key(k) for k in ks])) for s, ks in of.items()]
    return reduce(lambda acc, case: acc.when(*case), cases[1:], F.when(*cases[0]))


def sweep(cubes: DataFrame | Mapping[str, DataFrame], scenario_points: DataFrame, scenario_ids: Sequence[int],
          fold_counts: Sequence[int], modes: Sequence[int | str], p: Protocol = Protocol(),
          fraction: float | None = None, cube_of: Mapping[int, str] | None = None, engine: str = "arrow",
          cache: str | None = None, sources: Sequence[str] = (), scorer: Scorer | None = None) -> DataFrame:
    """Fold-averaged metrics for every (scenario, cv_fold_nr, mode).

    ``scenario_points``: ``(scenario, global_index, label, missing)``, one
    point table per scenario stacked; ``scenario_ids`` lists the scenarios to
    run (other ids are ignored). ``cubes`` is one cube for all scenarios, or
    several by name with ``cube_of`` naming the cube of each scenario. Each
    cube is ranked once for all its scenarios and fold counts (ranks depend
    on neither label nor fold); the top-k mode is applied after summing, so
    score sums are shared by all modes. Parameters are checked first.

    Any number of runs can be asked for. What a task holds (score sums when
    ranking, weight vectors when testing) follows from the parameters; where
    all runs together exceed ``scoring.TASK_SUM_BYTES`` or
    ``evaluate.WEIGHT_BYTES``, they are split into groups that fit, each with
    a pass of its own. Ranking rarely needs a second one: 512 MB hold 25,000
    (scenario, fold count, fold, label) keys of 320 configs and 8 measures.
    Returns ``(scenario, mode, label, metric, cv_fold_nr, weighted_err_*)``.
    """
    modes = [top_mode_name(m) for m in modes]
    for m in modes:
        top_k(m, 1, fraction)
    bad = [k for k in fold_counts if not MIN_FOLDS <= k <= MAX_FOLDS]
    if bad or not fold_counts or not modes or not scenario_ids:
        raise ProtocolError(f"fold counts must be in {MIN_FOLDS}..{MAX_FOLDS}, got {list(fold_counts)}; "
                            "scenarios, fold counts and modes must not be empty")
    if isinstance(cubes, DataFrame):
        cubes, cube_of = {"cube": cubes}, {s: "cube" for s in scenario_ids}
    unknown = [s for s in scenario_ids if (cube_of or {}).get(s) not in cubes]
    if unknown:
        raise ProtocolError(f"no cube is named for scenarios {unknown}")
    parts = []
    for name, cube in cubes.items():
        if ids := [int(s) for s in dict.fromkeys(scenario_ids) if cube_of[s] == name]:
            runs = [(s, int(k)) for s in ids for k in dict.fromkeys(fold_counts)]
            parts.append(_sweep_cube(cube, scenario_points, runs, list(dict.fromkeys(modes)), p, fraction, engine, cache, sources, scorer))
    return reduce(DataFrame.unionByName, parts)


def _sweep_cube(cube, scenario_points, runs, modes, p, fraction, engine, cache, sources, scorer) -> DataFrame:
    ids = list(dict.fromkeys(s for s, _ in runs))
    placed = fold_positions(scenario_points.filter(F.col("scenario").isin(ids)), p.seed, group_cols=["scenario"])
    pts = materialize(lambda: placed)
    vector = max(1, config_count(cube, p.measures[0])) * len(p.measures) * 8
    sums = reduce(DataFrame.unionByName, [
        score_sums(cube, placed, p, RUN, cache, sources, engine, _of(pts, group), scorer, run_keys(group), group, lambda r: r["cv_fold_nr"])
        for group in packed(runs, lambda run: 2 * run[1] * vector, sc.TASK_SUM_BYTES)])
    tests = packed([(run, mode) for run in runs for mode in modes], lambda x: 3 * x[0][1] * vector, ev.WEIGHT_BYTES)
    parts = [_test_moments(cube, pts, sums, group, p, fraction) for group in tests]
    if len(parts) > 1:  # the vectors of a group leave the driver before those of the next come
        parts = [materialize(part) for part in parts]
    else:
        parts = [parts[0]()]
    met = error_metrics(report_states(reduce(DataFrame.unionByName, parts), p.measures, (*RUN, "mode", "fold")), p.measures,
                        keys=(*RUN, "mode", "fold", "label_state"))
    long = metrics_long(met, p.measures, None, keys=("scenario", "mode"))
    return fold_average(long, p.measures, keys=("scenario", "mode"))


def _of(points: DataFrame, runs: Sequence[tuple[int, int]]) -> DataFrame:
    return points.filter(F.col("scenario").isin(list(dict.fromkeys(s for s, _ in runs))))


def _test_moments(cube, pts, sums, group, p, fraction) -> Callable[[], DataFrame]:
    """The test pass of a group of (run, mode) pairs."""
    def build() -> DataFrame:
        runs = list(dict.fromkeys(run for run, _ in group))
        spark = cube.sparkSession
        wanted = spark.createDataFrame([(*run, mode) for run, mode in group], "scenario int, cv_fold_nr int, mode string")
        run_table = spark.createDataFrame(runs, "scenario int, cv_fold_nr int")
        tr = train_sums(sums, run_table, p.measures, run_cols=RUN)
        tr = (tr.select(*RUN, "fold", "state", "config_index", "n_points", *score_cols(p.measures))
              .join(F.broadcast(wanted), [*RUN]))  # one row per run and mode of the parameters
        keys = (*RUN, "mode", "fold", "state")
        warr = weight_arrays(make_weights(tr, p.measures, F.col("mode"), fraction, p.min_zero, keys=keys), p.measures, keys, p.align)
        table = collect_weights(warr, sum(3 * k for (_, k), _ in group), _n_config(sums), p.measures, RUN, ("mode",))
        mine = _of(pts, runs)
        rows = scoring_rows(index_range(cube, mine), mine, RUN, run_keys(runs), p.measures)
        return error_moments(rows, table, p.measures, RUN, ("mode",))

    return build
