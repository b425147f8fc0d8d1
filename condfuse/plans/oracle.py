"""Independent DuckDB SQL for every registered query.

The SQL takes the direct route where the Spark plan takes a shortcut:
ranks come from ``row_number`` windows over the long cube, training sums
from explicit train/test pairs (fold <> k), weighted errors from a join on
config_index and a grouped sum. Rounding, tie-breaks and NaN rules follow
the Spark side (doubles rounded to 6 places, NaN and null last).
"""

from __future__ import annotations

from condfuse.functions.columns import MEASURES, score_cols, weight_cols, weighted_cols
from condfuse.plans import registry as R
from condfuse.sources import standins as st

M = list(MEASURES)
S, W, O = score_cols(M), weight_cols(M), weighted_cols(M)


def _list(cols, fmt):
    return ", ".join(fmt.format(c=c, i=i) for i, c in enumerate(cols))


# Fixed values, written out here once more so that a change in the library shows:
# report states of the points tested with the weights of their own class or of
# both classes merged, and the pairs compared by the improvement report.
STATE_ROWS = """
    ('own', 1, 'labelled_aware'), ('own', 0, 'non_labelled_aware'),
    ('own', 1, 'both_aware'), ('own', 0, 'both_aware'),
    ('merged', 1, 'labelled_unaware'), ('merged', 0, 'non_labelled_unaware'),
    ('merged', 1, 'both_unaware'), ('merged', 0, 'both_unaware'),
    ('own', 1, 'mixed'), ('merged', 0, 'mixed')"""
SINGLE_STATE = """CASE WHEN kind = 'own' AND label = 1 THEN 'labelled_aware' WHEN kind = 'own' THEN 'non_labelled_aware'
    WHEN label = 1 THEN 'labelled_unaware' ELSE 'non_labelled_unaware' END"""
COMPARED = (("labelled", "labelled_aware", "labelled_unaware"),
            ("non_labelled", "non_labelled_aware", "non_labelled_unaware"),
            ("both", "both_aware", "both_unaware"), ("mixed", "mixed", "both_unaware"))


# ---------------------------------------------------------------- inputs

def a_cube_long() -> str:
    nm = len(M)
    errs = ", ".join(f"embedding[c*{nm}+{j + 1}] AS {m}" for j, m in enumerate(M))
    return (f"SELECT vec_id AS global_index, CAST(c AS INTEGER) AS config_index, {errs} "
            f"FROM embeddings, (SELECT range AS c FROM range({st.A_CONFIGS})) cfg")


def a_flags() -> str:
    return (f"SELECT vec_id AS global_index, CAST(CASE WHEN vec_id % {st.A_MISSING_MOD} = 0 THEN 1 ELSE 0 END AS INTEGER) AS missing, "
            "CAST(label % 2 AS INTEGER) AS label FROM embeddings")


def a_points() -> str:
    pd = st.A_PER_DAY
    return f"""
    SELECT f.global_index,
           CAST(CASE WHEN f.missing = 1 THEN 3 ELSE f.label END AS INTEGER) AS label,
           CAST(CASE WHEN f.global_index >= prm.n_days*{pd} - {pd} AND f.global_index < prm.vlen - 1 THEN 1
                     ELSE f.missing END AS INTEGER) AS missing
    FROM ({a_flags()}) f,
         (SELECT max(vec_id) + 1 AS vlen, (max(vec_id) + 1) // {pd} AS n_days FROM embeddings) prm
    WHERE f.global_index >= {st.A_TRIM} AND f.global_index < prm.n_days*{pd}"""


def b_cube_long(n_config: int = st.B_CONFIGS, measures=M) -> str:
    errs = ", ".join(
        f"CAST(((o_orderkey*(c+7)*({M.index(m)}+3)) % {st.B_MOD})/{st.B_MOD}e0 + "
        f"(CASE WHEN o_orderstatus = 'F' THEN {n_config - 1}-c ELSE c END)*0.01e0 AS FLOAT) AS {m}"
        for m in measures)
    return (f"SELECT o_orderkey AS global_index, CAST(c AS INTEGER) AS config_index, {errs} "
            f"FROM orders, (SELECT range AS c FROM range({n_config})) cfg")


def b_points() -> str:
    return ("SELECT o_orderkey AS global_index, CAST(o_orderstatus = 'F' AS INTEGER) AS label, "
            "CAST(0 AS INTEGER) AS missing FROM orders")


def folds(points_sql: str, k: int, group: str = "") -> str:
    part = f"PARTITION BY {group} " if group else ""
    return f"""
    SELECT *, CAST((row_number() OVER ({part}ORDER BY label, h, global_index) - 1) % {k} + 1 AS INTEGER) AS fold
    FROM (SELECT *, ('0x' || substr(md5('{R.SEED}:' || CAST(global_index AS VARCHAR)), 1, 8))::BIGINT AS h
          FROM ({points_sql}) p) q"""


def usable(src: str) -> str:
    return f"SELECT * FROM ({src}) u WHERE label IN (0, 1) AND missing = 0"


def ranked(cube_sql: str, order: str = "raw") -> str:
    cols = []
    for m, s in zip(M, S):
        v = f"abs({m})" if order == "abs" else m
        bad = f"coalesce(isnan({v}), true)"
        cols.append(f"CAST(count(*) OVER (PARTITION BY global_index) - row_number() OVER (PARTITION BY global_index "
                    f"ORDER BY {bad}, CASE WHEN {bad} THEN 0 ELSE {v} END, config_index) AS INTEGER) AS {s}")
    return f"SELECT global_index, config_index, {', '.join(cols)} FROM ({cube_sql}) c"


def state_expr(label: str) -> str:
    return f"CASE WHEN {label} = 1 THEN 'labelled' ELSE 'non_labelled' END"


def closeness(cube_sql: str) -> str:
    cols = _list(list(zip(M, S)), "1e0 / (1e0 + CAST({c[0]} AS DOUBLE) * CAST({c[0]} AS DOUBLE)) AS {c[1]}")
    return f"SELECT global_index, config_index, {cols} FROM ({cube_sql}) c"


def train_sums(scored: str, pts: str, k: int, run: tuple[str, ...] = (), kind: str = "BIGINT") -> str:
    """Direct training sums: a point adds to every fold k it is not tested in."""
    rsel = "".join(f"p.{r}, " for r in run)
    rgrp = "".join(f"{r}, " for r in run)
    kk = f"p.cv_fold_nr" if "cv_fold_nr" in run else str(k)
    sums = _list(S, "CAST(sum(s.{c}) AS " + kind + ") AS {c}")
    own = f"""
    SELECT {rsel}k.fold, {state_expr('p.label')} AS state, s.config_index, CAST(count(*) AS BIGINT) AS n_points, {sums}
    FROM ({scored}) s JOIN ({pts}) p ON s.global_index = p.global_index
         JOIN (SELECT CAST(range + 1 AS INTEGER) AS fold FROM range(10)) k ON k.fold <= {kk} AND p.fold <> k.fold
    GROUP BY ALL"""
    merged_sums = _list(S, "CAST(sum({c}) AS " + kind + ") AS {c}")
    return f"""
    SELECT * FROM ({own}) o
    UNION ALL
    SELECT {rgrp}fold, 'merged' AS state, config_index, CAST(sum(n_points) AS BIGINT) AS n_points, {merged_sums}
    FROM ({own}) o2 GROUP BY ALL"""


def k_expr(mode: str, n: str, fraction: float | None = None) -> str:
    if mode == "All":
        return "NULL"
    if mode in ("Top1", "Top3", "Top10"):
        return mode[3:]
    frac = {"Top25Percent": 0.25, "Top50Percent": 0.5}.get(mode, fraction)
    return f"CAST(floor({n} * {frac}) AS BIGINT)"


def weights(train: str, mode: str | None, keys: tuple[str, ...] = ("fold", "state"), fraction=None,
            mode_col: str | None = None) -> str:
    """Shift, cut and normalise. ``mode_col`` names a column holding the mode per row."""
    part = ", ".join(keys)
    shifted = _list(S, "{c} - min({c}) OVER (PARTITION BY " + part + ") AS {c}")
    if mode_col:
        kx = ("CASE " + " ".join(f"WHEN {mode_col} = '{m}' THEN {k_expr(m, 'n_cfg', fraction)}"
                                 for m in ("All", "Top1", "Top3", "Top10", "Top25Percent", "Top50Percent"))
              + (f" WHEN {mode_col} = 'TopXPercent' THEN {k_expr('TopXPercent', 'n_cfg', fraction)}" if fraction else "")
              + " END")
    else:
        kx = k_expr(mode, "n_cfg", fraction)
    cut = _list(S, "CASE WHEN _k IS NULL OR row_number() OVER (PARTITION BY " + part +
                " ORDER BY {c} DESC, config_index) <= _k THEN {c} ELSE 0 END AS {c}")
    last = S[-1]
    wts = _list(list(zip(S, W)), "CAST({c[0]} AS DOUBLE) / nullif(CAST(sum({c[0]}) OVER (PARTITION BY " + part +
                ") AS DOUBLE), 0) AS {c[1]}")
    return f"""
    SELECT *, {wts} FROM (
      SELECT {part}, config_index, n_points, last_rank, {cut} FROM (
        SELECT *, {kx} AS _k,
               row_number() OVER (PARTITION BY {part} ORDER BY {last} DESC, config_index) AS last_rank
        FROM (SELECT {part}, config_index, n_points, {shifted}, count(*) OVER (PARTITION BY {part}) AS n_cfg
              FROM ({train}) t) sh) kc) ct"""


def predictions(cube_sql: str, tests: str, wts: str, align: str = "config", run: tuple[str, ...] = (),
                wkeys: tuple[str, ...] = ()) -> str:
    rsel = "".join(f"t.{r}, " for r in run) + "".join(f"w.{r}, " for r in wkeys)
    rjoin = "".join(f" AND w.{r} = t.{r}" for r in run)
    pos = "w.config_index" if align == "config" else "w.last_rank - 1"
    dots = _list(list(zip(W, M, O)),
                 "coalesce(sum(CASE WHEN isnan(w.{c[0]} * c.{c[1]}) THEN NULL ELSE w.{c[0]} * c.{c[1]} END), 0) AS {c[2]}")
    return f"""
    SELECT t.global_index, {rsel}t.fold, t.label, kd.kind, {dots}
    FROM ({tests}) t
    JOIN (VALUES ('own'), ('merged')) kd(kind) ON true
    JOIN ({wts}) w ON w.fold = t.fold{rjoin}
         AND w.state = CASE WHEN kd.kind = 'merged' THEN 'merged' ELSE {state_expr('t.label')} END
    JOIN ({cube_sql}) c ON c.global_index = t.global_index AND c.config_index = {pos}
    GROUP BY ALL"""


def states_sql(pred: str) -> str:
    return (f"SELECT p.*, m.label_state FROM ({pred}) p JOIN (VALUES {STATE_ROWS}) m(kind, label, label_state) "
            "ON p.kind = m.kind AND p.label = m.label")


def wide_metrics(states: str, keys: tuple[str, ...] = ("fold", "label_state")) -> str:
    aggs = _list(O, "avg({c}) AS avg_{c}, stddev_samp({c}) AS std_{c}, avg(abs({c})) AS mae_{c}")
    return f"SELECT {', '.join(keys)}, CAST(count(*) AS BIGINT) AS n_points, {aggs} FROM ({states}) s GROUP BY ALL"


def long_metrics(wide: str, k: int | None, keys: tuple[str, ...] = ()) -> str:
    kk = "".join(f"{c}, " for c in keys)
    nr = f"CAST({k} AS INTEGER)" if k is not None else "CAST(cv_fold_nr AS INTEGER)"
    vals = _list(O, "CASE mt.metric WHEN 'AVG' THEN avg_{c} WHEN 'STD' THEN std_{c} ELSE mae_{c} END AS {c}")
    return (f"SELECT {kk}label_state AS label, mt.metric, CAST(fold AS INTEGER) AS cv_fold_order, {nr} AS cv_fold_nr, {vals} "
            f"FROM ({wide}) w JOIN (VALUES ('AVG'), ('STD'), ('MAE')) mt(metric) ON true")


def rnd(cols) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def select_round(src: str, keep: list[str], dbl: list[str]) -> str:
    parts = keep + [f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in dbl]
    return f"SELECT {', '.join(parts)} FROM ({src}) z"


# ---------------------------------------------------------------- stand-in A building blocks

def a_folded(k=R.A_FOLDS):
    return folds(a_points(), k)


def a_train(k=R.A_FOLDS):
    return train_sums(ranked(a_cube_long()), usable(a_folded(k)), k)


def a_weights(k=R.A_FOLDS):
    return weights(a_train(k), R.PA.mode)


def a_pred(k=R.A_FOLDS, align="config"):
    return predictions(a_cube_long(), usable(a_folded(k)), a_weights(k), align)


def a_long_metrics(k=R.A_FOLDS):
    return long_metrics(wide_metrics(states_sql(a_pred(k))), k)


def fold_avg(long: str, keys: tuple[str, ...] = ()) -> str:
    kk = "".join(f"{c}, " for c in keys)
    return f"SELECT {kk}label, metric, cv_fold_nr, {_list(O, 'avg({c}) AS {c}')} FROM ({long}) l GROUP BY ALL"


def config_grid_sql() -> str:
    from condfuse.model import K_LEVEL1, SEARCH_STEP_LENGTHS, WINDOW_SIZES
    n2, n3 = len(WINDOW_SIZES), len(K_LEVEL1)
    total = len(SEARCH_STEP_LENGTHS) * n2 * n3
    return (f"SELECT CAST(range AS INTEGER) AS config_index, "
            f"CAST({list(SEARCH_STEP_LENGTHS)}[range // {n2 * n3} + 1] AS INTEGER) AS search_step_length, "
            f"CAST({list(WINDOW_SIZES)}[(range // {n3}) % {n2} + 1] AS INTEGER) AS window_size, "
            f"CAST({list(K_LEVEL1)}[range % {n3} + 1] AS INTEGER) AS k_level1 FROM range({total})")


def cube_ties() -> str:
    errs = ", ".join(f"CAST(floor({m} * 10) AS FLOAT) AS {m}" for m in M)
    return f"SELECT global_index, config_index, {errs} FROM ({a_cube_long()}) c"


def cube_nan() -> str:
    errs = ", ".join(f"CASE WHEN (global_index + config_index) % 43 = 0 THEN CAST(NULL AS FLOAT) "
                     f"WHEN (global_index + config_index) % 41 = 0 THEN CAST('nan' AS FLOAT) ELSE {m} END AS {m}"
                     for m in M)
    return f"SELECT global_index, config_index, {errs} FROM ({a_cube_long()}) c"


# ---------------------------------------------------------------- stand-in B building blocks

def b_folded(k=R.B_FOLDS):
    return folds(b_points(), k)


def b_train(k=R.B_FOLDS):
    return train_sums(ranked(b_cube_long()), usable(b_folded(k)), k)


def b_long_metrics(k=R.B_FOLDS):
    w = weights(b_train(k), R.PB.mode)
    return long_metrics(wide_metrics(states_sql(predictions(b_cube_long(), usable(b_folded(k)), w))), k)


def b_sweep(scenarios=None, fold_counts=R.SWEEP_FOLDS, modes=R.SWEEP_MODES, fraction=None, reverse=False) -> str:
    """Fold averages of the scenarios; ``reverse`` takes the cube with its configs in reverse order."""
    scenarios = sorted(st.B_SCENARIOS) if scenarios is None else scenarios
    scen = ("SELECT s.scenario, o.o_orderkey AS global_index, "
            "CAST(CASE WHEN (s.scenario = 1 AND o.o_orderstatus = 'F') OR (s.scenario = 2 AND o.o_orderstatus = 'P') "
            "OR (s.scenario = 3 AND starts_with(o.o_orderpriority, '1')) THEN 1 ELSE 0 END AS INTEGER) AS label, "
            f"CAST(0 AS INTEGER) AS missing FROM orders o, (VALUES {', '.join(f'({i})' for i in scenarios)}) s(scenario)")
    runs = (f"SELECT sp.*, CAST(kf.cv_fold_nr AS INTEGER) AS cv_fold_nr FROM ({scen}) sp, "
            f"(VALUES {', '.join(f'({k})' for k in fold_counts)}) kf(cv_fold_nr)")
    folded = f"""
    SELECT *, CAST((row_number() OVER (PARTITION BY scenario, cv_fold_nr ORDER BY label, h, global_index) - 1)
                   % cv_fold_nr + 1 AS INTEGER) AS fold
    FROM (SELECT *, ('0x' || substr(md5('{R.SEED}:' || CAST(global_index AS VARCHAR)), 1, 8))::BIGINT AS h
          FROM ({runs}) r) q"""
    cube = b_cube_long()
    if reverse:
        cube = f"SELECT global_index, CAST({st.B_CONFIGS - 1} - config_index AS INTEGER) AS config_index, {', '.join(M)} FROM ({cube}) c"
    run = ("scenario", "cv_fold_nr")
    tr = train_sums(ranked(cube), usable(folded), max(fold_counts), run)
    trm = f"SELECT t.*, md.mode FROM ({tr}) t JOIN (VALUES {', '.join(f"('{m}')" for m in modes)}) md(mode) ON true"
    keys = ("scenario", "cv_fold_nr", "mode", "fold", "state")
    w = weights(trm, None, keys, fraction, mode_col="mode")
    pred = predictions(cube, usable(folded), w, "config", run, ("mode",))
    wide = wide_metrics(states_sql(pred), ("scenario", "cv_fold_nr", "mode", "fold", "label_state"))
    long = long_metrics(wide, None, ("scenario", "mode"))
    return select_round(fold_avg(long, ("scenario", "mode")), ["scenario", "mode", "label", "metric", "cv_fold_nr"], O)


def describe_sql() -> str:
    """Weights of two measures of the 320-config cube, one row per training set and config."""
    cube = b_cube_long(320, ["err_flow1", "err_speed8"])
    cols = ["flow1", "speed8"]
    rank = ", ".join(f"320 - row_number() OVER (PARTITION BY global_index ORDER BY err_{c}, config_index) AS s_{c}" for c in cols)
    scored = f"SELECT global_index, config_index, {rank} FROM ({cube}) c"
    own = f"""SELECT k.fold, p.label, s.config_index, sum(s_flow1) AS s_flow1, sum(s_speed8) AS s_speed8
              FROM ({scored}) s JOIN ({usable(b_folded())}) p USING (global_index)
                   JOIN (SELECT CAST(range + 1 AS INTEGER) AS fold FROM range({R.B_FOLDS})) k ON k.fold <> p.fold GROUP BY ALL"""
    both = f"""WITH own AS ({own}) SELECT fold, {state_expr('label')} AS state, config_index, s_flow1, s_speed8 FROM own
               UNION ALL SELECT fold, 'merged', config_index, sum(s_flow1), sum(s_speed8) FROM own GROUP BY ALL"""
    part = "PARTITION BY fold, state"
    cut = ", ".join(f"CASE WHEN row_number() OVER ({part} ORDER BY s_{c} DESC, config_index) <= 80 THEN s_{c} - min(s_{c}) OVER ({part}) ELSE 0 END AS c_{c}" for c in cols)
    w = ", ".join(f"c_{c}::DOUBLE / nullif(sum(c_{c}) OVER ({part})::DOUBLE, 0) AS weight_{c}" for c in cols)
    return select_round(f"SELECT w.*, g.* EXCLUDE (config_index) FROM (SELECT fold, state, config_index, {w} FROM (SELECT fold, state, config_index, {cut} FROM ({both}) b) x) w "
                        f"JOIN ({config_grid_sql()}) g ON g.config_index = w.config_index",
                        ["fold", "state", "config_index", "search_step_length", "window_size", "k_level1"], ["weight_flow1", "weight_speed8"])


def b_improvement() -> str:
    avg = fold_avg(b_long_metrics())
    parts = []
    for name, aware, unaware in COMPARED:
        cols = []
        for o in O:
            a = f"max(CASE WHEN label = '{aware}' THEN {o} END)"
            u = f"max(CASE WHEN label = '{unaware}' THEN {o} END)"
            cols.append(f"round(CASE WHEN {u} <> 0 THEN 100e0 * ({u} - {a}) / {u} END, 6) AS {o.replace('weighted_err_', 'improvement_')}")
        parts.append(f"SELECT cv_fold_nr, {', '.join(cols)}, '{name}' AS comparison FROM ({avg}) a WHERE metric = 'MAE' GROUP BY cv_fold_nr")
    return " UNION ALL ".join(parts)


def b_weights_sql(mode: str, fraction=None) -> str:
    w = weights(b_train(), mode, fraction=fraction)
    return select_round(w, ["fold", "state", "config_index"], W)


# ---------------------------------------------------------------- the catalog

def oracle_sql() -> dict[str, str]:
    pts = a_points()
    sp = f"SELECT global_index, label, 'labelled' AS state FROM ({pts}) p WHERE label = 1 " \
         f"UNION ALL SELECT global_index, label, 'non_labelled' FROM ({pts}) p WHERE label = 0"
    split = f"SELECT * FROM ({pts}) p WHERE label IN (0, 1)"
    miss = f"SELECT global_index FROM ({pts}) p WHERE missing = 1"
    fa = a_folded()
    test1 = f"SELECT global_index FROM ({usable(fa)}) t WHERE fold = 1"
    pred = a_pred()
    ranked_long = ranked(a_cube_long())
    tr = a_train()
    wa = a_weights()
    states = states_sql(pred)
    q: dict[str, str] = {
        "point_flags": a_flags(),
        "point_range": f"SELECT global_index FROM ({pts}) p",
        "point_labels": f"SELECT global_index, label FROM ({pts}) p",
        "day_slot": f"SELECT global_index, CAST(global_index // {st.A_PER_DAY} AS INTEGER) AS day, "
                    f"CAST(global_index % {st.A_PER_DAY} AS INTEGER) AS slot FROM ({pts}) p",
        "mask_last_day": f"SELECT global_index, missing FROM ({pts}) p",
        "missing_points": miss,
        "drop_missing_anti": f"SELECT global_index, label FROM ({split}) s WHERE global_index NOT IN ({miss})",
        "drop_missing_except": f"SELECT global_index FROM ({split}) s EXCEPT SELECT global_index FROM ({miss}) m",
        "split_by_label": sp,
        "index_gaps": "SELECT i.range AS global_index FROM range((SELECT max(vec_id) + 1 FROM embeddings)) i "
                      "WHERE i.range % 41 = 7 OR i.range NOT IN (SELECT vec_id FROM embeddings)",
        "select_points_semi": select_round(f"SELECT * FROM ({a_cube_long()}) c WHERE global_index IN ({test1})",
                                           ["global_index", "config_index"], M),
        "cube_reshape": select_round(a_cube_long(), ["global_index", "config_index"], M),
        "validate_inputs": f"""
            SELECT CAST(count(*) AS BIGINT) AS n_points, min(vec_id) AS min_index, max(vec_id) AS max_index,
                   CAST(count(DISTINCT vec_id) AS BIGINT) AS n_distinct, CAST(min(len(embedding)) // 8 AS INTEGER) AS min_configs,
                   CAST(max(len(embedding)) // 8 AS INTEGER) AS max_configs,
                   (SELECT CAST(count(*) AS BIGINT) FROM ({pts}) p WHERE global_index % 41 = 7) AS n_uncovered
            FROM embeddings WHERE vec_id % 41 <> 7""",
        "rank_scores": ranked_long,
        "rank_scores_abs": ranked(a_cube_long(), "abs"),
        "rank_scores_ties": ranked(cube_ties()),
        "rank_scores_nan": ranked(cube_nan()),
        "config_score_sum": f"SELECT * FROM ({tr}) t WHERE state <> 'merged'",
        "merged_scores": f"SELECT fold, config_index, n_points, {', '.join(S)} FROM ({tr}) t WHERE state = 'merged'",
        "score_shift": f"SELECT fold, state, config_index, {_list(S, 'CAST({c} - min({c}) OVER (PARTITION BY fold, state) AS BIGINT) AS {c}')} FROM ({tr}) t",
        "scorer_weights": select_round(
            weights(train_sums(closeness(a_cube_long()), usable(a_folded()), R.A_FOLDS, kind="DOUBLE"), "All"),
            ["fold", "state", "config_index", "n_points"], [*S, *W]),
        "ensemble_weights": select_round(wa, ["fold", "state", "config_index", "CAST(last_rank AS INTEGER) AS last_rank",
                                              *[f"CAST({s} AS BIGINT) AS {s}" for s in S]], W),
        "describe_weights": describe_sql(),
        "weighted_error": select_round(pred, ["global_index", "fold", "label", "kind"], O),
        "weighted_error_lastrank": select_round(a_pred(align="last_rank"), ["global_index", "fold", "label", "kind"], O),
        "error_metrics": select_round(wide_metrics(states), ["fold", "label_state", "n_points"],
                                      [f"{p}_{o}" for o in O for p in ("avg", "std", "mae")]),
        "metrics_long": select_round(a_long_metrics(), ["label", "metric", "cv_fold_order", "cv_fold_nr"], O),
        "split_sizes": f"""
            SELECT k.fold AS cv_fold, r.role, c.label,
                   CAST(sum(CASE WHEN (r.role = 'test') = (c.fold = k.fold) THEN c.n ELSE 0 END) AS BIGINT) AS n_points
            FROM (SELECT fold, label, count(*) AS n FROM ({usable(fa)}) u GROUP BY ALL) c,
                 (SELECT CAST(range + 1 AS INTEGER) AS fold FROM range({R.A_FOLDS})) k,
                 (VALUES ('test'), ('train')) r(role)
            GROUP BY ALL""",
        "prediction_table": select_round(f"SELECT global_index AS test_index, fold, {SINGLE_STATE} AS label_state, {', '.join(O)}, "
                                         f"'{'_'.join(str(x) for x in R.PREDICTION_PARAMS)}' AS param_string FROM ({pred}) p",
                                         ["test_index", "fold", "label_state", "param_string"], O),
        "report_states": f"SELECT CAST(fold AS INTEGER) AS cv_fold_order, label_state, CAST(count(*) AS BIGINT) AS n_points, "
                         f"round(CAST(sum(weighted_err_flow1) AS DOUBLE), 6) AS sum_flow1 FROM ({states}) s GROUP BY ALL",
        "fold_average": select_round(fold_avg(a_long_metrics(R.A_FOLDS_AVG)), ["label", "metric", "cv_fold_nr"], O),
        "running_fold_average": select_round(
            f"SELECT label, metric, cv_fold_order, cv_fold_nr, {_list(O, 'avg({c}) OVER (PARTITION BY label, metric, cv_fold_nr ORDER BY cv_fold_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}')} "
            f"FROM ({a_long_metrics(R.A_FOLDS_AVG)}) l", ["label", "metric", "cv_fold_order", "cv_fold_nr"], O),
        "cv_summary": select_round(f"SELECT *, 'embeddings_label_1' AS anomaly_method, '{R.PA.score_method}' AS score_method, "
                                   f"'{R.PA.mode}' AS top_tuple_method FROM ({fold_avg(a_long_metrics())}) a",
                                   ["label", "metric", "cv_fold_nr", "anomaly_method", "score_method", "top_tuple_method"], O),
        "topk_weights_top25pct": b_weights_sql("Top25Percent"),
        "topk_weights_top50pct": b_weights_sql("Top50Percent"),
        "topk_weights_all": b_weights_sql("All"),
        "topk_weights_top1": b_weights_sql("Top1"),
        "topk_weights_top3": b_weights_sql("Top3"),
        "topk_weights_top10": b_weights_sql("Top10"),
        "topk_weights_topx": b_weights_sql("TopXPercent", R.TOPX_FRACTION),
        "stratified_folds": f"SELECT global_index, label, fold FROM ({b_folded()}) f",
        "train_test_split": f"""
            SELECT k.fold AS cv_fold, CASE WHEN k.fold = u.fold THEN 'test' ELSE 'train' END AS role, u.label,
                   CAST(count(*) AS BIGINT) AS n_points, min(u.global_index) AS min_index, max(u.global_index) AS max_index,
                   CAST(sum(u.global_index) AS BIGINT) AS sum_index
            FROM ({usable(b_folded())}) u, (SELECT CAST(range + 1 AS INTEGER) AS fold FROM range({R.B_FOLDS})) k
            GROUP BY ALL""",
        "condition_aware_cv": select_round(b_long_metrics(), ["label", "metric", "cv_fold_order", "cv_fold_nr"], O),
        "scenario_sweep": b_sweep(),
        "sweep_topx": b_sweep([1, 3], [2], ["TopXPercent", "Top1"], R.TOPX_FRACTION),
        "sweep_two_cubes": f"{b_sweep([1, 2], [3], ['Top25Percent'])} UNION ALL {b_sweep([3], [3], ['Top25Percent'], reverse=True)}",
        "improvement_report": b_improvement(),
    }
    return q
