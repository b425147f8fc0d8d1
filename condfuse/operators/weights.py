"""Summed scores -> truncated, normalised ensemble weights.

Per training set (a group of ``keys``) and measure:

1. shift: s := s - min(s) over the group (on by default);
2. cut: order by s descending (ties: lower config_index first) and zero every
   config after position k (k from the top-k mode);
3. normalise: w := s / sum(s); null when the sum is 0 (all scores equal, or
   k = 0), where the protocol would divide 0 by 0.

All of it is window functions over the small score table (one window
partition per training set, n_config rows each). Scores are integers (ranks)
or, from a scorer of the user's own, doubles; they keep their type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condfuse.functions.columns import MEASURES, score_cols, weight_cols
from condfuse.model import TOP_COUNTS, TOP_FRACTIONS, top_k, top_mode_name

DEFAULT_KEYS = ("fold", "state")


def _k_column(mode: str | Column, n: Column, fraction: float | Column | None) -> Column:
    """Kept configs for a fixed mode name or a ``mode`` column; ``All`` keeps n.

    A mode column may hold any defined mode name. An unknown name, and
    ``TopXPercent`` without a fraction in [0, 1], raise an error when the row
    is computed, as they do at once for a fixed mode.
    """
    if isinstance(mode, str):
        mode = top_mode_name(mode)
        if mode == "TopXPercent" and not isinstance(fraction, Column):
            top_k(mode, 1, fraction)  # validates the fraction
        mode = F.lit(mode)
    n = n.cast("long")
    frac = fraction if isinstance(fraction, Column) else F.lit(fraction).cast("double")
    expr = F.when(mode == "All", n)
    for name, cnt in TOP_COUNTS.items():
        expr = expr.when(mode == name, F.lit(cnt).cast("long"))
    for name, fr in TOP_FRACTIONS.items():
        expr = expr.when(mode == name, F.floor(n * F.lit(fr)).cast("long"))
    expr = expr.when((mode == "TopXPercent") & frac.between(0.0, 1.0), F.floor(n * frac).cast("long"))
    problem = F.concat(F.lit("undefined top-k mode, or TopXPercent without a fraction in [0, 1]: "),
                       F.coalesce(mode, F.lit("null")))
    return expr.otherwise(F.raise_error(problem).cast("long"))


def shift_scores(sums: DataFrame, measures: Sequence[str] = MEASURES, keys: Sequence[str] = DEFAULT_KEYS,
                 min_zero: bool = True) -> DataFrame:
    """Min-to-zero shift of every score column within its training set."""
    if not min_zero:
        return sums
    w = Window.partitionBy(*keys)
    return sums.withColumns({s: (F.col(s) - F.min(s).over(w)).cast(sums.schema[s].dataType) for s in score_cols(measures)})


def make_weights(sums: DataFrame, measures: Sequence[str] = MEASURES, mode: str | Column = "Top25Percent",
                 fraction: float | Column | None = None, min_zero: bool = True,
                 keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Adds ``weight_*`` (and ``last_rank``) to a score table.

    ``score_*`` come back shifted and cut, as the protocol leaves them.
    ``last_rank`` is the 1-based position of the config when ordered by the
    last measure's score (used by the ``last_rank`` alignment).
    ``mode`` is a mode name, or a column (e.g. ``F.col("mode")``) when one
    table holds several modes; then the mode column must be part of ``keys``.

    Two projections: the shift is a constant per group, so positions can be
    taken on the raw sums, and shift, cut and position all come out of one
    select; the normalising sums need the cut values, hence the second.
    """
    scores, weights = score_cols(measures), weight_cols(measures)
    grp = Window.partitionBy(*keys)

    def pos(s):
        return F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(s).desc(), F.col("config_index").asc()))

    k = _k_column(mode, F.count(F.lit(1)).over(grp), fraction)
    others = [c for c in sums.columns if c not in scores]
    cut = []
    for s in scores:
        shifted = (F.col(s) - F.min(s).over(grp)) if min_zero else F.col(s)
        cut.append(F.when(pos(s) <= k, shifted).otherwise(F.lit(0)).cast(sums.schema[s].dataType).alias(s))
    df = sums.select(*others, pos(scores[-1]).alias("last_rank"), *cut)
    return df.select("*", *[F.when(F.sum(s).over(grp) != 0, F.col(s) / F.sum(s).over(grp)).alias(w)
                            for s, w in zip(scores, weights)])


def weight_arrays(weights: DataFrame, measures: Sequence[str] = MEASURES, keys: Sequence[str] = DEFAULT_KEYS,
                  align: str = "config") -> DataFrame:
    """One row per training set with ``weight_*`` as ``ARRAY<DOUBLE>``.

    Element i multiplies the error of config i. ``align='config'`` puts each
    config's weight at its own index; ``'last_rank'`` puts it at index
    ``last_rank - 1``, reproducing the protocol's index alignment. Each group
    holds exactly n_config entries.
    """
    wc = weight_cols(measures)
    if align == "config":
        pos = F.col("config_index")
    elif align == "last_rank":
        pos = F.col("last_rank") - 1
    else:
        raise ValueError(f"unknown align {align!r}")
    rows = F.array_sort(F.collect_list(F.struct(pos.alias("_pos"), *wc)))
    return weights.groupBy(*keys).agg(rows.alias("_w")).select(*keys, *[F.col("_w").getField(w).alias(w) for w in wc])


def describe_weights(weights: DataFrame, configs: DataFrame) -> DataFrame:
    """Weights with the parameters of their config. ``configs`` has one row
    per config (``config_index`` and its parameters, n_config rows), which
    bounds the broadcast side; a config without parameters keeps its weights."""
    return weights.join(F.broadcast(configs), "config_index", "left")
