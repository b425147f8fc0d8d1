"""Column helpers shared by the operators.

Everything here returns built-in ``pyspark.sql.functions`` expressions, so
they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Measure names of the error cube, in cube order (flow and speed
# interleaved per forecast horizon 1, 2, 4, 8).
MEASURES: tuple[str, ...] = (
    "err_flow1", "err_speed1", "err_flow2", "err_speed2",
    "err_flow4", "err_speed4", "err_flow8", "err_speed8",
)

ERR_PREFIX = "err_"


def renamed(measures: Iterable[str], prefix: str) -> list[str]:
    """``err_flow1`` -> ``<prefix>flow1`` for every measure (score_, weight_, ...)."""
    out = []
    for m in measures:
        if not m.startswith(ERR_PREFIX):
            raise ValueError(f"measure {m!r} must start with {ERR_PREFIX!r}")
        out.append(prefix + m[len(ERR_PREFIX):])
    return out


def score_cols(measures: Sequence[str]) -> list[str]:
    return renamed(measures, "score_")


def weight_cols(measures: Sequence[str]) -> list[str]:
    return renamed(measures, "weight_")


def weighted_cols(measures: Sequence[str]) -> list[str]:
    return renamed(measures, "weighted_err_")


def nan_to_null(c: Column | str) -> Column:
    """NaN -> null, so ``sum``/``avg`` skip it like pandas' skipna does."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def fold_hash(global_index: Column | str, seed: int) -> Column:
    """Deterministic 32-bit hash of ``seed:global_index`` (first 8 hex digits of md5).

    md5 gives the same digits in Spark and DuckDB, so fold membership can be
    checked by an independent engine.
    """
    gi = F.col(global_index) if isinstance(global_index, str) else global_index
    digest = F.md5(F.concat(F.lit(f"{seed}:"), gi.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def not_missing(c: Column | str = "missing") -> Column:
    """Only the value 1 means missing; 0, null and any other code do not."""
    c = F.col(c) if isinstance(c, str) else c
    return ~c.eqNullSafe(F.lit(1))


def round6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def param_string(*parts: Column | str) -> Column:
    """Joins run parameters with ``_`` (e.g. ``3_2_0_0_1``)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("_", *[c.cast("string") for c in cols])
