"""Parameters, fixed value tables and typed errors of the weighting protocol."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from condfuse.functions.columns import MEASURES

# Top-k truncation modes, keyed by the protocol's integer ids.
# Fraction modes keep int(n * fraction) configs, count modes keep a fixed count.
TOP_MODES: dict[int, str] = {
    0: "Top25Percent",
    1: "Top1",
    2: "All",
    3: "Top3",
    4: "Top50Percent",
    6: "TopXPercent",
    10: "Top10",
}
TOP_FRACTIONS: dict[str, float] = {"Top25Percent": 0.25, "Top50Percent": 0.50}
TOP_COUNTS: dict[str, int] = {"Top1": 1, "Top3": 3, "Top10": 10}

# Scoring method names. Only the linear rank score is defined.
SCORE_METHODS: dict[int, str] = {0: "Subtraction_Linear", 1: "Reciprocal_Square", 2: "Exponential_Dist"}
IMPLEMENTED_SCORE_METHODS = ("Subtraction_Linear",)

# Neighbour search modes; only "both" exists.
SEARCHABLE_METHODS: dict[int, str] = {0: "Both_Neighbours"}

# kNN parameter axes of the config dimension and forecast horizons.
SEARCH_STEP_LENGTHS = (2, 4, 8, 16, 32, 64, 128, 256)
WINDOW_SIZES = (0, 4, 8, 16, 32)
K_LEVEL1 = (2, 4, 8, 16, 32, 64, 128, 256)
PREDICT_STEP_LENGTHS = (1, 2, 4, 8)

# Label codes after the missing override.
LABEL_NORMAL = 0
LABEL_ANOMALOUS = 1
LABEL_MISSING = 3

# State names of score/weight tables: own class (label 1 / label 0) or both merged.
STATE_LABELLED = "labelled"
STATE_NON_LABELLED = "non_labelled"
STATE_MERGED = "merged"

MIN_FOLDS, MAX_FOLDS = 2, 10


class ProtocolError(ValueError):
    """Invalid parameter or input of the weighting protocol."""


class ProtocolWarning(UserWarning):
    """Inputs that a run can use, but that its user should know of."""


def top_mode_name(mode: int | str) -> str:
    if isinstance(mode, int):
        if mode not in TOP_MODES:
            raise ProtocolError(f"unknown top tuple method id {mode}")
        return TOP_MODES[mode]
    if mode not in TOP_MODES.values():
        raise ProtocolError(f"unknown top tuple method {mode!r}")
    return mode


def top_k(mode: str, n_config: int, fraction: float | None = None) -> int | None:
    """Number of configs kept by ``mode`` out of ``n_config``; None keeps all."""
    mode = top_mode_name(mode)
    if mode == "All":
        return None
    if mode in TOP_COUNTS:
        return TOP_COUNTS[mode]
    if mode == "TopXPercent":
        if fraction is None or not (0.0 <= fraction <= 1.0):
            raise ProtocolError(f"TopXPercent needs a fraction in [0, 1], got {fraction!r}")
        return int(math.floor(n_config * fraction))
    return int(math.floor(n_config * TOP_FRACTIONS[mode]))


@dataclass(frozen=True)
class Protocol:
    """One cross-validated weighting run.

    ``order``: rank by signed error (``raw``, the protocol default) or by ``abs``.
    ``align``: ``config`` multiplies each config's weight with its own error;
    ``last_rank`` reproduces the protocol's index alignment, where the weight of
    config c meets the error of config ``rank_last(c) - 1``.
    """

    folds: int = 3
    seed: int = 0
    mode: str = "Top25Percent"
    fraction: float | None = None
    order: str = "raw"
    align: str = "config"
    min_zero: bool = True
    score_method: str = "Subtraction_Linear"
    measures: tuple[str, ...] = field(default=MEASURES)

    def __post_init__(self):
        if not (MIN_FOLDS <= self.folds <= MAX_FOLDS):
            raise ProtocolError(f"fold count must be in {MIN_FOLDS}..{MAX_FOLDS}, got {self.folds}")
        object.__setattr__(self, "mode", top_mode_name(self.mode))
        if self.mode == "TopXPercent":
            top_k(self.mode, 1, self.fraction)
        if self.order not in ("raw", "abs"):
            raise ProtocolError(f"order must be 'raw' or 'abs', got {self.order!r}")
        if self.align not in ("config", "last_rank"):
            raise ProtocolError(f"align must be 'config' or 'last_rank', got {self.align!r}")
        if self.score_method not in IMPLEMENTED_SCORE_METHODS:
            raise ProtocolError(f"score method {self.score_method!r} is not defined")
        if not self.measures:
            raise ProtocolError("at least one measure is needed")
