from condfuse.functions.columns import (
    MEASURES,
    fold_hash,
    nan_to_null,
    param_string,
    renamed,
    round6,
    score_cols,
    weight_cols,
    weighted_cols,
)

__all__ = [
    "MEASURES", "fold_hash", "nan_to_null", "param_string", "renamed", "round6",
]
