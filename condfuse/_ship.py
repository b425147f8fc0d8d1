"""Ships worker-side modules with the task instead of importing them there.

Functions run inside Python workers (Arrow batch functions, data source
readers) are pickled by reference by default, which needs this package
installed on every executor. Registering their modules for pickling by
value makes the library usable from a plain driver-side checkout as well.
"""

from __future__ import annotations

import types


def by_value(module: types.ModuleType) -> None:
    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    import condfuse.functions.columns
    import condfuse.model

    for m in (module, condfuse.model, condfuse.functions.columns):
        try:
            cloudpickle.register_pickle_by_value(m)
        except (ValueError, AttributeError):  # already registered / old cloudpickle
            pass


def has_context(spark) -> bool:
    """True for a classic session (a SparkContext is reachable); False under
    Spark Connect, where broadcast variables and the context are absent."""
    try:
        return spark.sparkContext is not None
    except Exception:  # Spark Connect raises on sparkContext
        return False
