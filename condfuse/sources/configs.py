"""Config dimension (kNN parameter grid) and the scenario catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condfuse.model import K_LEVEL1, SEARCH_STEP_LENGTHS, WINDOW_SIZES, ProtocolError

DEFAULT_AXES: tuple[tuple[str, Sequence[int]], ...] = (
    ("search_step_length", SEARCH_STEP_LENGTHS),
    ("window_size", WINDOW_SIZES),
    ("k_level1", K_LEVEL1),
)


def config_grid(spark: SparkSession, axes=DEFAULT_AXES) -> DataFrame:
    """All parameter combinations, one row per ``config_index``.

    The first axis varies slowest (mixed radix), so with the default axes
    config 0 is (2, 0, 2), config 1 is (2, 0, 4) and config 319 is (256, 32, 256).
    Built from ``spark.range`` and index arithmetic: no join at all.
    """
    total = 1
    for _, values in axes:
        total *= len(values)
    cols = [F.col("id").cast("int").alias("config_index")]
    stride = total
    for name, values in axes:
        stride //= len(values)
        pos = (F.col("id") / F.lit(stride)).cast("long") % F.lit(len(values))
        cols.append(F.element_at(F.array(*[F.lit(v) for v in values]), (pos + 1).cast("int")).alias(name))
    return spark.range(0, total, numPartitions=1).select(*cols)


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Config dimension from Parquet, one row per ``config_index``; repeated
    indexes are an error, as each would repeat the weights it describes."""
    df = spark.read.parquet(path)
    if df.groupBy("config_index").count().filter("count > 1").limit(1).count():
        raise ProtocolError(f"{path} repeats config indexes")
    return df


# Anomaly-detection scenarios of the protocol, keyed by method id:
# (method name, error cube file, anomaly flag file). Ids 2 and 12 share a name.
SCENARIOS: dict[int, tuple[str, str, str]] = {
    0: ("Decomposition_Week_ResNormAvg", "t145325_expResult-v13.1-detect-gsw-missingOnly.bin",
        "anomalyFlag406_DecompositionWeek_residual_norm_avg.npy"),
    1: ("Decomposition_Week_Pure", "t145325_expResult-v13.1-detect-gsw-missingOnly.bin",
        "anomalyFlag406_DecompositionWeek_Pure.npy"),
    2: ("Ground_Truth_Incident", "t145325_expResult-v13.1-detect-gsw-missingOnly.bin",
        "incidentFlagBinary.npy"),
    3: ("Ground_Truth_Accident", "t145325_expResult-v13.1-detect-gsw-missingOnly.bin",
        "incidentFlag_digits013_NonAccidentIncidentAs_0.npy"),
    4: ("S_H_ESD_ResNormAvg", "t145325_expResult-v13.1-detect-gsw-missingOnly.bin",
        "anomalyFlag406_S_H_ESD_residual_norm_avg.npy"),
    5: ("S_H_ESD_Pure", "t145325_expResult-v13.1-detect-gsw-missingOnly.bin",
        "anomalyFlag406_S_H_ESD_Pure.npy"),
    6: ("DecompositionWeek_ResNormAvg_NN_Aware",
        "t145325_expResult-v13.1-detect-missingAndDecompositionWeek_ResNormAvg.bin",
        "anomalyFlag406_DecompositionWeek_residual_norm_avg.npy"),
    7: ("DecompositionWeek_ResNormAvg_NN_Aware_Reversed",
        "t145325_expResult-v13.1-detect-missingAndDecompositionWeek_ResNormAvg_reversed.bin",
        "anomalyFlag406_DecompositionWeek_residual_norm_avg.npy"),
    8: ("S_H_ESD_ResNormAvg_NN_Aware", "t145325_expResult-v13.1-detect-missingAndS_H_ESD_ResNormAvg.bin",
        "anomalyFlag406_S_H_ESD_residual_norm_avg.npy"),
    9: ("S_H_ESD_ResNormAvg_NN_Aware_Reversed",
        "t145325_expResult-v13.1-detect-missingAndS_H_ESD_ResNormAvg_reversed.bin",
        "anomalyFlag406_S_H_ESD_residual_norm_avg.npy"),
    10: ("DecompositionWeek_ResNormAvg_NN_Aware_combined",
         "t145325_expResult-v13.1-detect-missingAndDecompositionWeek_ResNormAvg_combined.bin",
         "anomalyFlag406_DecompositionWeek_residual_norm_avg.npy"),
    11: ("S_H_ESD_ResNormAvg_NN_Aware_combined",
         "t145325_expResult-v13.1-detect-missingAndS_H_ESD_ResNormAvg_combined.bin",
         "anomalyFlag406_S_H_ESD_residual_norm_avg.npy"),
    12: ("Ground_Truth_Incident", "t145325_expResult-v13.1-detect-gsw-missingOnly.bin",
         "incidentFlag_digits013_missingAs3.npy"),
}


def scenarios(spark: SparkSession) -> DataFrame:
    """Scenario catalog as a small dimension table (13 rows)."""
    rows = [(k, *v) for k, v in sorted(SCENARIOS.items())]
    return spark.createDataFrame(
        rows, "anomaly_method_int int, anomaly_method string, cube_file string, flag_file string")
