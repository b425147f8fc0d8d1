"""Session helper for tests, bench and scripts.

A cluster session is built by its owner; library code only reads settings.
``shared_dir`` is the folder named by ``spark.checkpoint.dir``, which driver
and executors share. Where that is unset, a local master gets a fresh folder of
its own and any other is an error.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

from condfuse.model import ProtocolError

_own: list[str] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "condfuse",
                  checkpoint: str | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", os.environ.get("CONDFUSE_DRIVER_MEMORY", "8g"))
               .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2048"))
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables that later jobs read (``spark.checkpoint.dir``)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ProtocolError("spark.checkpoint.dir is not set; a cluster needs a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="condfuse-"))
    return _own[0]
