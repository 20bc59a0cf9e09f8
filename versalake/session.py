"""Session defaults for local use; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", **extra: str) -> SparkSession:
    """A local[cores] session with the defaults above; `extra` overrides them."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("versalake").config("spark.driver.memory", memory)
    for key, value in (DEFAULTS | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed: its folder joins their search path. It must
    be visible to the executors; elsewhere ship the package with the application."""
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. Where that is unset, a folder of this machine in local
    mode, as in tests; on a cluster it must be named."""
    context = spark.sparkContext._jsc.sc()
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None and context.getCheckpointDir().isDefined():
        at = context.getCheckpointDir().get()
    if at is None:
        if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="versalake-")
        spark.sparkContext.setCheckpointDir(at)
    at = at.rstrip("/")
    return at if ":" in at.split("/")[0] else f"file://{at}" if at.startswith("/") else at
