"""Sessions: settings that the engine counts on, and workers that can import it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; options are given with "__" for "."."""
    builder = SparkSession.builder.appName("tessera")
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did."""
    here, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH")]))


def checkpoint_folder(spark: SparkSession) -> None:
    """Give checkpoints a folder where the session names none; outside local mode that is an error, as executors wouldn't share it."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
        return
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tessera-')}")
