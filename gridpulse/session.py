"""Session defaults. Every setting stays overridable by the cluster."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "gridpulse", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder named by the cluster; a fresh folder of our own only for a local master without one."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    active = spark.sparkContext._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return active.get()
    one_machine = spark.sparkContext.master.split("[")[0] == "local"
    if not current and not one_machine:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = current or tempfile.mkdtemp(prefix="gridpulse-ckpt-", dir=os.environ.get("TMPDIR"))
    spark.sparkContext.setCheckpointDir(folder)
    return folder
