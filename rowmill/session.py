"""Session defaults and the shared scratch location."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "rowmill", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume; extra ``conf`` wins.

    Nothing here sizes the cluster: shuffle partitions start high through AQE's
    initial number and are coalesced at run time.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # Recording the call site of every expression doubles the time to build wide rule plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_base(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it in ``spark.checkpoint.dir``."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return base.rstrip("/")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder for one written table."""
    return f"{shared_base(spark)}/rowmill/{purpose}-{uuid.uuid4().hex}"
