"""Session settings for tests, the bench and local use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "matchlake", master: str | None = None, partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; a cluster's own values win when they are set outside."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the one named in spark.checkpoint.dir.

    Only a local master may do without: it gets a fresh local folder. Elsewhere an unset folder is an error, as the
    executors would write where nobody else reads.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir has to name a shared folder on {master}")
        path = tempfile.mkdtemp(prefix="matchlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_work_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{os.urandom(8).hex()}"
