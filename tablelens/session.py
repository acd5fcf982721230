"""Session helpers: a tuned local session for tests/bench and the shared scratch folder.

On a cluster the session is created by the platform; we only *read* its settings.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "tablelens", shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators are designed for."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_dir(spark)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates and checkpoints, from ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a fresh temporary folder; on a
    cluster a folder of one machine would lose data, so that raises.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if conf:
        if not jdir.isDefined():
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    if jdir.isDefined():
        path = jdir.get()
    elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        path = tempfile.mkdtemp(prefix="tablelens-ckpt-")
        spark.sparkContext.setCheckpointDir(path)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared scratch folder."""
    base = scratch_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
