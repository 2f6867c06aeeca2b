"""Session helpers: a tuned local session for tests and a checkpoint directory."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "webcorpus") -> SparkSession:
    """Local session with the settings the operators assume (UTC, AQE, Arrow, no UI)."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # html rows are large: keep Arrow batches small so a Python worker never holds much
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be configured (it has to be on shared storage).
    Only a local-mode session without one gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) for this job")
        configured = tempfile.mkdtemp(prefix="webcorpus-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (once per SparkContext), so no PYTHONPATH is needed there."""
    sc = spark.sparkContext
    if getattr(sc, "_webcorpus_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="webcorpus-ship-"), "webcorpus.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    sc.addPyFile(target)  # served by the driver: executors need no shared folder for it
    sc._webcorpus_shipped = True
