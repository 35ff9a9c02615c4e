"""Session helpers shared by tests, bench and the entry point."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tuned for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wardflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Checkpoint files go when the last plan that reads them is gone.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        # Wide projections: generated methods beyond 8000 bytes are never compiled
        # to machine code, so Spark should not fuse whole stages that large.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # No Python call sites per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, where intermediate tables go too.

    It comes from ``spark.checkpoint.dir``.  A temporary folder is made only for
    local masters; on a cluster a missing setting is an error, because a folder
    of one machine would not survive the loss of an executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="wardflow-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder of the session."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
