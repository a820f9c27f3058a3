"""Session defaults used by the tests and the benchmark."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app: str = "wordclips", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session; on a cluster the caller's own session is used instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.wordclips.deal", "8" if cores == "*" else str(cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: the cluster's ``spark.checkpoint.dir``.

    In a local session, where one machine is the whole cluster, a folder is made
    if none is set (as in tests); on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wordclips-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


# Spark takes an execution's shuffle files away at its end; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """What runs inside leaves no shuffle files; nothing written out is read from them again."""
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, old)


def cut_lineage(df):
    """Write ``df`` once to the shared folder and read it back."""
    shared_folder(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        # A frame of its own: one made before goes by the setting of then.
        return df.select("*").checkpoint(eager=True)


def stored(df, name: str = "table"):
    """Write ``df`` once as a parquet table in the shared folder and read it back.

    Columnar and compressed, so several passes over it are cheaper than over a
    checkpoint; it survives lost executors in the same way.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
