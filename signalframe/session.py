"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F



def get_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("signalframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("SPARK_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="signalframe-"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    A cluster must name it. A local session, whose driver and executor are one process, makes its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    return _own_dir()


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="signalframe-")


def materialise(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    For frames that several passes read: the later passes scan columns instead of repeating the
    work, and a lost executor costs nothing.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def default_partitions(df: DataFrame, factor: int = 3) -> int:
    """Partitions for rows that are about to grow: never below the input's own split count."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores * factor, df.rdd.getNumPartitions())


def settle(df: DataFrame) -> DataFrame:
    """Compute the columns of a narrow frame once, before what follows.

    Catalyst copies the expression behind a column into each filter and Python function that uses
    the column. For a cheap expression that is right; a beat detection would run twice. Generating
    the row from an array of one struct keeps the two sides apart and changes nothing else.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
