"""Where intermediate tables go, and how their layout is kept."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder, because there the driver is the cluster.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="contactloom-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as parquet and read it back.

    Cuts the lineage like a checkpoint does, and later readers still get column
    pruning, pushed filters and a known size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing that is still to be computed reads them."""
    for df in tables:
        spark = df.sparkSession
        folders = {name.rpartition("/")[0] for name in df.inputFiles()}
        for folder in folders:
            if "/tables/" not in folder:
                raise ValueError(f"{folder} was not written by stored()")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of each query as soon as it ends; else they stay until the driver collects its garbage.

    For jobs that write what they go on with; a query that is run twice makes its shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of ``df``; exact for stored tables, else generous."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:  # joins of joins multiply estimates, up to numbers too long to read
        return 1 << 62


def checkpointed(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def fixed_layout(spark: SparkSession) -> Iterator[int]:
    """Plan without runtime repartitioning, so that checkpoints keep their hash layout.

    An adaptive plan reports no output partitioning; a checkpoint taken from it is
    shuffled again by every later join. Loops that reuse one large side switch
    adaptivity off for the loop only. Yields the number of partitions to use.
    """
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
