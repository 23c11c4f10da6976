"""Session helpers: the shared folder, tables cut loose from their lineage, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many rows is broadcast after its rows were counted.
BROADCAST_ROWS = 20_000


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Unset, a session in one process takes a folder of its own; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/corpusloom-local"
    return f"{base.rstrip('/')}/corpusloom/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer partitions than there are cores, such as one file with one row group, dealt to all cores.

    For work that costs far more than moving the rows. Tables with as many partitions or more are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more rows than that; reads one row beyond at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
