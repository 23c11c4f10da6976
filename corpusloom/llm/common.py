"""What the operators of this package share: tables, shared folders, joins with small tables, worker state."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpusloom
from corpusloom.session import spread

# Functions that run on executors travel by value, so executors need no copy of this repository.
cloudpickle.register_pickle_by_value(corpusloom)

#: Words of the quality, mixing and near-duplicate operators: runs without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
#: A table of at most this many rows is broadcast; a larger one is joined by a salted shuffle.
BROADCAST_ROWS = 20_000
SALTS = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that comes in fewer partitions than there are cores is dealt to all of them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Unset, a session in one process takes a folder of its own; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/corpusloom-local"
    return f"{base.rstrip('/')}/corpusloom/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path  # for discard()
    _written.append(path)
    return out


#: Paths of materialize() that are still there, in the order in which they were written.
_written: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that no later plan reads."""
    for df in tables:
        path = getattr(df, "_corpusloom_path", None)
        if path:
            _delete(df.sparkSession, path)


def written() -> int:
    """A mark for sweep()."""
    return len(_written)


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete what materialize() has written since the mark but the tables to keep: for a step whose result is written."""
    kept = {getattr(df, "_corpusloom_path", None) for df in keep}
    for path in [p for p in _written[since:] if p not in kept]:
        _delete(spark, path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most that many rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def join_small(big: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Null-safe join of big with a table that has one row per key and is usually small.

    The small side is broadcast only after its rows have been counted; beyond BROADCAST_ROWS both sides get a salt, so
    that a key with a third of all rows spreads over SALTS tasks.
    """
    right = small.withColumnRenamed(key, "__cl_key")
    same = F.col(key).eqNullSafe(F.col("__cl_key"))
    if is_small(small):
        return big.join(F.broadcast(right), same, how).drop("__cl_key")
    salted = big.withColumn("__cl_salt", (F.rand(7) * SALTS).cast("int"))
    right = right.withColumn("__cl_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(right, same & (F.col("__cl_salt") == F.col("__cl_salt2")), how).drop("__cl_key", "__cl_salt", "__cl_salt2")


def worker_state(key: Any, make: Callable[[], Any]) -> Any:
    """A value kept for the life of a Python worker, over tasks; make() must depend on key alone."""
    holder = sys.modules.setdefault("_corpusloom_worker_state", types.ModuleType("_corpusloom_worker_state"))
    if key not in holder.__dict__:
        holder.__dict__[key] = make()
    return holder.__dict__[key]
