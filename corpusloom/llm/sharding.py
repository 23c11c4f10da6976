"""Contiguous shards of nearly equal bytes from a global prefix sum (DataFrame operations only).

Rows get a total order (hash of the text, id), so copies of a text stand side by side. A range exchange spreads that
order over partitions (the id is part of the range key, so a group of copies with a third of all rows is split); the
partitions' byte and row totals, one row for each, give every partition its start in the global sums; a window inside
each partition does the rest. A row belongs to the shard in which the middle of its byte range lies, so each shard
differs from an equal share by at most the size of one document.

Cases: a null text counts 0 bytes plus the overhead and has the CRC of the empty text; equal rows stay separate rows; an
empty table gives an empty result; other columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, read

OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in each shard)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    meta = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + overhead).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "shard-meta",
    )
    ranged = materialize(meta.repartitionByRange("h", "id").withColumn("part", F.spark_partition_id()), "shard-ranged")
    # One row per partition: small, whatever the number of documents.
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("part").alias("p"),
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy("h", "id")
    running = ranged.select(
        "*",
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("bytes_to"),
        F.row_number().over(inside).alias("row_in_part"),
    )
    placed = running.join(starts, F.col("part") == F.col("p")).select(
        "id",
        "size",
        "text_crc32",
        F.expr(f"int((2 * (bytes_before + bytes_to) - size) * {int(shards)} div (2 * total))").alias("shard"),
        (F.col("rows_before") + F.col("row_in_part") - 1).alias("row"),
    )
    # At most one row per shard, so the broadcast is bounded by the parameter.
    first = placed.groupBy(F.col("shard").alias("s")).agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(first), F.col("shard") == F.col("s")).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sharding": op6_sharding}
