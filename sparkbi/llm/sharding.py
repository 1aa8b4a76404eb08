"""Contiguous shards of nearly equal bytes from a global prefix sum.

Rows are put in blocks that follow the document order. Only one total per block is carried
across blocks, so the prefix sum of a row is its block's offset plus a running sum inside
the block. A shard owns an equal stretch of the whole byte line, and a row belongs to the
shard that holds its middle byte: sizes differ by at most one document.

Nulls: a null text has no bytes and counts one, like an empty text. A null id sorts first.
Repeated ids are ordered by size and checksum; rows equal in all three are interchangeable.
An empty table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from sparkbi.llm.common import saved


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns: id, ``size``, ``text_crc32``, ``shard`` (0 to shards-1) and ``slot`` (place in the shard from 0)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = F.coalesce(F.col(text_column), F.lit(""))
    narrow = docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        # keeps a row that is repeated very often from filling one block
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["id", "size", "crc", "tie"]
    rows = saved(narrow.repartitionByRange(*order).withColumn("block", F.spark_partition_id()))

    # One row per block, however many rows the blocks hold.
    upto = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    blocks = (
        rows.groupBy("block")
        .agg(F.sum("size").alias("block_bytes"), F.count(F.lit(1)).alias("block_rows"))
        .select(
            "block",
            F.coalesce(F.sum("block_bytes").over(upto), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("block_rows").over(upto), F.lit(0)).alias("rows_before"),
            F.sum("block_bytes").over(everything).alias("total"),
        )
    )
    here = W.partitionBy("block").orderBy(*order)
    before = F.sum("size").over(here.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    placed = (
        rows.withColumns({"before": before, "place": F.row_number().over(here) - 1})
        .join(blocks, "block")
        .withColumn("middle", F.col("before") + F.col("bytes_before") + F.floor(F.col("size") / 2))
        .select(
            "id",
            "size",
            "crc",
            F.expr(f"least(cast(middle * {shards} div total as int), {shards - 1})").alias("shard"),
            (F.col("place") + F.col("rows_before")).alias("position"),
        )
    )
    starts = placed.groupBy("shard").agg(F.min("position").alias("first"))  # at most one row per shard
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id_column),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("position") - F.col("first")).cast("long").alias("slot"),
    )
