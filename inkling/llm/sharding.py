"""Contiguous shards of equal bytes from global prefix sums.

Method: rows are range-partitioned by an order, each partition reports its total, a prefix over those
totals (one row per partition) gives every partition its start, and the running position of each row
is cut at equal targets. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_id, shuffle_partitions, table


def shard_by_bytes(df: DataFrame, order: list[str], size: str, n_shards: int) -> DataFrame:
    """Add ``shard`` (0..n_shards-1) and ``slot`` (gapless from 0 within a shard), in the order given.

    The shard of a row is that of its middle byte, so totals differ by less than the largest row on
    either side. ``df`` should be slim: it is written once to shared storage. Rows that agree on all
    order columns are interchangeable. Sizes that are all zero put everything in shard 0. An empty
    table gives an empty table.
    """
    parts = shuffle_partitions(df.sparkSession)
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    # One row per range partition: the window below has as many rows as there are partitions.
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    totals = (
        dealt.groupBy("_part")
        .agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_rows_before"),
            F.sum("_bytes").over(everything).alias("_all"),
        )
    )
    within = Window.partitionBy("_part").orderBy(*order)
    middle = F.col("_bytes_before") + F.col("_run") - (F.col(size) / 2)
    placed = (
        dealt.withColumn("_run", F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_row", F.row_number().over(within) - 1)
        .join(F.broadcast(totals), "_part")
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(F.when(F.col("_all") > 0, middle * n_shards / F.col("_all")).otherwise(0))).cast("int"))
        .withColumn("_row", F.col("_rows_before") + F.col("_row"))
    )
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(*df.columns, "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def text_bytes(column: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 of near equal bytes, contiguous in doc_id. Null text has size 8; a null doc_id sorts first."""
    slim = table(spark, sf_dir, "documents").select(
        "doc_id", row_id().alias("_id"), (text_bytes() + 8).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32")
    )
    out = shard_by_bytes(slim, ["_id", "text_crc32", "size"], "size", 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
