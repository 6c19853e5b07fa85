"""Ranks, running sums, lags and quantiles over global orders or hot keys, without one task for all rows of a key.

Rows are range-partitioned by (key, order) and written once; every partition reports a total for each of its keys, and what the
totals before it add up to is carried into the partition. Rows that agree on all order columns share a partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkling.sources.storage import materialize


def dealt(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in ranges of ``order``, with the range's number as ``_part``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def before(keys: list[str]):
    """Earlier ranges of the same key: rows are totals, one for each key and range."""
    return Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def with_carried(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``carried`` for their range and key; null keys are a key."""
    right = carried.withColumnsRenamed({k: f"_r{k}" for k in ["_part", *keys]})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys], F.col("_part") == F.col("_r_part"))
    return rows.join(right, same).drop(*[f"_r{k}" for k in ["_part", *keys]])


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``name``: 1-based number of the row within its key."""
    rows = dealt(df, [*keys, *order])
    carried = rows.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n")).select("_part", *keys, F.coalesce(F.sum("_n").over(before(keys)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    return with_carried(rows.withColumn(name, within), carried, keys).withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``name``: ``value`` of the row before within the key; null for the first."""
    rows = dealt(df, [*keys, *order])
    last = rows.groupBy("_part", *keys).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    carried = last.select("_part", *keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")).alias("_last"))
    w = Window.partitionBy("_part", *keys).orderBy(*order)
    rows = rows.withColumn("_row", F.row_number().over(w)).withColumn(name, F.lag(value).over(w))
    return with_carried(rows, carried, keys).withColumn(name, F.when(F.col("_row") == 1, F.col(f"_last.{value}")).otherwise(F.col(name))).select(*df.columns, name)


def sums_below(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """Sums over the key's rows with a smaller (integer) ``order``; null where there are none."""
    rows = dealt(df.withColumns(sums), [*keys, order])
    totals = rows.groupBy("_part", *keys).agg(*[F.sum(n).alias(n) for n in sums])
    carried = totals.select("_part", *keys, *[F.sum(n).over(before(keys)).alias(f"_c_{n}") for n in sums])
    w = Window.partitionBy("_part", *keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.sum(n).over(w) for n in sums})
    return with_carried(rows, carried, keys).select(*df.columns, *[F.coalesce(F.col(n) + F.col(f"_c_{n}"), n, f"_c_{n}").alias(n) for n in sums])


def quantiles(df: DataFrame, column: str, shares: dict[str, float], ties: list[str] = ()) -> DataFrame:
    """One row: interpolated quantiles of ``column`` by name. Equal values are spread by ``ties``; only ranges that hold a wanted rank are sorted."""
    order = [column, *ties]
    rows = dealt(df.filter(F.col(column).isNotNull()).select(*order), order)
    counted = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", "_n", F.coalesce(F.sum("_n").over(before([])), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    wants = counted.withColumn("_w", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), ((F.col("_all") - 1) * F.lit(float(p))).alias("at")) for n, p in shares.items()]))).select("_part", "_before", "_n", "_w.*")
    wants = wants.filter((F.floor("at") < F.col("_before") + F.col("_n")) & (F.ceil("at") >= F.col("_before")))  # at most two rows for each share
    sought = rows.join(F.broadcast(wants.select("_part", "_before").distinct()), "_part")
    ranked = sought.withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    found = ranked.select("_part", "_rank", column).join(F.broadcast(wants.select("_part", "name", "at")), "_part").filter((F.col("_rank") == F.floor("at")) | (F.col("_rank") == F.ceil("at")))

    def value(name):
        mine = F.col("name") == name
        lo, hi = (F.max(F.when(mine & (F.col("_rank") == end("at")), F.col(column))) for end in (F.floor, F.ceil))
        over = F.max(F.when(mine, F.col("at") - F.floor("at")))
        return F.when(lo == hi, lo.cast("double")).otherwise(lo * (1 - over) + hi * over).alias(name)

    return found.agg(*[value(n) for n in shares])


def grouped_quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """One row per key: interpolated quantiles of ``column`` by name. Equal values are counted first; a key's values spread over ranges."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    rows = dealt(counted, [*keys, column])
    totals = rows.groupBy("_part", *keys).agg(F.sum("_n").alias("_n"))
    carried = totals.select("_part", *keys, F.coalesce(F.sum("_n").over(before(keys)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    run = F.sum("_n").over(Window.partitionBy("_part", *keys).orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    ranked = with_carried(rows.withColumn("_to", run), carried, keys).withColumn("_to", F.col("_to") + F.col("_before"))

    def at(p, end):
        rank = end((F.col("_all") - 1) * F.lit(float(p)))
        return F.max(F.when((rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_n")), F.col(column).cast("double")))

    ends = ranked.groupBy(*keys).agg(F.max("_all").alias("_all"), *[at(p, end).alias(f"_{name}_{k}") for name, p in shares.items() for k, end in enumerate((F.floor, F.ceil))])
    over = {n: (F.col("_all") - 1) * F.lit(float(p)) - F.floor((F.col("_all") - 1) * F.lit(float(p))) for n, p in shares.items()}
    return ends.select(*keys, *[(F.col(f"_{n}_0") * (1 - w) + F.col(f"_{n}_1") * w).alias(n) for n, w in over.items()])
