"""Reading, cleaning, sampling partitions and hourly stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkling.functions.hashing import pid
from inkling.operators.ranges import row_numbers

FOLDER_LABELS = ["normal", "6g", "10g", "15g", "20g", "25g", "30g"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path, schema: T.StructType, *, header: bool = True, sep: str = ",", recursive: bool = False) -> DataFrame:
    """Typed CSV or TSV, plain or gzipped, one file, a glob or a tree of folders."""
    reader = spark.read.schema(schema).option("header", header).option("sep", sep).option("recursiveFileLookup", recursive)
    return reader.csv(path)


def from_path(labels: list[str] | None = None) -> dict[str, Column]:
    """label (place of the parent folder among ``labels``), tag (file stem), and unit and cycle of stems "unit-cycle"."""
    path = F.col("_metadata.file_path")
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]+)*$", 1)
    folder = F.array_position(F.array(*map(F.lit, labels or FOLDER_LABELS)), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)) - 1
    return {"label": F.when(folder >= 0, folder), "tag": stem, "unit": F.split(stem, "-")[0].try_cast("int"), "cycle": F.try_element_at(F.split(stem, "-"), F.lit(2)).try_cast("int")}


def with_metadata(rows: DataFrame, metadata: DataFrame, *, kind: str, file_col: str = "filename") -> DataFrame:
    """Rows of the files that ``metadata`` lists with ``type = kind``; Timestamp = start_time (a list as text) + Time seconds."""
    wanted = metadata.filter(F.col("type") == kind).select(file_col, F.split(F.regexp_replace("start_time", r"[\[\]]", ""), r"[,\s]+").alias("_s"))
    at = lambda k: F.try_element_at(F.filter("_s", lambda x: x != ""), F.lit(k)).try_cast("double")
    start = F.make_timestamp(at(1).cast("int"), at(2).cast("int"), at(3).cast("int"), at(4).cast("int"), at(5).cast("int"), at(6))
    return rows.join(wanted, file_col).withColumn("Timestamp", F.timestamp_micros(F.unix_micros(start) + F.round(F.col("Time") * 1000).cast("long") * 1000)).drop("_s")


def block_ids(df: DataFrame, file_col: str, seq_col: str, rows: int) -> DataFrame:
    """``bid``: blocks of ``rows`` rows of a file, numbered over its sequence column."""
    return row_numbers(df, [file_col], [seq_col], "bid").withColumn("bid", F.floor((F.col("bid") - 1) / rows).cast("long"))


def assign_pid(df: DataFrame, key: list[str], nparts: int = 100, seed: int = 0) -> DataFrame:
    """A sampling partition for every row from its key: stateless, seedable, without row numbers or a shuffle."""
    return df.withColumn("pid", pid(nparts, *[F.col(k) for k in key], seed=seed))


def write_sampled(df: DataFrame, path: str, sort: list[str], mode: str = "errorifexists") -> None:
    """One folder for each pid, so that a sample reads only its folders; sorted within files for row-group statistics."""
    df.repartition("pid").sortWithinPartitions("pid", *sort).write.mode(mode).partitionBy("pid").parquet(path)


def missing_days(new: DataFrame, loaded_days: DataFrame, ts: str) -> DataFrame:
    """Rows of days that are not loaded yet."""
    return new.withColumn("day", F.to_date(ts)).join(loaded_days.select("day").distinct(), "day", "left_anti")


HOURLY = {"count": F.count, "avg": F.avg, "sum": F.sum, "varPop": F.var_pop, "stddevPop": F.stddev_pop, "median": F.median, "min": F.min, "max": F.max}


def hourly_store(df: DataFrame, keys: list[str], ts: str, values: list[str], ops: list[str] | None = None) -> DataFrame:
    """Eight aggregates of each value by key and hour, in one shuffle."""
    aggs = [HOURLY[o](v).alias(f"{o}_{v}") for v in values for o in (ops or HOURLY)]
    return df.groupBy(*keys, F.date_trunc("hour", ts).alias("hour_ts")).agg(*aggs)


def subset(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    return df.join(ids.select(*on).distinct(), on, "left_semi")


def sensors_long(df: DataFrame, ids: list[str], sensors: list[str]) -> DataFrame:
    """One row for each sensor and reading, in one pass."""
    return df.unpivot(ids, sensors, "sensor", "signal")


def statistics(df: DataFrame) -> DataFrame:
    """Rows of each pid."""
    return df.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles, max."""
    from inkling.operators.ranges import grouped_quantiles

    long = df.select(*columns).unpivot([], columns, "column", "x")
    simple = long.groupBy("column").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return simple.join(grouped_quantiles(long, ["column"], "x", {"p25": 0.25, "p50": 0.5, "p75": 0.75}), "column", "left")


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)
