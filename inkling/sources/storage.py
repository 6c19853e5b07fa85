"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset and all runs on one machine, as in tests, below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, partition_by: list[str] | None = None, rows_a_file: int = 0) -> DataFrame:
    """Write a table and read it back: lineage ends here and lost executors cost nothing. A file has at most ``rows_a_file`` rows, if that is given."""
    path = shared_dir(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("maxRecordsPerFile", rows_a_file).parquet(path)
    reader = df.sparkSession.read
    return (reader if partition_by else reader.schema(df.schema)).parquet(path)
