"""What the operators share: reading, shared storage, row ids and Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts can be long, so batches are kept short.
BATCH_ROWS = 256

#: ASCII white space, the separators of words in every contract here.
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Stands for a null id in sorts and joins: below every real id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is unset and all runs on one machine, as in tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores added as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A string column as Python strings, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def ints(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A long column without nulls as numpy."""
    return batch.column(column).to_numpy(zero_copy_only=False)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """An Arrow schema from "name type" pairs of the few types used here."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(","))])


def words(text: str) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+``: bytes.split() without arguments splits at ASCII white space alone."""
    return text.encode("utf-8", "surrogatepass").split()


class BoundedCache(dict):
    """A dict for work on repeated keys in one Python worker; it starts afresh when it is full."""

    def __init__(self, limit: int = 1_500_000):
        super().__init__()
        self.limit = limit

    def room_for(self, n: int) -> None:
        if len(self) + n > self.limit:
            self.clear()
