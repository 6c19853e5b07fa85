"""Streaming forms: hourly store, scoring of requests, refresh by feedback."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from inkling.operators import sketches as S


def hourly_store_stream(events: DataFrame, key: str, ts: str, value: str, lateness: str = "1 hour") -> DataFrame:
    """Tumbling hours with a watermark, for append mode. Exact medians are not incremental, so the stream has none."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(key, F.window(ts, "1 hour"))
        .agg(F.count(value).alias(f"count_{value}"), F.sum(value).alias(f"sum_{value}"), F.avg(value).alias(f"avg_{value}"), F.min(value).alias(f"min_{value}"), F.max(value).alias(f"max_{value}"))
        .select(key, F.col("window.start").alias("hour_ts"), f"count_{value}", f"sum_{value}", f"avg_{value}", f"min_{value}", f"max_{value}")
    )


def sketch_store_stream(events: DataFrame, key: str, ts: str, value: str, distinct: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """(key, hour_ts, n, q, d): hourly sketches in append mode, from which medians, quantiles and distinct counts of any hours come (``operators.sketches``)."""
    known = events.withWatermark(ts, lateness).filter(F.col(value).isNotNull())
    told = known.groupBy(key, F.window(ts, "1 hour")).agg(*S.aggregates(value, distinct))
    return told.select(key, F.col("window.start").alias("hour_ts"), "n", "q", *(["d"] if distinct else []))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there into parquet, with the exactly-once guarantee of the file sink."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def score_requests(requests: DataFrame, facts: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Stream-static window join: each streaming request with count and mean of its trailing window.

    The request's aggregates end with its micro-batch, so they are computed per batch by the caller's ``foreachBatch``.
    """
    from inkling.operators.matching import with_defaults
    from inkling.operators.windows import trailing

    told = trailing(requests, facts, keys, width, {"n": ("count", "value"), "mean": ("avg", "value")})
    return with_defaults(requests.select("req_id"), told, "req_id", {"n": 0.0, "mean": 0.0}).withColumn("n", F.col("n").cast("long"))


def for_each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: State of a key: label times in order, their raw sums of errors, rows added, and whether the label's time was still to come.
REGRET_STATE = "at binary, err binary, version binary, due binary"


def _regret(name: str, cap: float, keep_ms: int) -> Callable:
    """Errors of one key by label time: raw sums, so that a cap holds however they come in batches.

    An error counts from its label's time on: at once where that has come, else when the watermark reaches it, by the key's timeout. What
    changes is emitted as (key, label_ts, e, version), e being the capped sum. Sums that the watermark has left ``keep_ms`` behind expire.
    A key's state is read and written once a batch, and its rows are added up together; its timeout is the first time anything falls due.
    """
    kinds = (np.int64, np.float64, np.int64, np.bool_)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, err, version, due = (np.frombuffer(x, t) for x, t in zip(state.get, kinds)) if state.exists else (np.empty(0, t) for t in kinds)
        now, told = state.getCurrentWatermarkMs(), np.zeros(len(at), bool)
        if not state.hasTimedOut:
            rows = pd.concat(list(parts)).dropna(subset=["label_ts", "err"])
            label, known = rows["label_ts"].to_numpy(np.int64), rows["known"].to_numpy(bool)
            known |= label * 1000 <= now
            places, where = np.unique(np.r_[at, label], return_inverse=True)
            of_state, of_rows = where[: len(at)], where[len(at) :]
            sums, counts = np.bincount(of_state, err, len(places)), np.bincount(of_state, version, len(places)).astype(np.int64)
            err = sums + np.bincount(of_rows, rows["err"].to_numpy(float), len(places))
            version = counts + np.bincount(of_rows, minlength=len(places))
            later, told = np.zeros(len(places), bool), np.zeros(len(places), bool)
            later[of_state] = due
            later[of_rows[~known]] = True
            told[of_rows[known]] = True
            at, due = places, later
        come = due & (at * 1000 <= now)
        told, due = told | come, due & ~come
        if told.any():
            yield pd.DataFrame({name: [key[0]] * int(told.sum()), "label_ts": at[told], "e": np.minimum(err[told], cap), "version": version[told]})
        keep = at * 1000 + keep_ms > now
        at, err, version, due = (x[keep] for x in (at, err, version, due))
        if len(at):
            state.update(tuple(np.ascontiguousarray(x, t).tobytes() for x, t in zip((at, err, version, due), kinds)))
            state.setTimeoutTimestamp(int(min(at[0] * 1000 + keep_ms, at[due].min() * 1000 if due.any() else 2**62)))
        elif state.exists:
            state.remove()

    return step


def regret_updates(feedback: DataFrame, key: str, cap: float, lateness: str = "1 hour", keep_s: int = 86400) -> DataFrame:
    """(key, label_ts, e, version): capped errors by key and label time as they change, from streaming feedback (key, label_ts, err, and the
    timestamp ``at`` of its arrival; without one it arrives with its label). The state of a key is its own in a RocksDB store; see ``_regret``."""
    if "at" not in feedback.columns:
        feedback = feedback.withColumn("at", F.timestamp_seconds("label_ts"))
    rows = feedback.withWatermark("at", lateness).select(key, "at", "label_ts", "err", F.coalesce(F.col("label_ts") <= F.unix_timestamp("at"), F.lit(False)).alias("known"))
    kind = feedback.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(_regret(key, cap, keep_s * 1000 + 1), f"{key} {kind}, label_ts long, e double, version long", REGRET_STATE, "update", "EventTimeTimeout")


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that start in here keep their state in RocksDB, which state by key asks for."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def regret_log(feedback: DataFrame, key: str, cap: float, base: str, each: Callable[[DataFrame, int], None] | None = None, **settings) -> StreamingQuery:
    """Appends ``regret_updates`` to ``base``/log, a folder a batch (a repeated batch writes the same again), and then calls ``each``."""

    def step(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/log/batch={k}")
        if each:
            each(batch, k)

    with keyed_state(feedback.sparkSession):
        updates = regret_updates(feedback, key, cap, **settings)
        return updates.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()


def regrets(spark: SparkSession, base: str, key: str, kind: str) -> DataFrame:
    """(key, label_ts, e) as they stand after the batches in ``base``/log."""
    log = spark.read.schema(f"{key} {kind}, label_ts long, e double, version long").option("recursiveFileLookup", True).parquet(f"{base}/log")
    return log.groupBy(key, "label_ts").agg(F.max_by("e", "version").alias("e"))


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def refresh_stream(feedback: DataFrame, facts: DataFrame, base: str, key: str, value: str, budget: int | float, cap: float, **settings) -> StreamingQuery:
    """Refresh by regret: streaming feedback adds to the priorities of its keys, and each batch refreshes those of the largest.

    An integer ``budget`` is a number of keys a batch; a float is keys a second since the batch before (one in the first). A priority is the sum
    of the key's capped errors by label time since its refresh: errors are kept by ``regret_log``, whatever their batch, and only what
    changed is written. Chosen keys get count and mean of their ``facts`` before the batch's last label time below ``base``/store.
    """
    kind = feedback.schema[key].dataType.simpleString()

    def step(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        at = f"{base}/log/batch={k}"
        now = spark.read.schema("label_ts long").parquet(at).agg(F.max("label_ts")).first()[0]  # one number
        stores = spark.read.schema(f"{key} {kind}, n long, mean double, stored_at long").option("recursiveFileLookup", True)
        done = None
        for j in range(k):
            if _there(spark, f"{base}/store/{j}"):
                one = stores.parquet(f"{base}/store/{j}").select(key, "stored_at")
                done = one if done is None else done.unionByName(one)
        last = done.agg(F.max("stored_at")).first()[0] if done is not None else None
        if now is None:
            return
        count = budget if isinstance(budget, int) else 1 if last is None else int((now - last) * budget)
        waiting = regrets(spark, base, key, kind)
        if done is not None:
            waiting = waiting.join(done.groupBy(key).agg(F.max("stored_at").alias("stored_at")), key, "left").filter(F.col("stored_at").isNull() | (F.col("label_ts") > F.col("stored_at")))
        chosen = waiting.groupBy(key).agg(F.sum("e").alias("priority")).orderBy(F.desc("priority"), key).limit(count).select(key)
        known = facts.filter(F.col("label_ts") < now).join(chosen, key, "left_semi")
        features = known.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).withColumn("stored_at", F.lit(now).cast("long"))
        features.write.mode("overwrite").parquet(f"{base}/store/{k}")

    return regret_log(feedback, key, cap, base, step, **settings)


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
