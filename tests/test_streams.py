"""Refresh by regret as a stream: caps whatever the batches, delayed labels, expiry, budgets by time."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inkling.sources.storage import materialize, shared_dir
from inkling.streaming import jobs

SCHEMA = "key long, at timestamp, label_ts long, err double"
#: (key, arrival, label's time, error): label 100 of key 1 comes in three parts, key 2 has labels that are known later, label 5000 never.
ROWS = [(1, 100, 100, 3.0), (2, 110, 400, 2.0), (1, 120, 100, 4.0), (1, 130, 130, 1.0), (2, 300, 300, 6.0), (1, 320, 100, 9.0), (3, 600, 600, 0.5), (2, 650, 5000, 8.0), (3, 700, 650, None), (1, 900, 900, 2.0)]


def put(spark, base, groups):
    for g in groups:
        spark.createDataFrame([(k, a, t, e) for k, a, t, e in g], "key long, at long, label_ts long, err double").withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(f"{base}/in")


@pytest.mark.parametrize("size", [1, 4, 10])
def test_regrets_whatever_the_batches(spark, size):
    base = shared_dir(spark)
    put(spark, base, [ROWS[i : i + size] for i in range(0, len(ROWS), size)])
    schema = spark.read.parquet(f"{base}/in").schema
    jobs.regret_log(jobs.file_stream(spark, f"{base}/in", schema, 1), "key", 10.0, base, lateness="10 minutes", keep_s=3600).awaitTermination()
    got = {(r.key, r.label_ts): r.e for r in jobs.regrets(spark, base, "key", "bigint").collect()}
    assert got.pop((2, 400), None) in (None, 2.0)  # known once the watermark is past it: with a lateness of ten minutes not yet, or just
    assert got == {(1, 100): 10.0, (1, 130): 1.0, (2, 300): 6.0, (3, 600): 0.5, (1, 900): 2.0}


def test_delayed_labels_and_expiry(spark):
    """A label's timer brings its error when the watermark comes by; a sum that has expired starts anew."""
    base = shared_dir(spark)
    rows = [(2, 110, 400, 2.0), (1, 120, 120, 4.0), (1, 1000, 1000, 1.0), (1, 5000, 5000, 1.0), (1, 5001, 120, 3.0), (1, 6000, 6000, 1.0)]
    put(spark, base, [[r] for r in rows])
    schema = spark.read.parquet(f"{base}/in").schema
    jobs.regret_log(jobs.file_stream(spark, f"{base}/in", schema, 1), "key", 10.0, base, lateness="1 second", keep_s=600).awaitTermination()
    log = spark.read.option("recursiveFileLookup", True).parquet(f"{base}/log")
    told = defaultdict(list)
    for r in log.collect():
        told[r.key, r.label_ts].append((r.version, r.e))
    assert told[2, 400] == [(1, 2.0)]  # emitted by its timer alone
    assert (1, 4.0) in told[1, 120] and (1, 3.0) in told[1, 120] and (2, 7.0) not in told[1, 120]


def test_budget_follows_the_time_that_has_passed(spark):
    base = shared_dir(spark)
    groups = [[(k, 100, 100, float(k)) for k in range(1, 6)], [(k, 300, 300, 1.0) for k in range(1, 6)]]
    put(spark, base, groups)
    facts = materialize(spark.createDataFrame([(k, 50, 1.0) for k in range(1, 6)], "key long, label_ts long, value double"))
    schema = spark.read.parquet(f"{base}/in").schema
    jobs.refresh_stream(jobs.file_stream(spark, f"{base}/in", schema, 1), facts, base, "key", "value", 0.015, 10.0, lateness="1 hour").awaitTermination()
    stored = spark.read.option("recursiveFileLookup", True).parquet(f"{base}/store").collect()
    by = defaultdict(set)
    for r in stored:
        by[r.stored_at].add(r.key)
    first, then = by[100] or by[300], by[300]
    assert len(first) == 1 and len(then) in (1, 3)
    if first == {5}:
        assert then == {4, 3, 2}  # 200 seconds at 0.015: three keys; key 5 starts anew
