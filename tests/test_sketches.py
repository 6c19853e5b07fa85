"""Mergeable sketches against exact quantiles and counts, within the errors that are stated."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from inkling.operators import sketches as S


def test_hourly_sketches_roll_up_to_any_window(spark):
    rng = np.random.default_rng(0)
    n = 30_000
    rows = [(int(k), int(t), float(v), int(u)) for k, t, v, u in zip(rng.choice([1, 1, 1, 2], n), rng.integers(0, 48 * 3600, n), rng.lognormal(size=n), rng.integers(0, 4000, n))] + [(1, 5, None, 7), (3, 5, None, 7)]
    events = spark.createDataFrame(rows, "key int, s long, x double, user long").withColumn("ts", F.timestamp_seconds("s")).repartition(6)
    store = S.hourly_sketches(events, "key", "ts", "x", "user")
    requests = spark.createDataFrame([(1, 1, 40), (2, 1, 3), (3, 2, 48), (4, 3, 9), (5, 1, 0)], "req_id long, key int, h int").withColumn("hour", F.timestamp_seconds(F.col("h") * 3600))
    out = {r.req_id: r for r in S.over_windows(requests, store, "key", "hour", 24).select("req_id", "n", S.quantile(0.5).alias("q50"), S.quantile(0.9).alias("q90"), S.distinct().alias("u")).collect()}
    assert set(out) == {1, 2, 3}
    for i, key, h in ((1, 1, 40), (2, 1, 3), (3, 2, 48)):
        mine = [r for r in rows if r[0] == key and (h - 24) * 3600 <= r[1] < h * 3600 and r[2] is not None]
        x, r = np.sort([v for _, _, v, _ in mine]), out[i]
        assert r.n == len(x)
        for q, p in ((r.q50, 0.5), (r.q90, 0.9)):
            assert (x < q).mean() <= p + S.RANK_ERROR + 1 / len(x) and (x <= q).mean() >= p - S.RANK_ERROR - 1 / len(x)
        users = len({u for *_, u in mine})
        assert abs(r.u / users - 1) < 4 * 1.04 / 2 ** (S.LG_K / 2)


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(1, 102)], "key int, x double").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    r = S.hourly_sketches(df, "key", "ts", "x").select(S.quantile(0.5).alias("m"), S.quantile(1.0).alias("top"), "n").first()
    assert (r.m, r.top, r.n) == (51.0, 101.0, 101)
    by = defaultdict(int)
    for r in S.merged(S.hourly_sketches(df, "key", "ts", "x").unionAll(S.hourly_sketches(df, "key", "ts", "x")), ["key"]).collect():
        by[r.key] += r.n
    assert by == {1: 202}
