"""Windows by ranges of ranks against plain Python, and how many rows they make."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkling.operators import windows as W
from inkling.operators.spec import FeatureSpec, assemble


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    facts = [(int(k), int(t), None if x > 0.97 else float(np.round(x * 50)), str(int(x * 7))) for k, t, x in zip(rng.choice([1, 1, 1, 1, 2, 3], 900), rng.integers(0, 300, 900), rng.random(900))]
    facts += [(1, None, 3.0, "a"), (None, 4, 1.0, "b")]
    requests = [(i, int(k), int(t), int(t + w)) for i, (k, t, w) in enumerate(zip(rng.choice([1, 1, 2, 3, 4], 150), rng.integers(-20, 300, 150), rng.choice([0, 1, 5, 50, 400], 150)))] + [(999, None, 0, 5)]
    return facts, requests, spark.createDataFrame(facts, "key long, ts long, x double, s string"), spark.createDataFrame(requests, "req_id long, key long, _lo long, _hi long")


FEATURES = {op: (op, "x") for op in W.OPERATORS} | {"us": ("unique", "s"), "cs": ("count", "s")}


def plain(facts, key, lo, hi):
    rows = [r for r in facts if r[0] == key and r[1] is not None and lo <= r[1] < hi]
    if not rows or key is None:
        return None
    x = np.array([r[2] for r in rows if r[2] is not None])
    n = len(x)
    out = {"count": n, "unique": len(set(x)), "us": len({r[3] for r in rows}), "cs": len(rows)}
    some = {"sum": x.sum, "avg": x.mean, "varPop": x.var, "stdPop": x.std, "min": x.min, "max": x.max} | {q: (lambda p=p: np.quantile(x, p)) for q, p in W.QUANTILES.items()}
    out |= {k: float(f()) if n else None for k, f in some.items()}
    return out | {"varSamp": x.var(ddof=1) if n > 1 else None, "stdSamp": x.std(ddof=1) if n > 1 else None}


def same(got, want):
    return all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) <= 1e-9 * max(1, abs(v))) for k, v in want.items())


@pytest.mark.parametrize("few", [0, 10**9])
def test_every_aggregate_over_ranges_and_over_matches(data, few, monkeypatch):
    facts, requests, f, r = data
    monkeypatch.setattr(W, "FEW", few)
    got = {x.req_id: x for x in W.between(r, f, ["key"], 400, FEATURES).collect()}
    for i, k, lo, hi in requests:
        want = plain(facts, k, lo, hi)
        assert (i in got) == (want is not None) and (want is None or same(got[i], want))


def test_expanding_medians_and_greatest_values(data, monkeypatch):
    """An expanding specification may have any aggregate, and may be swapped to one."""
    facts, requests, f, r = data
    monkeypatch.setattr(W, "FEW", 0)
    asked = r.select("req_id", "key", F.col("_hi").alias("req_ts"))
    spec = FeatureSpec("expanding", {"avg": ("avg", "x"), "max": ("max", "x")}, f, ["key"])
    for s, names in ((spec, ["avg", "max"]), (spec.swapped("avg", "median"), ["median", "max"])):
        got = {x.req_id: x for x in assemble(asked, [s]).collect()}
        assert len(got) == len(requests)
        for i, k, _, hi in requests:
            want = plain(facts, k, -(10**9), hi) or dict.fromkeys(["avg", "median", "max"])
            assert all(abs(got[i][c] - (want[n] or 0.0)) < 1e-9 for c, n in zip(["avg", "max"], names))


def test_rows_follow_requests_and_facts(spark, monkeypatch):
    """Nodes that ranges meet, counted at two sizes: matches grow with the square, nodes don't."""
    monkeypatch.setattr(W, "FEW", 0)
    counts = []
    for n in (2_000, 20_000):
        facts = spark.range(n).select((F.col("id") % 3).alias("key"), F.col("id").alias("ts"))
        requests = spark.range(n // 100).select(F.col("id").alias("req_id"), (F.col("id") % 3).alias("key"), F.lit(n // 7).cast("long").alias("_lo"), (F.col("id") * 50 + n // 2).alias("_hi"))
        rows = W.ranked(facts, ["key"])
        ranges = W.positions(requests, rows, ["key"])
        matches = ranges.agg(F.sum(F.col("_b") - F.col("_a"))).first()[0]
        nodes = W.nodes_of(ranges, W.levels(n))
        made = nodes.groupBy("req_id").agg(F.sum(F.pow(F.lit(float(W.FAN)), F.col("_l"))).alias("n")).join(ranges, "req_id")
        assert made.filter(F.col("n") != F.col("_b") - F.col("_a")).isEmpty()
        counts.append((matches, nodes.count()))
    assert counts[1][0] > 80 * counts[0][0] and counts[1][1] < 20 * counts[0][1]


def test_of_nothing(data):
    _, _, f, r = data
    assert W.range_features(r.filter("req_id < 0"), f, ["key"], FEATURES).collect() == []
    assert W.range_features(r, f.filter("ts < -5"), ["key"], FEATURES).collect() == []


def test_nodes_are_not_sent_to_the_driver(data):
    """A range has many nodes, which Spark doesn't foresee: small ranges would be broadcast with all their nodes."""
    _, _, f, r = data
    rows = W.ranked(W.known(f, ["ts", "key"]), ["key"])
    nodes = W.nodes_of(W.positions(W.known(r, ["key"]), rows, ["key"]), 3)
    told = W._moments(rows, nodes, ["key"], {"n": ("count", "x"), "m": ("avg", "x")}, 3)
    assert "Broadcast" not in told._jdf.queryExecution().executedPlan().toString()
    assert told.count() > 0
