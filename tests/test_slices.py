"""Samples of windows as slices: the same as by matches, chosen where matches are many, and none made then."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkling.operators import resample as B
from inkling.operators import slices as S
from inkling.operators.spec import FeatureSpec
from inkling.plans import progressive as T
from inkling.sources.storage import materialize

WIDTH = 100
OPS = ["median", "min", "max", "unique", "percentile90", "varSamp", "stdPop", "avg", "sum"]


@pytest.fixture(scope="module")
def facts(spark):
    rng = np.random.default_rng(1)
    n = 1500
    rows = [(int(k), int(t), int(p), i, None if x > 0.95 else float(np.round(x * 40)), str(int(x * 9)), float(i % 7)) for i, (k, t, p, x) in enumerate(zip(rng.choice([1, 1, 1, 2], n), rng.integers(0, 400, n), rng.integers(0, 20, n), rng.random(n)))]
    return materialize(spark.createDataFrame([*rows, (1, None, 3, -1, 1.0, "a", 1.0), (None, 50, 3, -2, 1.0, "a", 1.0)], "key long, ts long, pid int, row long, x double, s string, y double"))


@pytest.fixture(scope="module")
def requests(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(k), int(t)) for i, (k, t) in enumerate(zip(rng.choice([1, 1, 2, 3], 60), rng.integers(-20, 520, 60)))]
    return materialize(spark.createDataFrame([*rows, (98, None, 50), (99, 1, None)], "req_id long, key long, req_ts long"))


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and np.allclose(np.array(a, float), np.array(b, float), atol=1e-7, equal_nan=True))


@pytest.mark.parametrize("keep, span", [(False, WIDTH), (True, 170)])
def test_slices_equal_the_matches(spark, facts, requests, keep, span, monkeypatch):
    """Partials of pids that are new to a request, and resamples of all it has read by then, where requests have read differently far."""
    monkeypatch.setattr(S, "TASKS", 4)
    monkeypatch.setattr(S, "SIDE", 3000)  # replicates in some parts
    closed = FeatureSpec("trailing", {"n": ("count", "x"), "m": ("avg", "y"), "c": ("count", "s")}, facts, ["key"], WIDTH, row_key=["row"])
    told = FeatureSpec("trailing", {f"f_{op}": (op, "x") for op in OPS} | {"us": ("unique", "s")}, facts, ["key"], WIDTH, row_key=["row"])
    queries = [T._query(0, closed, False), T._query(1, told, True)]
    step = F.col("req_id") % 3
    plan = materialize(requests.withColumnRenamed("key", "k_key").withColumns({"qs_0": step * 0.1, "qn_0": step * 0.1 + 0.2, "qs_1": F.lit(0.0), "qn_1": F.when(step == 0, 0.0).when(step == 1, 0.45).otherwise(0.8), "st_1": F.lit(None).cast(f"array<{B.STATE_DDL}>")}))
    ends = {0: (0, 8), 1: (0, 16)}
    met = T.matched(plan, queries, 20, ends)
    sums = {r.req_id: r for r in met.groupBy("req_id").agg(*T.partials(queries, False)).collect()}
    boot = {r.req_id: r for r in T.resampled(plan.withColumn("qs_1", F.col("qn_1")), met, queries[1], 0.05, 12, 10**6, keep, None, 3).collect()}
    got = {r.req_id: r for r in S.sampled(plan, queries, span, 20, ends, {0: 8, 1: 16}, 12, keep, None, 3).collect()}
    assert set(got) >= {i for i, r in sums.items() if r.rows_0 or r.rows_1} and len(got) > 40
    for i, r in got.items():
        for c in [x for x in r.asDict() if x.split("_")[0] in ("rows", "n", "s", "ss")]:
            assert close(r[c] or 0, sums[i][c] or 0), (i, c)
        for c in ("rn_1", "rv_1", "re_1"):
            assert close(r[c], boot[i][c]), (i, c, r[c], boot[i][c])
        if keep and r.rr_1:
            assert all(close(a, b) for a, b in zip(r.rr_1, boot[i].rr_1))


def test_order_statistics_of_slices_against_plain_ones():
    rng = np.random.default_rng(3)
    x = np.where(rng.random(300) < 0.1, np.nan, np.round(rng.normal(size=300), 1))
    w = np.stack([np.ones(300, int), rng.poisson(1, 300), np.zeros(300, int)]).astype(np.int8)
    a = np.sort(rng.integers(0, 300, 40))
    b = np.maximum.accumulate(np.minimum(a + rng.integers(0, 80, 40), 300))
    n, told = S.slice_told(x, w, a, b, ["median", "percentile99", "min", "max", "unique", "avg"], 0.5)
    for k in range(40):
        assert n[k] == np.count_nonzero(~np.isnan(x[a[k] : b[k]]))
        for r in range(3):
            many = np.repeat(x[a[k] : b[k]], w[r, a[k] : b[k]])
            many = many[~np.isnan(many)]
            want = [np.median(many), np.quantile(many, 0.99), many.min(), many.max(), len(set(many)), many.mean()] if len(many) else [np.nan] * 4 + [0, np.nan]
            assert np.allclose([told[op][r, k] for op in told], want, equal_nan=True)
    odd = np.array([1.0, np.inf, 2.0, np.nan, 3.0])
    assert np.allclose(S.slice_sums(odd, np.array([0, 0, 2, 4]), np.array([1, 2, 5, 5])), [1.0, np.inf, np.nan, 3.0], equal_nan=True)


@pytest.mark.parametrize("settings", [{"max_error": 6.0, "min_conf": 0.8}, {"max_error": 0.0, "min_conf": 1.1, "alpha": 30, "beta": 70}, {"max_error": 6.0, "min_conf": 0.8, "draw_replicates": True}])
def test_jobs_by_slices_make_no_matches_and_answer_alike(spark, facts, requests, settings, monkeypatch):
    monkeypatch.setattr(S, "TASKS", 4)
    specs = [FeatureSpec("trailing", {"n": ("count", "x"), "m": ("avg", "y")}, facts, ["key"], WIDTH, row_key=["row"]), FeatureSpec("trailing", {"med": ("median", "x"), "u": ("unique", "s")}, facts, ["key"], WIDTH // 2, row_key=["row"])]
    job = lambda: {r.req_id: r for r in T.progressive_job(requests, specs, T.linear_model({"n": 0.1, "m": 1.0, "med": 1.0, "u": 1.0}, 0.0), ncfgs=20, draws=16, replicates=12, **{"alpha": 8, "beta": 4, **settings}).collect()}
    monkeypatch.setattr(S, "DENSE", 10**9)
    plain = job()
    assert S.stretch(requests, facts, ["key"], WIDTH) is None
    monkeypatch.setattr(S, "DENSE", 0)
    assert S.stretch(requests, facts, ["key"], WIDTH) >= WIDTH
    monkeypatch.setattr(T, "matched", None)  # no pair is made
    sliced = job()
    assert set(sliced) == set(plain) and len(plain) == 62
    for i, r in sliced.items():
        assert r.trace == plain[i].trace and r.met == plain[i].met and all(close(r[c], plain[i][c]) for c in ("pred_value", "pred_conf", "pred_var"))


def test_slices_are_told_once_a_round(spark, facts, requests, monkeypatch):
    """Draws and the next plan are made of a state that is written, and that no join sends to the driver."""
    monkeypatch.setattr(S, "TASKS", 4)
    monkeypatch.setattr(S, "DENSE", 0)
    plans, judge = [], T.judge

    def watched(*args):
        run = judge(*args)

        def both(state, *more):
            out = run(state, *more)
            plans.extend(x._jdf.queryExecution().executedPlan().toString() for x in (state, out))
            return out

        return both

    monkeypatch.setattr(T, "judge", watched)
    specs = [FeatureSpec("trailing", {"med": ("median", "x")}, facts, ["key"], WIDTH, row_key=["row"])]
    out = T.progressive_job(requests, specs, T.linear_model({"med": 1.0}, 0.0), max_error=6.0, min_conf=0.8, ncfgs=20, draws=8, replicates=8, max_rounds=1)
    assert out.count() == 62 and len(plans) == 2
    assert not any("FlatMapCoGroups" in p for p in plans) and "SortMergeJoin" in plans[1]
