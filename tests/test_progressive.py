"""Progressive jobs against exact ones and against plain Python."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkling.plans import decision_queries as Q
from inkling.operators.spec import FeatureSpec
from inkling.plans import progressive as T

DATA = "/root/testdata/sf0.01"


def test_progressive_linear_predictions(spark):
    """Every request once; the target holds where it says so; estimates are those of the pids that were read."""
    out = {r.req_id: r for r in Q.t2(spark, DATA).collect()}
    exact = {r.req_id: r.pred_value for r in T.exact_predictions(Q.supplier_rows(spark, DATA), Q.QUERIES_, T.linear_model(Q.WEIGHTS_, Q.BIAS_)).collect()}
    assert set(out) == set(exact) and all(r.met for r in out.values())
    assert all(r.pred_conf >= 0.95 for r in out.values())
    assert np.mean([abs(out[i].pred_value - exact[i]) <= 3.0 for i in exact]) >= 0.9
    assert 1 < max(r.rounds for r in out.values()) and min(r.qsample for r in out.values()) < 0.5
    rows = defaultdict(list)
    for r in Q.supplier_facts(spark, DATA).collect():
        rows[r.req_id].append(r)
    names = list(Q.QUERIES_)
    for i in list(exact)[:20]:
        last = out[i].trace.split(" ")
        assert len(last) == out[i].rounds
        shares = dict(zip(names, map(float, last[-1].split(","))))
        means = {q: np.mean([r[c] for r in rows[i] if r.pid < round(100 * shares[q])]) for q, (_, c) in Q.QUERIES_.items()}
        want = Q.BIAS_ + sum(Q.WEIGHTS_[q] * m for q, m in means.items())
        assert abs(out[i].pred_value - want) <= 1.0  # draws of low discrepancy around it


def test_progressive_influence_goes_where_it_counts(spark):
    """With one query that decides the prediction, the steps after the first round go to it alone."""
    out = T.progressive_predictions(Q.supplier_facts(spark, DATA), Q.QUERIES_, T.linear_model({"q_price": 1.0, "q_qty": 1e-6, "q_disc": 1e-6}, 0.0), max_error=1.0, min_conf=0.99, tsize=60_000, max_rounds=3)
    rows = out.collect()
    assert rows and not any(r.met for r in rows if float(r.trace.split(" ")[-1].split(",")[0]) < 1)
    for r in rows:
        for step in r.trace.split(" ")[1:]:
            price, qty, disc = map(float, step.split(","))
            assert price > 0.1 and (price >= 1 or qty == disc == 0.1)


@pytest.mark.parametrize("classifier", [False, True])
def test_progressive_model_to_the_end_is_the_exact_job(spark, classifier):
    predict, extra = Q.revenue_model(spark, "/root/testdata/sf0.001")
    if classifier:
        inner = predict
        predict = lambda df: inner(df).withColumn("pred", (F.col("pred") > 20).cast("double"))
    d = "/root/testdata/sf0.001"
    out = T.progressive_predictions(Q.supplier_facts(spark, d), Q.FOREST_QUERIES, predict, max_error=0.0, min_conf=1.1, tsize=6000, extra=extra, classifier=classifier, alpha=50, beta=50)
    exact = {r.req_id: r.pred_value for r in T.exact_predictions(Q.supplier_rows(spark, d), Q.FOREST_QUERIES, predict, extra).collect()}
    got = {r.req_id: r.pred_value for r in out.collect()}
    assert set(got) == set(exact) and all(abs(got[i] - exact[i]) < 1e-6 for i in exact)


def test_rounds_read_open_requests_alone(spark):
    """Facts of a request that is not in the plan, or outside its ranges, add nothing."""
    facts = spark.createDataFrame([(i, p, float(10 * i + p)) for i in (1, 2, 3) for p in range(10)], "key long, pid int, x double")
    plan = spark.createDataFrame([(1, 1, 0.2, 0.5), (3, 3, 0.5, 0.5)], "req_id long, k_key long, qs_0 double, qn_0 double")
    q = [T._query(0, FeatureSpec("group", {"q": ("avg", "x")}, facts, ["key"]), False)]
    got = T.matched(plan, q, 10, {0: (2, 5)}).groupBy("req_id").agg(*T.partials(q, True)).collect()
    assert [(r.req_id, r.n_0_0, r.s_0_0, r.b_n_0_0, r.b_s_0_0) for r in got] == [(1, 3, 12.0 + 13 + 14, 2, 12.0 + 13)]


def test_only_wanted_columns_and_pids_are_read(spark, tmp_path):
    """The scan of a round has the key, the pid and the aggregated column, and its pid range is pushed down."""
    spark.range(100).selectExpr("id % 3 AS key", "cast(id % 10 AS int) AS pid", "cast(id AS double) AS x", "'long text' AS t", "1.0 AS y").write.parquet(f"{tmp_path}/f")
    facts = spark.read.parquet(f"{tmp_path}/f")
    plan = spark.createDataFrame([(1, 1, 0.2, 0.5)], "req_id long, k_key long, qs_0 double, qn_0 double")
    q = [T._query(0, FeatureSpec("group", {"q": ("avg", "x")}, facts, ["key"]), False)]
    out = T.matched(plan, q, 10, {0: (2, 5)}).groupBy("req_id").agg(*T.partials(q, False))
    text = out._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in text.split("\n") if "FileScan parquet" in x)
    assert "ReadSchema: struct<key:bigint,pid:int,x:double>" in scan and "GreaterThanOrEqual(pid,2)" in scan and "LessThan(pid,5)" in scan
    assert out.first().n_0_0 == sum(i % 3 == 1 and 2 <= i % 10 < 5 for i in range(100))
