"""Progressive jobs over feature specifications: no lost request, resampled errors, policies, influence and constraints."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkling.functions.hashing import hash32
from inkling.operators import allocate as L
from inkling.operators import estimate as E
from inkling.operators import policies as P
from inkling.operators import resample as B
from inkling.operators.spec import FeatureSpec
from inkling.plans import decision_queries as Q
from inkling.plans import online_queries as O
from inkling.plans import progressive as T
from inkling.sources.storage import materialize

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    """Facts of three keys, of 400, 90 and 3 rows, with pids; a fourth key has none."""
    rng = np.random.default_rng(0)
    rows = [(k, int(p), i, float(x), float(y)) for k, n in ((1, 400), (2, 90), (3, 3)) for i, (p, x, y) in enumerate(zip(rng.integers(0, 20, n), np.round(rng.normal(50, 9, n), 1), rng.integers(0, 30, n)))]
    return materialize(spark.createDataFrame([(*r[:2], r[0] * 1000 + r[2], *r[3:]) for r in rows], "key long, pid int, row long, x double, y double"))


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, 4), (14, 1), (15, None)], "req_id long, key long")


def test_no_request_is_lost(spark, table, requests):
    """Requests without facts, with a null key, with a null extra feature and without an extra row are all answered, by both jobs and by fitted models."""
    from inkling.operators import ml

    extra = spark.createDataFrame([(10, 1.0), (11, None), (13, 3.0)], "req_id long, e double")
    specs = [FeatureSpec("group", {"m": ("avg", "x"), "n": ("count", "x")}, table, ["key"])]
    known = spark.createDataFrame([(float(i), float(i % 7), float(i % 3), 2.0 * i) for i in range(60)], "m double, n double, e double, label double")
    for predict in (T.linear_model({"m": 1.0, "n": 0.1, "e": 10.0}, 0.0), T.ml_model(ml.make_model("tree", ["m", "n", "e"]).fit(known))):
        exact = {r.req_id: r.pred_value for r in T.exact_job(requests, specs, predict, extra).collect()}
        out = {r.req_id: r for r in T.progressive_job(requests, specs, predict, max_error=0.0, min_conf=1.1, extra=extra, ncfgs=20, alpha=10, beta=10, draws=8).collect()}
        assert set(exact) == set(out) == {10, 11, 12, 13, 14, 15}
        assert all(r.met and abs(r.pred_value - exact[i]) < 1e-6 for i, r in out.items())
        if "pred" in predict(known).columns and predict(known).columns[-1] == "pred" and exact[13] == 30.0:
            assert exact[15] == 0.0 and abs(exact[11] - exact[11]) < 1e-9


def test_facts_keyed_by_request_answer_the_requests_given(spark):
    facts = spark.createDataFrame([(1, p, float(p)) for p in range(10)], "req_id long, pid int, x double")
    asked = spark.createDataFrame([(1,), (2,)], "req_id long")
    predict = T.linear_model({"f": 2.0}, 1.0)
    got = T.progressive_predictions(facts, {"f": ("avg", "x")}, predict, tsize=10, requests=asked, max_error=0.0, min_conf=1.1, ncfgs=10, draws=8).collect()
    assert {r.req_id: round(r.pred_value, 9) for r in got} == {1: 10.0, 2: 1.0}
    assert {r.req_id: r.pred_value for r in T.exact_predictions(facts, {"f": ("avg", "x")}, predict, requests=asked).collect()} == {1: 10.0, 2: 1.0}


OPS = ["median", "min", "max", "unique", "percentile90", "percentile99", "varSamp", "stdPop", "avg"]


@pytest.mark.parametrize("keep", [False, True])
def test_resampled_states_equal_the_bootstrap_of_the_same_pids(spark, table, requests, keep):
    """Two rounds (pids 0 to 4, then 5 to 9) merged by state, against the plain bootstrap of pids 0 to 9 with the same weights."""
    spec = FeatureSpec("group", {f"f_{op}": (op, "x") for op in OPS}, table, ["key"], row_key=["row"])
    q = T._query(0, spec, True)
    plan = requests.select("req_id", F.col("key").alias("k_key"), F.lit(None).cast(f"array<{B.STATE_DDL}>").alias("st_0"))
    for lo, hi in ((0.0, 0.25), (0.25, 0.5)):
        state = plan.withColumns({"qs_0": F.lit(lo), "qn_0": F.lit(hi)})
        met = T.matched(state, [q], 20, {0: (round(lo * 20), round(hi * 20))})
        out = materialize(T.resampled(state.withColumn("qs_0", F.lit(hi)), met, q, 0.05, 20, 512, keep, None, 3))
        plan = out.select("req_id", "k_key", "st_0")
    got = {r.req_id: r for r in out.collect()}
    half = table.filter("pid < 10")
    chance = lambda rep: B.chance(3, rep, F.xxhash64("row"))
    boot = E.poisson_bootstrap(half, ["key"], ["row"], "x", 20, chance=chance)
    points = E.estimates(half, ["key"], "x", 0.5, 493, OPS, min_support=1)
    want = {(r.key, r.op): r for r in E.with_bootstrap(points, boot, ["key"], 0.5, min_support=1, keep=True).collect()}
    for req, key in ((10, 1), (11, 2), (14, 1)):
        for j, op in enumerate(OPS):
            w, r = want[key, op], got[req]
            assert abs(r.rv_0[j] - w.fval) < 1e-9
            if op != "avg":  # whose error has a closed form there
                assert abs(r.re_0[j] - w.fest) < 1e-9
                if keep:
                    assert np.allclose(sorted(x for x in r.rr_0[j] if x == x), w.reps)
    means = {(r.key, r.rep): r.mean for r in E.bootstrap_means(half, ["key"], ["row"], "x", 20, chance=chance).collect()}
    assert abs(got[10].re_0[8] - np.std([means[1, b] for b in range(20)], ddof=1)) < 1e-9


def test_thinned_states_stay_within_their_bounds():
    rng = np.random.default_rng(4)
    x, w = rng.lognormal(size=40_000), np.ones((40_000, 2), int)
    state = None
    for part in np.array_split(np.arange(40_000), 20):
        new = B.of_rows(x[part], w[part], True, True, 256)
        state = new if state is None else B.merged(state, B.State.unpacked(new.packed()), 256)
    assert len(state.v) <= 400 and len(state.h) <= 256
    for op, p in B.QUANTILES.items():
        rank = (x <= B.told(state, op, 0.5)[0]).mean()
        assert abs(rank - p) < 0.03
    assert abs(B.told(state, "unique", 0.5)[0] / 40_000 - 1) < 0.3
    assert B.told(state, "min", 0.5)[0] == x.min() and B.told(state, "max", 0.5)[1] == x.max() and abs(B.told(state, "sum", 0.5)[0] / x.sum() - 2) < 1e-9


@pytest.mark.parametrize("settings", [{"bootstrap_all": True}, {"draw_replicates": True}, {"correction": "bias"}, {"influence": "features", "policy": "greedy_plus"}])
def test_resampled_features_in_a_job(spark, table, requests, settings):
    specs = [FeatureSpec("group", {"med": ("median", "x"), "n": ("count", "x")}, table, ["key"], row_key=["row"]), FeatureSpec("group", {"u": ("unique", "y"), "p": ("percentile90", "y")}, table, ["key"], row_key=["row"])]
    predict = T.linear_model({"med": 1.0, "n": 0.01, "u": 0.1, "p": 0.2}, 0.0)
    exact = {r.req_id: r.pred_value for r in T.exact_job(requests, specs, predict).collect()}
    out = {r.req_id: r for r in T.progressive_job(requests, specs, predict, max_error=4.0, min_conf=0.8, ncfgs=20, alpha=5, beta=5, draws=32, replicates=20, **settings).collect()}
    assert set(out) == set(exact) and all(r.met for r in out.values())
    assert all(abs(out[i].pred_value - exact[i]) <= 8 for i in exact)
    assert all(abs(out[i].pred_value - exact[i]) < 1e-6 for i in (12, 13, 15))  # too few rows: read whole
    assert out[10].qsample < 1


def test_policies_equal_their_table_forms(spark):
    plan = materialize(Q.plan(spark, DATA).withColumn("pvar", F.lit(0.02)).withColumn("pred_conf", F.lit(0.3)))
    q = F.struct(F.substring("qname", 2, 9).cast("int").alias("i"), F.col("qsample").alias("share"), F.col("influence").alias("inf"), "weight", F.col("qcard").cast("double").alias("card"))
    one = plan.groupBy("req_id").agg(F.array_sort(F.collect_list(q)).alias("q"))
    r = P.Round(F.col("q"), F.lit(7), Q.GRAN, F.lit(0.02), F.lit(0.3), F.col("req_id"))
    tables = {n: L.round_robin(plan, L.priority(n), 7, Q.GRAN) for n in ("greedy", "greedy_plus", "blqcost")} | {
        "random": L.round_robin(plan, hash32("r", F.col("req_id"), F.substring("qname", 2, 9)), 7, Q.GRAN), "optimizer": L.best_first(plan, L.priority("optimizer"), 7, Q.GRAN), "stepgradient": L.step_gradient(plan, 7, Q.GRAN),
        "gradient": L.gradient(plan, 7, Q.GRAN), "uniform": L.uniform(plan, 7, Q.GRAN), "uniformexpinit": L.doubled(plan), "adaptive": L.adaptive(plan, Q.GRAN),
    }
    assert set(tables) == set(P.POLICIES)
    folded = {n: rule(r).alias(n) for n, rule in P.POLICIES.items()}
    got = {(x.req_id, n, i + 1): s for x in one.select("req_id", *folded.values()).collect() for n in folded for i, s in enumerate(x[n])}
    for n, t in tables.items():
        for x in t.collect():
            assert abs(got[x.req_id, n, int(x.qname[1:])] - x.qnext) < 1e-9, (n, x)
    jumps = {x.req_id: x.n for x in one.select("req_id", P.min_card(r, F.transform("q", lambda x: x["share"])).alias("n")).collect()}
    assert all(abs(jumps[x.req_id][int(x.qname[1:]) - 1] - x.qnext) < 1e-9 for x in L.min_card(plan, Q.GRAN).collect())


def _brute(kind, v, e, vb, eb, predict, draws, max_error):
    """Influence of three one-feature queries on a prediction, draw by draw."""
    rows = T.base(draws, 6)
    a = [[v[j] + e[j] * z[j] for j in range(3)] for _, z, _ in rows]
    b = [[v[j] + e[j] * z[j + 3] for j in range(3)] for _, z, _ in rows]
    p = [[vb[j] + eb[j] * z[j] for j in range(3)] for _, z, _ in rows]
    swap = lambda x, y, k: [[y[i][j] if j == k else x[i][j] for j in range(3)] for i in range(draws)]
    f = lambda m: np.array([predict(*r) for r in m])
    conf = lambda y: np.mean(np.abs(y - y.mean()) <= max_error + 1e-9)
    if kind in ("sobol", "total"):
        ya, yb = f(a), f(b)
        both = np.r_[ya, yb]
        return [np.mean((yb - both.mean()) * (f(swap(a, b, k)) - ya)) / both.var() if kind == "sobol" else np.mean(0.5 * (ya - f(swap(a, b, k))) ** 2) / both.var() for k in range(3)]
    other = p if kind.startswith("previous") else [v] * draws
    out = []
    for k in range(3):
        x, y = f(swap(a, other, k)), f(a)
        gain = y.var() - x.var() if "variance" in kind else conf(x) - conf(y)
        out.append(-gain if kind.startswith("previous") else gain)
    return out


@pytest.mark.parametrize("kind", T.INFLUENCES)
def test_influence_against_brute_force(spark, kind):
    """Of a model that is not linear: a tree of steps and a product."""
    v, e, vb, eb = [3.0, 5.0, 1.0], [0.6, 1.5, 0.3], [3.2, 4.0, 1.1], [0.9, 2.5, 0.5]
    plain = lambda x, y, z: (2.0 if x > 3.1 else 0.0) + x * y * 0.1 + (z if y > 5.5 else -z)
    predict = lambda df: df.withColumn("pred", F.when(F.col("f0") > 3.1, 2.0).otherwise(0.0) + F.col("f0") * F.col("f1") * 0.1 + F.when(F.col("f1") > 5.5, F.col("f2")).otherwise(-F.col("f2")))
    queries = [T.Query(j, FeatureSpec("group", {f"f{j}": ("avg", "x")}), ["x"], {f"f{j}": ("avg", 0, False)}) for j in range(3)]
    told = {f"f{j}": T.Estimate(j, "avg", F.lit(v[j]), F.lit(e[j]), None, F.lit(vb[j]), F.lit(eb[j])) for j in range(3)}
    state = spark.createDataFrame([(7,)], "req_id long")
    r = T.judge(spark, [], queries, told, predict, 40, kind, "error", 0.5, False)(state).first()
    assert np.allclose([r.inf_0, r.inf_1, r.inf_2], _brute(kind, v, e, vb, eb, plain, 40, 0.5))


@pytest.mark.parametrize("settings", [{"constraint": "conf", "max_error": 2.0, "min_conf": 0.9}, {"constraint": "relative_error", "max_relative_error": 0.05, "min_conf": 0.9}, {"max_error": 3.0, "min_conf": 0.9, "min_card": True, "policy": "gradient"}, {"max_error": 3.0, "min_conf": 0.9, "influence": "previous", "policy": "stepgradient", "costs": {"m": 2.0}}, {"max_error": 3.0, "min_conf": 0.9, "policy": "uniformexpbatch", "beta": 2}])
def test_constraints_and_policies_in_a_job(spark, table, requests, settings):
    specs = [FeatureSpec("group", {"m": ("avg", "x")}, table, ["key"], condition="x < 70"), FeatureSpec("group", {"s": ("sum", "y")}, table, ["key"], post={"s": F.sqrt})]
    predict = T.linear_model({"m": 1.0, "s": 0.5}, 0.0)
    exact = {r.req_id: r.pred_value for r in T.exact_job(requests, specs, predict).collect()}
    out = {r.req_id: r for r in T.progressive_job(requests, specs, predict, ncfgs=20, draws=32, **{"alpha": 4, "beta": 4, **settings}).collect()}
    assert set(out) == set(exact) and all(r.met for r in out.values())
    for i, r in out.items():
        assert r.pred_conf >= 0.9 - 1e-9 or min(r.shares) >= 1
        if min(r.shares) >= 1:
            assert abs(r.pred_value - exact[i]) < 1e-6
        assert len(r.trace.split(" ")) == r.rounds


def test_long_windows_answer_every_request(spark):
    d = "/root/testdata/sf0.01"
    out = {r.req_id: r for r in O.long_windows(spark, d).collect()}
    from inkling.plans.pipeline_queries import event_requests

    exact = {r.req_id: r.pred_value for r in T.exact_job(event_requests(spark, d), O.long_specs(spark, d), T.linear_model(O.LONG_WEIGHTS, 0.0)).collect()}
    assert set(out) == set(exact) and all(r.met for r in out.values())
    assert np.mean([abs(out[i].pred_value - exact[i]) <= 8.0 for i in exact]) >= 0.85
    assert min(r.qsample for r in out.values()) < 1


def test_facts_by_pid_are_in_files_of_a_bounded_size(spark, monkeypatch):
    """A round that reads a fifth of the pids reads a fifth of the files, and not one or two large ones."""
    monkeypatch.setattr(O, "FILE", 50)
    f = O.event_facts(spark, DATA)
    assert f.count() == 1000 and len(f.inputFiles()) >= 20
