"""Allocation, cost, datasets, evaluation, refresh, prediction jobs, training and streams."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from inkling.functions.hashing import hash32, uniform
from inkling.functions.scalar import epoch_s
from inkling.operators import allocate as L
from inkling.operators import metrics as V
from inkling.operators import refresh as R
from inkling.operators.planning import frontier, level_profile
from inkling.operators.ranges import previous, quantiles
from inkling.sources.ingest import assign_pid, read
from inkling.sources.storage import materialize, shared_dir
from inkling.streaming import jobs

from . import progressive as T
from .base import DAY, REQ, facts, h32, query, requests, rounded, u32
from inkling.functions.estimators import sql_normal_ppf

from .estimate_queries import KEY, PID

GRAN = 0.05
PLAN_SQL = f"""plan AS (SELECT c_custkey AS req_id, 'q' || k AS qname, k, round(({h32("'s|' || c_custkey || '|' || k")} % 20 + 1) * {GRAN}, 6) AS qsample, {u32("'i|' || c_custkey || '|' || k")} - 0.1 AS influence,
1 + {u32("'w|' || c_custkey || '|' || k")} AS weight, CASE WHEN k < 5 THEN {h32("'c|' || c_custkey || '|' || k")} % 300 + 1 END AS qcard FROM customer, range(1, 6) r(k)),
st AS (SELECT *, cast(round((1 - qsample) / {GRAN}) AS BIGINT) AS valid, greatest(1 - qsample, 1e-9) AS rest FROM plan)"""


def plan(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("req_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    key = lambda t: (t, F.col("req_id"), F.col("k"))
    return c.select("req_id", F.concat(F.lit("q"), F.col("k").cast("string")).alias("qname"), F.round((hash32(*key("s")) % 20 + 1) * GRAN, 6).alias("qsample"), (uniform(*key("i")) - 0.1).alias("influence"), (1 + uniform(*key("w"))).alias("weight"), F.when(F.col("k") < 5, hash32(*key("c")) % 300 + 1).alias("qcard"))


PRIORITY = {"greedy": "influence / rest", "greedy_plus": "influence / (weight * rest)", "optimizer": "greatest(influence, 0) / (weight * rest)", "blqcost": "1 / (weight * rest)"}


def _next(rows, spark=None):
    return rounded(rows.select("req_id", "qname", "qnext"))


def _round_robin(name, policy, p_sql=None, p=None, steps=7):
    sql = p_sql or PRIORITY[policy]

    @query(name, f"WITH {PLAN_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY {sql} DESC, qname) AS rank FROM st), un AS (SELECT req_id, qname, rank, lv FROM rk, range(1, {steps + 1}) l(lv) WHERE lv <= valid), tk AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY lv, rank) AS i FROM un), ad AS (SELECT req_id, qname, count(*) AS n FROM tk WHERE i <= {steps} GROUP BY 1, 2) SELECT req_id, qname, least(1.0, round(qsample + coalesce(n, 0) * {GRAN}, 6))::DOUBLE AS qnext FROM plan LEFT JOIN ad USING (req_id, qname)")
    def run(spark, d):
        return _next(L.round_robin(plan(spark, d), p() if p else L.priority(policy), steps, GRAN))


_round_robin("l3_greedy", "greedy")
_round_robin("l4_greedy_plus", "greedy_plus")
_round_robin("l5_random", None, h32("'r|' || req_id || '|' || k"), lambda: hash32("r", F.col("req_id"), F.substring("qname", 2, 9)))
_round_robin("l7_blqcost", "blqcost")


def _best_first(name, steps, policy="optimizer"):
    @query(name, f"WITH {PLAN_SQL}, b AS (SELECT *, coalesce(sum(valid) OVER (PARTITION BY req_id ORDER BY {PRIORITY[policy]} DESC, qname ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM st) SELECT req_id, qname, least(1.0, round(qsample + greatest(0, least(valid, {steps} - bf)) * {GRAN}, 6))::DOUBLE AS qnext FROM b")
    def run(spark, d):
        return _next(L.best_first(plan(spark, d), L.priority(policy), steps, GRAN))


_best_first("l8_optimizer", L.step_size(12, 0, 5))
_best_first("l2_l13_step_sizes", L.step_size(0, 15, 5))


@query("l0_start_fractions", "SELECT c_custkey AS req_id, 'q' || k AS qname, CASE WHEN k < 4 THEN 0.05 ELSE 1.0 END::DOUBLE AS qsample FROM customer, range(1, 6) r(k)")
def l0(spark, d):
    kinds = plan(spark, d).select("req_id", "qname", F.when(F.col("qname") < "q4", "AGG").otherwise("FSTORE").alias("kind"))
    return L.start(kinds, 5, 100).select("req_id", "qname", "qsample")


@query("l1_min_card", f"WITH {PLAN_SQL}, n AS (SELECT *, least(30.0::DOUBLE / qcard, 1) AS need FROM plan), s AS (SELECT *, qcard IS NOT NULL AND qsample < need AS up FROM n) SELECT req_id, qname, round(CASE WHEN up THEN CASE WHEN qsample <= 0.1 AND need >= 0.5 THEN 0.5 ELSE least(1, ceil(need / {GRAN} - 1e-9) * {GRAN}) END ELSE qsample END, 6) AS qnext, bool_or(coalesce(up, false)) OVER (PARTITION BY req_id) AS jumped FROM s")
def l1(spark, d):
    return rounded(L.min_card(plan(spark, d), GRAN).select("req_id", "qname", "qnext", "jumped"))


@query("l6_l12_uniform", f"WITH {PLAN_SQL} SELECT req_id, qname, least(1.0, round(qsample + least(valid, 4) * {GRAN}, 6))::DOUBLE AS qnext FROM st")
def l6(spark, d):
    return _next(L.uniform(plan(spark, d), 4, GRAN))


@query("l11_doubled", f"WITH {PLAN_SQL} SELECT req_id, qname, round(least(2 * qsample, 1), 6) AS qnext FROM st")
def l11(spark, d):
    return _next(L.doubled(plan(spark, d)))


@query("l10_gradient", f"WITH {PLAN_SQL}, g AS (SELECT *, greatest(influence, 0) * 0.02 / (weight * rest) AS g FROM st), a AS (SELECT *, least(valid, floor(12 * g / {GRAN}), 10) AS ad, sum(g) OVER (PARTITION BY req_id) AS nm FROM g), b AS (SELECT *, max(ad) OVER (PARTITION BY req_id) = 0 OR nm < 1e-9 AS flat FROM a) SELECT req_id, qname, least(1.0, round(qsample + CASE WHEN flat THEN least(valid, 1) ELSE ad END * {GRAN}, 6))::DOUBLE AS qnext FROM b")
def l10(spark, d):
    return _next(L.gradient(plan(spark, d).withColumn("pvar", F.lit(0.02)), 12, GRAN))


@query("l9_step_gradient", None)
def l9(spark, d):
    return _next(L.step_gradient(plan(spark, d).withColumn("pvar", F.lit(0.02)), 12, GRAN))


@query(
    "l14_adaptive",
    f"""WITH {PLAN_SQL}, j AS (SELECT req_id, qname, influence, CASE WHEN qcard < 30 THEN 1.0 ELSE qsample END AS qsample, ceil(1 / greatest({u32("'p|' || req_id")}, 0.05)) AS steps FROM plan),
    rk AS (SELECT *, cast(round((1 - qsample) / {GRAN}) AS BIGINT) AS valid, row_number() OVER (PARTITION BY req_id ORDER BY influence DESC, qname) AS rank FROM j),
    tk AS (SELECT req_id, qname, steps, row_number() OVER (PARTITION BY req_id ORDER BY lv, rank) AS i FROM rk, range(1, 21) l(lv) WHERE lv <= valid),
    ad AS (SELECT req_id, qname, count(*) AS n FROM tk WHERE i <= steps GROUP BY 1, 2)
    SELECT req_id, qname, least(1.0, round(qsample + coalesce(n, 0) * {GRAN}, 6))::DOUBLE AS qnext FROM j LEFT JOIN ad USING (req_id, qname)""",
)
def l14(spark, d):
    return _next(L.adaptive(plan(spark, d).withColumn("pred_conf", uniform("p", F.col("req_id"))), GRAN))


@query("t1_termination", f"WITH {PLAN_SQL} SELECT req_id, min(qsample) >= 1 OR (avg(influence) <= 0.45 AND max(influence) >= 0.6) OR (avg(influence) < 1e-9 AND max(influence) > 1 - 1e-9) AS done FROM plan GROUP BY 1")
def t1(spark, d):
    state = plan(spark, d).groupBy("req_id").agg(F.avg("influence").alias("pred_error"), F.max("influence").alias("pred_conf"), F.lit(0.0).alias("pred_value"), F.lit(0.0).alias("pred_var"), F.min("qsample").alias("min_qsample"))
    return L.finished(state, max_error=0.45, min_conf=0.6).select("req_id", "done")


QUERIES_, WEIGHTS_, BIAS_ = {"q_price": ("avg", "l_extendedprice"), "q_qty": ("avg", "l_quantity"), "q_disc": ("avg", "l_discount")}, {"q_price": 0.001, "q_qty": 1.0, "q_disc": 10.0}, 5.0
EXACT_SQL = f"SELECT l_suppkey AS req_id, 0.001 * avg(l_extendedprice) + avg(l_quantity) + 10 * avg(l_discount) + {BIAS_} AS pred_value FROM lineitem GROUP BY 1"


def supplier_facts(spark, d):
    """The facts, kept in the order of their sampling partition."""
    rows = assign_pid(read(spark, d, "lineitem"), KEY).select(F.col("l_suppkey").alias("req_id"), "pid", "l_extendedprice", "l_quantity", "l_discount")
    # Files in the order of pid: their statistics let a round skip what it does not read.
    return materialize(rows.repartitionByRange("pid").sortWithinPartitions("pid"))


def supplier_rows(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("req_id"), "l_extendedprice", "l_quantity", "l_discount")


@query("t3_exact_prediction", f"SELECT req_id, round(pred_value, 6) AS pred_value FROM ({EXACT_SQL})")
def t3(spark, d):
    return rounded(T.exact_predictions(supplier_rows(spark, d), QUERIES_, T.linear_model(WEIGHTS_, BIAS_)))


@query("t2_progressive_prediction")
def t2(spark, d):
    """Rounds until nine in ten draws of the features move the prediction by three at most."""
    size = read(spark, d, "lineitem").count()
    return T.progressive_predictions(supplier_facts(spark, d), QUERIES_, T.linear_model(WEIGHTS_, BIAS_), max_error=3.0, min_conf=0.95, tsize=size)


def to_the_end(spark, d):
    """A target that can't be met: 40 % first, then all."""
    return T.progressive_predictions(supplier_facts(spark, d), QUERIES_, T.linear_model(WEIGHTS_, BIAS_), max_error=0.0, min_conf=1.1, tsize=read(spark, d, "lineitem").count(), alpha=40, beta=60)


@query("t2_progressive_to_the_end", f"SELECT req_id, round(pred_value, 6) AS pred_value, 0.0::DOUBLE AS pred_error, 1.0::DOUBLE AS pred_conf, 1.0::DOUBLE AS qsample, true AS met FROM ({EXACT_SQL})")
def t2_end(spark, d):
    return rounded(to_the_end(spark, d).select("req_id", "pred_value", "pred_error", "pred_conf", "qsample", "met"))


@query("t4_trace", "SELECT DISTINCT l_suppkey AS req_id, '0.40,0.40,0.40 1.00,1.00,1.00' AS trace FROM lineitem")
def t4(spark, d):
    """Shares read by each query, round by round."""
    return to_the_end(spark, d).select("req_id", "trace")


FOREST_QUERIES = {"n": ("count", "l_quantity"), "avg_price": ("avg", "l_extendedprice"), "std_qty": ("stdPop", "l_quantity"), "top_price": ("max", "l_extendedprice")}


def revenue_model(spark, d):
    """A forest that predicts a supplier's revenue from exact features, and the exact features of the supplier's record."""
    from inkling.operators import ml

    rows = supplier_rows(spark, d)
    extra = read(spark, d, "supplier").select(F.col("s_suppkey").alias("req_id"), "s_acctbal")
    label = rows.groupBy("req_id").agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e6).alias("label"))
    exact = T.exact_predictions(rows, FOREST_QUERIES, lambda x: x.withColumn("pred", F.struct(*FOREST_QUERIES)), extra)
    known = materialize(exact.select("req_id", "pred_value.*").join(extra, "req_id").join(label, "req_id"))
    model = ml.make_model("forest", [*FOREST_QUERIES, "s_acctbal"]).fit(known)
    return T.ml_model(model), extra


@query("t2_progressive_forest")
def t2_forest(spark, d):
    """The same job with a random forest, four aggregates (the greatest price has no closed form and is read whole), costs and an exact feature."""
    predict, extra = revenue_model(spark, d)
    return T.progressive_predictions(supplier_facts(spark, d), FOREST_QUERIES, predict, max_error=1.0, min_conf=0.9, tsize=read(spark, d, "lineitem").count(), extra=extra, costs={"n": 1.0, "avg_price": 2.0})


PROFILE_SQL = "pr AS (SELECT o_orderpriority AS qname, o_orderkey % 10 / 10.0::DOUBLE AS qsample, o_totalprice / 1000 + 20 * (o_orderkey % 10) AS time FROM orders)"


def profiles(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderpriority").alias("qname"), (F.col("o_orderkey") % 10 / 10.0).alias("qsample"), (F.col("o_totalprice") / 1000 + 20 * (F.col("o_orderkey") % 10)).alias("time"))


@query("c1_linear_cost", f"WITH {PROFILE_SQL}, g AS (SELECT qname, regr_slope(time, qsample) AS s, regr_intercept(time, qsample) AS i, avg(time) AS m FROM pr GROUP BY 1) SELECT qname, round(CASE WHEN s < 0 THEN 0 ELSE s END, 5) AS weight, round(CASE WHEN s < 0 THEN m ELSE i END, 5) AS intercept FROM g")
def c1(spark, d):
    return rounded(V.linear_cost(profiles(spark, d)), 5)


@query("c2_cost_by_example", f"WITH {PROFILE_SQL} SELECT qname, qsample, round(avg(time), 5) AS cost FROM pr GROUP BY 1, 2")
def c2(spark, d):
    return rounded(profiles(spark, d).groupBy("qname", "qsample").agg(F.avg("time").alias("cost")), 5)


def _regression_sql(y, p, source, by=""):
    e = f"({y} - {p})"
    return f"SELECT {by + ', ' if by else ''}round(avg(abs{e}), 5) AS mae, round(avg({e} * {e}), 5) AS mse, round(avg(abs{e} / greatest(abs({y}), {V.EPS!r})), 5) AS mape, round(1 - sum({e} * {e}) / count(*) / var_pop({y}), 5) AS r2, round(1 - var_pop({e}) / var_pop({y}), 5) AS expv, round(max(abs{e}), 5) AS maxe FROM {source}{' GROUP BY 1' if by else ''}"


@query("c3_cost_evaluation", f"WITH {PROFILE_SQL}, f AS (SELECT qname, regr_slope(time, qsample) AS s, regr_intercept(time, qsample) AS i FROM pr GROUP BY 1) " + _regression_sql("time", "(i + s * qsample)", "pr JOIN f USING (qname)", "qname"))
def c3(spark, d):
    p = profiles(spark, d)
    fit = p.groupBy("qname").agg(F.regr_slope("time", "qsample").alias("s"), F.regr_intercept("time", "qsample").alias("i"))
    return rounded(V.regression(p.join(fit, "qname").withColumn("p", F.col("i") + F.col("s") * F.col("qsample")), "time", "p", ["qname"]), 5)


@query("c4_cumulative_profile", f"WITH {PROFILE_SQL}, g AS (SELECT qname, qsample, avg(time) AS c FROM pr GROUP BY 1, 2) SELECT qname, qsample, round(sum(c) OVER (PARTITION BY qname ORDER BY qsample), 5) AS cost FROM g")
def c4(spark, d):
    from pyspark.sql import Window

    per = profiles(spark, d).groupBy("qname", "qsample").agg(F.avg("time").alias("c"))
    return rounded(per.select("qname", "qsample", F.sum("c").over(Window.partitionBy("qname").orderBy("qsample").rowsBetween(Window.unboundedPreceding, 0)).alias("cost")), 5)


@query("c5_static_plan", "WITH s AS (SELECT l_suppkey, avg(l_quantity) AS mq, avg(l_discount) AS md FROM lineitem GROUP BY 1), m AS (SELECT a.x AS qa, b.x AS qb, avg((mq * (1 - a.x / 4.0) + 9 * md * (1 - b.x / 4.0)) ** 2) AS mse, a.x + 2 * b.x AS cost FROM s, range(1, 5) a(x), range(1, 5) b(x) GROUP BY 1, 2, 4) SELECT cast(min_by(qa, cost * 100 + qa * 10 + qb) AS BIGINT) AS qa, cast(min_by(qb, cost * 100 + qa * 10 + qb) AS BIGINT) AS qb, cast(min(cost) AS BIGINT) AS cost FROM m WHERE mse <= 50")
def c5(spark, d):
    s = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mq"), F.avg("l_discount").alias("md"))
    levels = F.sequence(F.lit(1), F.lit(4))  # 16 plans
    both = s.withColumn("qa", F.explode(levels)).withColumn("qb", F.explode(levels))
    err = F.col("mq") * (1 - F.col("qa") / 4.0) + 9 * F.col("md") * (1 - F.col("qb") / 4.0)
    m = both.groupBy("qa", "qb").agg(F.avg(err * err).alias("mse")).withColumn("cost", F.col("qa") + 2 * F.col("qb")).filter("mse <= 50")
    return m.agg(F.min(F.struct("cost", "qa", "qb")).alias("b")).select(F.col("b.qa").cast("long").alias("qa"), F.col("b.qb").cast("long").alias("qb"), F.col("b.cost").cast("long").alias("cost"))


PLAN_LEVELS, PLAN_WEIGHTS = [5, 10, 20, 40, 70, 100], {"l_quantity": 1.0, "l_discount": 200.0, "l_extendedprice": 0.001}
_LEVEL_AVG = lambda k: f"SELECT l_suppkey, {k} AS level, count(*) AS n, " + ", ".join(f"avg({c}) AS {c}" for c in PLAN_WEIGHTS) + f" FROM lineitem WHERE {PID} < {k} GROUP BY 1"
_LEVEL_VAR = " UNION ALL ".join(f"SELECT '{c}' AS q, level, sum(n)::DOUBLE AS cost, avg(power({w!r} * (coalesce({c}, 0) - w_{c}), 2)) AS var FROM e GROUP BY level" for c, w in PLAN_WEIGHTS.items())


@query(
    "c5_plan_frontier",
    f"""WITH a AS ({' UNION ALL '.join(_LEVEL_AVG(k) for k in PLAN_LEVELS)}), w AS (SELECT l_suppkey, {', '.join(f'{c} AS w_{c}' for c in PLAN_WEIGHTS)} FROM a WHERE level = 100),
    g AS (SELECT l_suppkey, level FROM w, (SELECT DISTINCT level FROM a)), e AS (SELECT g.level, coalesce(n, 0) AS n, {', '.join(PLAN_WEIGHTS)}, {', '.join(f'w_{c}' for c in PLAN_WEIGHTS)} FROM g JOIN w USING (l_suppkey) LEFT JOIN a ON a.l_suppkey = g.l_suppkey AND a.level = g.level),
    p AS ({_LEVEL_VAR}), c AS (SELECT x.level AS a, y.level AS b, z.level AS c, x.cost + y.cost + z.cost AS cost, x.var + y.var + z.var AS var FROM p x, p y, p z WHERE x.q = 'l_quantity' AND y.q = 'l_discount' AND z.q = 'l_extendedprice')
    SELECT cost, round(var, 6) AS var FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.cost <= c.cost AND o.var <= c.var AND (o.cost < c.cost OR o.var < c.var)) GROUP BY 1, 2""",
)
def c5_frontier(spark, d):
    """All plans of six levels for each of three queries that no other plan beats, from a profile of the real table."""
    facts = assign_pid(read(spark, d, "lineitem"), KEY).select("l_suppkey", "pid", *PLAN_WEIGHTS)
    plans = frontier(level_profile(facts, "l_suppkey", PLAN_WEIGHTS, PLAN_LEVELS), list(PLAN_WEIGHTS))
    return plans.select("cost", F.round("var", 6).alias("var"))


@query("d1_d2_dataset", "SELECT e.event_id AS req_id, e.user_id AS req_user, f.n AS f_n, round(f.m, 5) AS f_mean, CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END AS label FROM events e JOIN (SELECT user_id, count(*) AS n, avg(value) AS m FROM events GROUP BY 1) f USING (user_id)")
def d1(spark, d):
    e = read(spark, d, "events")
    f = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("f_n"), F.avg("value").alias("f_mean"))
    r = e.select(F.col("event_id").alias("req_id"), "user_id", (F.col("event_type") == "purchase").cast("int").alias("label"))
    return rounded(r.join(f, "user_id").dropna().select("req_id", F.col("user_id").alias("req_user"), "f_n", "f_mean", "label"), 5)


@query("d3_middle_slice", "WITH b AS (SELECT quantile_cont(event_id, 0.25) AS lo, quantile_cont(event_id, 0.75) AS hi FROM events) SELECT event_id FROM events, b WHERE event_id >= lo AND event_id < hi")
def d3(spark, d):
    e = read(spark, d, "events").select("event_id")
    b = quantiles(e, "event_id", {"lo": 0.25, "hi": 0.75})  # one row
    return e.join(F.broadcast(b), (F.col("event_id") >= F.col("lo")) & (F.col("event_id") < F.col("hi"))).select("event_id")


@query("d4_latest_per_class", "WITH k AS (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 50), r AS (SELECT event_id, user_id, event_type = 'purchase' AS label, row_number() OVER (PARTITION BY user_id, event_type = 'purchase' ORDER BY ts DESC, event_id) AS i FROM events WHERE user_id IN (SELECT user_id FROM k)) SELECT event_id, user_id, label FROM r WHERE i <= 5")
def d4(spark, d):
    e = read(spark, d, "events").withColumn("label", F.col("event_type") == "purchase")
    return V.latest_per_class(e, "user_id", "label", "ts", 5, 50, "event_id").select("event_id", "user_id", "label")


@query("d5_rate_sample", f"WITH k AS (SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'purchase') / count(*) >= 0.15) SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM k WHERE {u32('user_id')} < 0.5)")
def d5(spark, d):
    e = read(spark, d, "events")
    rate = e.groupBy("user_id").agg((F.count_if(F.col("event_type") == "purchase") / F.count(F.lit(1))).alias("r")).filter((F.col("r") >= 0.15) & (uniform(F.col("user_id")) < 0.5))
    return e.join(rate, "user_id", "left_semi").select("event_id")


@query("d6_d7_request_spine", "WITH h AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS h FROM events), b AS (SELECT min(h) + INTERVAL 7 HOUR AS lo, max(h) - INTERVAL 1 HOUR AS hi FROM h) SELECT event_type, h AS req_hour FROM h, b WHERE h >= lo AND h <= hi")
def d6(spark, d):
    h = read(spark, d, "events").select("event_type", F.date_trunc("hour", "ts").alias("req_hour")).distinct()
    b = h.agg((F.min("req_hour") + F.expr("INTERVAL 7 HOURS")).alias("lo"), (F.max("req_hour") - F.expr("INTERVAL 1 HOUR")).alias("hi"))
    return h.join(F.broadcast(b), F.col("req_hour").between(F.col("lo"), F.col("hi"))).select("event_type", "req_hour")


@query("d8_labels", "SELECT l_orderkey, l_linenumber, l_extendedprice <= 10000 AS cheap, l_returnflag <> 'N' AS fault, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cls FROM lineitem")
def d8(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") <= 10000).alias("cheap"), (F.col("l_returnflag") != "N").alias("fault"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("cls"))


@query("d9_random_split", f"SELECT event_id, CASE WHEN {u32(chr(39) + '0|' + chr(39) + ' || event_id')} < 0.5 THEN 'train' WHEN {u32(chr(39) + '0|' + chr(39) + ' || event_id')} < 0.8 THEN 'valid' ELSE 'test' END AS split FROM events")
def d9(spark, d):
    return V.random_split(read(spark, d, "events"), "event_id").select("event_id", "split")


@query("d10_d11_time_split", "WITH e AS (SELECT event_id, epoch_us(ts) AS t FROM events), c AS (SELECT quantile_cont(t, 0.5) AS cut FROM e), v AS (SELECT event_id FROM e, c WHERE t >= cut ORDER BY t, event_id LIMIT 100) SELECT event_id, CASE WHEN t < cut THEN 'train' WHEN event_id IN (SELECT event_id FROM v) THEN 'valid' ELSE 'test' END AS split FROM e, c")
def d10(spark, d):
    from inkling.functions.scalar import epoch_us

    e = read(spark, d, "events").select("event_id", epoch_us(F.col("ts")).alias("t"))
    cut = quantiles(e, "t", {"cut": 0.5}, ["event_id"])  # one row
    marked = e.join(F.broadcast(cut))
    valid = marked.filter("t >= cut").orderBy("t", "event_id").limit(100).select("event_id", F.lit(True).alias("v"))
    return marked.join(F.broadcast(valid), "event_id", "left").select("event_id", F.when(F.col("t") < F.col("cut"), "train").when(F.col("v"), "valid").otherwise("test").alias("split"))


@query("d12_grouped_split", f"SELECT event_id, CASE WHEN {h32('user_id')} % 10 = 0 THEN 'test' WHEN {u32(chr(39) + 's|' + chr(39) + ' || user_id')} < 0.8 THEN 'train' ELSE 'valid' END AS split FROM events")
def d12(spark, d):
    u = F.col("user_id")
    return read(spark, d, "events").select("event_id", F.when(hash32(u) % 10 == 0, "test").when(uniform("s", u) < 0.8, "train").otherwise("valid").alias("split"))


PRED_SQL = "(SELECT l_returnflag AS g, l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem)"


def _pred(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("p"))


@query("v1_regression_metrics", _regression_sql("y", "p", PRED_SQL))
def v1(spark, d):
    return rounded(V.regression(_pred(spark, d), "y", "p"), 5)


@query("v4_feature_metrics", _regression_sql("exact", "approx", "(SELECT l_returnflag AS fname, coalesce(CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END, 0) AS exact, l_quantity * 1.01 AS approx FROM lineitem)", "fname"))
def v4(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("fname"), F.when(F.col("l_linenumber") % 5 == 0, float("nan")).otherwise(F.col("l_quantity")).alias("exact"), (F.col("l_quantity") * 1.01).alias("approx"))
    return rounded(V.feature_metrics(rows), 5)


LAB_SQL = "lab AS (SELECT quality AS y, cast(doc_id % 5 > 0 AS INTEGER) AS p, doc_id FROM labels)"


def _labels(spark, d):
    return read(spark, d, "labels").select(F.col("quality").alias("y"), (F.col("doc_id") % 5 > 0).cast("int").alias("p"), "doc_id")


@query("v2_binary_metrics", f"WITH {LAB_SQL}, c AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn FROM lab) SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS acc, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS auc FROM c")
def v2(spark, d):
    return rounded(V.binary(_labels(spark, d), "y", "p"))


@query("v3_multiclass_metrics", "WITH r AS (SELECT l_returnflag AS y, CASE WHEN l_linenumber % 3 = 0 THEN 'A' ELSE l_returnflag END AS p FROM lineitem), k AS (SELECT DISTINCT y AS c FROM r), m AS (SELECT c, count(*) FILTER (WHERE y = c) AS t, count(*) FILTER (WHERE p = c) AS g, count(*) FILTER (WHERE y = c AND p = c) AS ok FROM r, k GROUP BY 1) SELECT round(sum(CASE WHEN g > 0 THEN ok / g ELSE 0 END * t) / sum(t), 6) AS precision, round(sum(ok / t * t) / sum(t), 6) AS recall, round(sum(2 * ok / (t + g) * t) / sum(t), 6) AS f1 FROM m")
def v3(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(F.col("l_linenumber") % 3 == 0, "A").otherwise(F.col("l_returnflag")).alias("p"))
    return rounded(V.multiclass(rows, "y", "p"))


@query("v3_pair_auc", "WITH s AS (SELECT l_returnflag AS y, cls, CASE cls WHEN 'A' THEN l_quantity WHEN 'N' THEN 60 - l_quantity ELSE l_discount * 100 END AS score FROM lineitem, (VALUES ('A'), ('N'), ('R')) c(cls)), p AS (SELECT y, s.cls AS a, b.cls AS b, score FROM s, (VALUES ('A'), ('N'), ('R')) b(cls) WHERE s.cls <> b.cls AND (y = s.cls OR y = b.cls)), g AS (SELECT a, b, score, count(*) FILTER (WHERE y = a) AS pos, count(*) FILTER (WHERE y = b) AS neg FROM p GROUP BY 1, 2, 3), w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY a, b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT a, b, round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6)::DOUBLE AS auc FROM w GROUP BY 1, 2")
def v3_auc(spark, d):
    q = F.col("l_quantity")
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), s.alias("score")) for c, s in (("A", q), ("N", 60 - q), ("R", F.col("l_discount") * 100))])).alias("s")).select("y", "s.*")
    return rounded(V.pair_auc(rows, "y"))


RUN_SQL = "run AS (SELECT o_orderkey AS req_id, o_totalprice AS exact, o_totalprice * (1 + (o_orderkey % 7 - 3) / 100.0::DOUBLE) AS pred, o_orderkey % 4 + 1 AS rounds, (o_orderkey % 10 + 1) / 10.0::DOUBLE AS frac FROM orders)"


def _run(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(k.alias("req_id"), F.col("o_totalprice").alias("exact"), (F.col("o_totalprice") * (1 + (k % 7 - 3) / 100.0)).alias("pred"), (k % 4 + 1).alias("rounds"), ((k % 10 + 1) / 10.0).alias("frac"))


@query("v5_v6_run_report", f"WITH {RUN_SQL} SELECT round(avg(abs(pred - exact)), 4) AS error, round(avg(cast(abs(pred - exact) <= 3000 AS INTEGER)), 6) AS meet_rate, round(avg(cast(abs(pred - exact) / exact <= 0.02 AS INTEGER)), 6) AS meet_relative, round(avg(rounds), 6) AS rounds, round(avg(frac), 6) AS frac, round(1 - sum((least(pred, 400000) - least(exact, 400000)) ** 2) / count(*) / var_pop(least(exact, 400000)), 6) AS similarity FROM run")
def v5(spark, d):
    r = _run(spark, d)
    e = F.abs(F.col("pred") - F.col("exact"))
    cp, ce = F.least("pred", F.lit(400000.0)), F.least("exact", F.lit(400000.0))
    return r.agg(F.round(F.avg(e), 4).alias("error"), F.round(F.avg((e <= 3000).cast("int")), 6).alias("meet_rate"), F.round(F.avg((e / F.col("exact") <= 0.02).cast("int")), 6).alias("meet_relative"), F.round(F.avg("rounds"), 6).alias("rounds"), F.round(F.avg("frac"), 6).alias("frac"), F.round(1 - F.sum((cp - ce) ** 2) / F.count(F.lit(1)) / F.var_pop(ce), 6).alias("similarity"))


@query("v7_v8_v9_summaries", f"WITH {RUN_SQL}, s AS (SELECT rounds AS cfg, req_id % 5 AS seed, min_by(frac, req_id) AS frac FROM run GROUP BY 1, 2) SELECT cfg, round(avg(frac), 6) AS frac, round(1.0 / avg(frac), 6)::DOUBLE AS speedup, any_value((SELECT round(sum(rounds - 1) / sum(rounds), 6) FROM run)) AS failed_share FROM s GROUP BY 1")
def v7(spark, d):
    r = _run(spark, d)
    first = r.groupBy(F.col("rounds").alias("cfg"), (F.col("req_id") % 5).alias("seed")).agg(F.min_by("frac", "req_id").alias("frac"))
    share = r.agg((F.sum(F.col("rounds") - 1) / F.sum("rounds")).alias("failed_share"))  # one row
    return rounded(first.groupBy("cfg").agg(F.avg("frac").alias("frac")).withColumn("speedup", 1 / F.col("frac")).join(F.broadcast(share)))


@query("v13_vector_comparison", f"WITH {RUN_SQL} SELECT count(*) AS n, round(max(abs(pred - exact) / exact), 6) AS worst FROM run")
def v13(spark, d):
    r = _run(spark, d)
    both = r.select("req_id", "pred").join(r.select("req_id", "exact"), "req_id")
    return rounded(both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("pred") - F.col("exact")) / F.col("exact")).alias("worst")))


@query("m4_threshold_sweep", "WITH x AS (SELECT quality AS y, (doc_id % 101) / 100.0::DOUBLE AS s FROM labels), t AS (SELECT k / 100.0::DOUBLE AS th, y, cast(s >= k / 100.0 AS INTEGER) AS p FROM x, range(40, 81) r(k)), c AS (SELECT th, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn FROM t GROUP BY 1) SELECT th, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1 FROM c")
def m4(spark, d):
    x = read(spark, d, "labels").select(F.col("quality").alias("y"), (F.col("doc_id") % 101 / 100.0).alias("s"))
    return rounded(V.threshold_sweep(x, "y", "s"))


def priority_scores(spark, d):
    """(question, req_id, y, s): held-out scores of one classifier for each order priority, whether the order is dear."""
    from inkling.operators import ml

    questions = read(spark, d, "orders").select(F.col("o_orderkey").alias("req_id"), F.col("o_orderpriority").alias("question"))
    rows = materialize(order_rows(spark, d).join(questions, "req_id").withColumn("y", (F.col("label") > 100000).cast("int")))
    out = None
    for q in sorted(r.question for r in rows.select("question").distinct().collect()):  # a handful of priorities
        own = rows.filter(F.col("question") == q)
        model = ml.make_model("logistic", ORDER_FEATURES, scaler="standard", label="y").fit(own.filter("split = 'train'"))
        told = model.transform(own.filter("split = 'test'")).select("question", "req_id", "y", vector_to_array("probability")[1].alias("s"))
        out = told if out is None else out.unionByName(told)
    return out


@query("m4_ensemble_sweep")
def m4_ensemble(spark, d):
    """Macro F1 of all questions' models together at each threshold."""
    return V.threshold_sweep(priority_scores(spark, d), "y", "s")


FB_SQL = "fb AS (SELECT user_id, epoch_us(ts) // 1000000 AS label_ts, value * value / 1000 AS err FROM events)"


def feedback(spark, d):
    return read(spark, d, "events").select("user_id", epoch_s(F.col("ts")).alias("label_ts"), (F.col("value") * F.col("value") / 1000).alias("err"), "value")


NOW = 1705276800  # 2024-01-15


@query("r3_r5_r7_refresh_priority", f"WITH {FB_SQL}, s AS (SELECT user_id, label_ts, least(sum(err), 20) AS e FROM fb WHERE label_ts <= {NOW} GROUP BY 1, 2) SELECT user_id, round(sum(e), 5) AS priority FROM s GROUP BY 1 ORDER BY sum(e) DESC, user_id LIMIT 20")
def r5(spark, d):
    return rounded(R.choose(feedback(spark, d), "user_id", NOW, 20, 20.0), 5)


@query("r6_r8_budgets", "WITH e AS (SELECT event_type, event_id, epoch_us(ts) // 1000000 AS t, lag(epoch_us(ts) // 1000000) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events) SELECT event_id, cast(CASE WHEN p IS NULL THEN 1 ELSE floor((t - p) * 0.01) END AS BIGINT) AS budget, round((SELECT (count(*) - 1) / (max(t) - min(t)) FROM e), 9) AS advised FROM e")
def r6(spark, d):
    e = read(spark, d, "events").select("event_type", "event_id", "ts", epoch_s(F.col("ts")).alias("req_ts"))
    b = R.recommended_budget(e)  # one row
    return previous(e, ["event_type"], ["ts", "event_id"], "req_ts", "p").join(F.broadcast(b)).select("event_id", V.refresh_budget(F.col("req_ts"), F.col("p"), 0.01).alias("budget"), F.round("budget", 9).alias("advised"))


@query("r1_r2_r4_r7_serve_after_refresh", f"WITH {FB_SQL}, s AS (SELECT user_id, label_ts, least(sum(err), 20) AS e FROM fb WHERE label_ts <= {NOW} GROUP BY 1, 2), top AS (SELECT user_id FROM s GROUP BY 1 ORDER BY sum(e) DESC, user_id LIMIT 20), st AS (SELECT user_id, count(*)::DOUBLE AS n, avg(value) AS mean, {NOW} AS stored FROM events WHERE epoch_us(ts) // 1000000 < {NOW} AND user_id IN (SELECT user_id FROM top) GROUP BY 1), r AS (SELECT event_id AS req_id, user_id, epoch_us(ts) // 1000000 AS req_ts FROM events) SELECT req_id, coalesce(n, 0) AS n, round(coalesce(mean, 0), 5) AS mean, coalesce(stored, req_ts) AS stored_at FROM r LEFT JOIN st USING (user_id)")
def r7(spark, d):
    fb = feedback(spark, d)
    chosen = materialize(R.choose(fb, "user_id", NOW, 20, 20.0))
    empty = spark.createDataFrame([], "user_id long, n double, mean double, stored_at long")
    store = R.refresh(empty, chosen, fb, "user_id", NOW, "label_ts", "value")
    r = read(spark, d, "events").select(F.col("event_id").alias("req_id"), "user_id", epoch_s(F.col("ts")).alias("req_ts"))
    return rounded(R.serve(r, store, ["user_id"], ["n", "mean"]).select("req_id", "n", "mean", "stored_at"), 5)


@query("st1_hourly_store_stream", "WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour_ts, count(value) AS count_value, round(sum(value), 5) AS sum_value, round(avg(value), 5) AS avg_value, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY 1, 2) SELECT * FROM h WHERE hour_ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def st1(spark, d):
    e = read(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    base = shared_dir(spark)
    e.repartitionByRange(4, "ts").write.parquet(f"{base}/in")
    stream = jobs.hourly_store_stream(jobs.file_stream(spark, f"{base}/in", e.schema, 100), "event_type", "ts", "value")
    jobs.run_available(stream, f"{base}/out", f"{base}/cp")
    return rounded(spark.read.schema(stream.schema).parquet(f"{base}/out").withColumn("hour_ts", F.col("hour_ts").cast("timestamp_ntz")), 5)


@query(
    "st1_hourly_median_stream",
    "WITH e AS (SELECT event_type, date_trunc('hour', ts) AS h, date_trunc('day', ts) AS day, value FROM events WHERE value IS NOT NULL), c AS (SELECT max(h) AS last FROM e WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)) SELECT event_type, day, count(*) AS n, true AS median_within, true AS p90_within FROM e, c WHERE h <= last GROUP BY 1, 2",
)
def st1_median(spark, d):
    """Medians and 90 % quantiles of days from the stream's hourly sketches: whether their ranks among the day's values are within the stated error."""
    from inkling.operators import sketches

    e = read(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    base = shared_dir(spark)
    e.repartitionByRange(4, "ts").write.parquet(f"{base}/in")
    stream = jobs.sketch_store_stream(jobs.file_stream(spark, f"{base}/in", e.schema, 100), "event_type", "ts", "value")
    jobs.run_available(stream, f"{base}/out", f"{base}/cp")
    hours = spark.read.schema(stream.schema).parquet(f"{base}/out")
    days = sketches.merged(hours.withColumn("day", F.date_trunc("day", "hour_ts")), ["event_type", "day"])
    told = days.select("event_type", "day", "n", sketches.quantile(0.5).alias("q50"), sketches.quantile(0.9).alias("q90"))
    stored = hours.select("event_type", "hour_ts")
    rows = e.filter("value IS NOT NULL").withColumns({"hour_ts": F.date_trunc("hour", "ts"), "day": F.date_trunc("day", "ts")}).join(stored, ["event_type", "hour_ts"], "left_semi").join(told, ["event_type", "day"])
    # A quantile's rank lies between the shares of smaller values and of values up to it; a value's own share is no error.
    within = lambda q, p: ((F.avg((F.col("value") < F.col(q)).cast("double")) <= p + sketches.RANK_ERROR + 1 / F.count(F.lit(1))) & (F.avg((F.col("value") <= F.col(q)).cast("double")) >= p - sketches.RANK_ERROR - 1 / F.count(F.lit(1))))
    out = rows.groupBy("event_type", "day", "n").agg(within("q50", 0.5).alias("median_within"), within("q90", 0.9).alias("p90_within"))
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("st2_refresh_stream", f"WITH {FB_SQL}, s AS (SELECT user_id, label_ts, least(sum(err), 20) AS e FROM fb GROUP BY 1, 2) SELECT user_id, round(sum(e), 8) AS priority FROM s GROUP BY 1")
def st2(spark, d):
    fb, base = feedback(spark, d).select("user_id", "label_ts", "err"), shared_dir(spark)
    fb.repartition(4, "user_id").write.parquet(f"{base}/in")
    jobs.regret_log(jobs.file_stream(spark, f"{base}/in", fb.schema, 2), "user_id", 20.0, base, lateness="60 days").awaitTermination()
    last = jobs.regrets(spark, base, "user_id", "bigint")
    return rounded(last.groupBy("user_id").agg(F.sum("e").alias("priority")), 8)


BATCHES = (1704844800, 1705708800)  # the 10th and the 20th: three batches
_BATCH = f"CASE WHEN label_ts < {BATCHES[0]} THEN 0 WHEN label_ts < {BATCHES[1]} THEN 1 ELSE 2 END"
_TOP = lambda k: f"c{k} AS (SELECT user_id FROM p{k} ORDER BY round(e, 6) DESC, user_id LIMIT 20)"
_DUE = lambda k: f"p{k} AS (SELECT user_id, sum(e) AS e FROM (SELECT user_id, e FROM p{k - 1} WHERE user_id NOT IN (SELECT user_id FROM c{k - 1}) UNION ALL SELECT user_id, e FROM e WHERE k = {k}) GROUP BY 1)"


@query(
    "st2_refresh_by_regret_stream",
    f"""WITH {FB_SQL}, b AS (SELECT *, {_BATCH} AS k FROM fb), e AS (SELECT user_id, k, least(sum(err), 20) AS e FROM b GROUP BY user_id, k, label_ts), t AS (SELECT k, max(label_ts) AS now FROM b GROUP BY 1),
    p0 AS (SELECT user_id, sum(e) AS e FROM e WHERE k = 0 GROUP BY 1), {_TOP(0)}, {_DUE(1)}, {_TOP(1)}, {_DUE(2)}, {_TOP(2)},
    c AS (SELECT user_id, max(k) AS k FROM (SELECT user_id, 0 AS k FROM c0 UNION ALL SELECT user_id, 1 FROM c1 UNION ALL SELECT user_id, 2 FROM c2) GROUP BY 1),
    w AS (SELECT user_id, e AS priority FROM p2 WHERE user_id NOT IN (SELECT user_id FROM c2))
    SELECT c.user_id, any_value(now) AS stored_at, count(value) AS n, round(avg(value) + 1e-8, 5) AS mean, round(coalesce(any_value(priority), 0) + 1e-8, 4) AS waiting
    FROM c JOIN t USING (k) LEFT JOIN w USING (user_id) LEFT JOIN events e ON e.user_id = c.user_id AND epoch_us(e.ts) // 1000000 < now GROUP BY 1""",
)
def st2_refresh(spark, d):
    """Three batches of feedback in the order of time: the store at the end, and what its keys have gathered since their refresh."""
    fb, base = materialize(feedback(spark, d)), shared_dir(spark)
    ends = [None, *BATCHES, None]
    for lo, hi in zip(ends, ends[1:]):
        part = fb.filter((F.col("label_ts") >= lo) if lo else F.lit(True)).filter((F.col("label_ts") < hi) if hi else F.lit(True))
        part.select("user_id", "label_ts", "err").repartition(2).write.mode("append").parquet(f"{base}/in")
    stream = jobs.file_stream(spark, f"{base}/in", fb.select("user_id", "label_ts", "err").schema, 2)
    jobs.refresh_stream(stream, fb, base, "user_id", "value", 20, 20.0).awaitTermination()
    stored = spark.read.schema("user_id long, n long, mean double, stored_at long").option("recursiveFileLookup", True).parquet(f"{base}/store")
    last = stored.groupBy("user_id").agg(F.max_by(F.struct("stored_at", "n", "mean"), "stored_at").alias("s")).select("user_id", "s.*")
    left = jobs.regrets(spark, base, "user_id", "bigint").join(last.select("user_id", "stored_at"), "user_id").filter("label_ts > stored_at")
    waiting = left.groupBy("user_id").agg(F.sum("e").alias("priority"))
    out = last.join(waiting, "user_id", "left")
    return out.select("user_id", "stored_at", "n", F.round(F.col("mean") + 1e-8, 5).alias("mean"), F.round(F.coalesce("priority", F.lit(0.0)) + 1e-8, 4).alias("waiting"))


@query("st3_scoring_stream", f"WITH {REQ} SELECT req_id, count(value) AS n, round(coalesce(avg(value), 0), 6) AS mean FROM req LEFT JOIN f ON req.event_type = f.event_type AND f.ts >= req_ts - {DAY} AND f.ts < req_ts GROUP BY req_id")
def st3(spark, d):
    e, base = read(spark, d, "events"), shared_dir(spark)
    r = requests(e).select("req_id", "event_type", "req_ts")
    r.repartition(4).write.parquet(f"{base}/in")
    known = facts(e)
    step = lambda batch, k: jobs.score_requests(batch, known, ["event_type"], DAY).write.mode("overwrite").parquet(f"{base}/out/batch={k}")
    jobs.for_each_batch(jobs.file_stream(spark, f"{base}/in", r.schema, 2), step, f"{base}/cp").awaitTermination()
    return rounded(spark.read.schema("req_id long, n long, mean double").option("recursiveFileLookup", True).parquet(f"{base}/out"))


def order_rows(spark, d):
    """Orders with their customer's features; the label is the order's price."""
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return V.random_split(joined.select(F.col("o_orderkey").alias("req_id"), "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"), F.month("o_orderdate").cast("double").alias("month"), F.col("o_totalprice").alias("label")), "req_id")


ORDER_FEATURES = ["c_acctbal", "c_nationkey", "month"]


@query("m1_m2_m5_train_and_score")
def m1(spark, d):
    """Scaled regression of a feature table, scored in batch (held-out rows): req_id, label, prediction."""
    from inkling.operators import ml

    split = order_rows(spark, d)
    model = ml.make_model("linear", ORDER_FEATURES, scaler="standard").fit(split.filter("split = 'train'"))
    return ml.scoring(model).transform(split.filter("split = 'test'")).select("req_id", "label", "prediction")


@query("m1_m2_models_and_scalers")
def m1_all(spark, d):
    """Held-out error of every kind of model, each with one of the scalers: kind, scaler, mse or share of right classes, rows."""
    from inkling.operators import ml

    rows = order_rows(spark, d).withColumn("dear", (F.col("label") > 150000).cast("double"))
    split = materialize(ml.dealt(rows, "req_id", read(spark, d, "orders").count()))
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    scalers, out = [*ml.SCALERS, None], None
    of = [(kind, "dear" if kind in ml.CLASSIFIERS else "label", scalers[k % len(scalers)]) for k, kind in enumerate([*ml.MODELS, "mlp_classifier"])]
    fitted = ml.fit_all([ml.make_model(kind, ORDER_FEATURES, scaler=scaler, label=label) for kind, label, scaler in of], train)
    for (kind, label, scaler), model in zip(of, fitted):
        sorts, told = kind in ml.CLASSIFIERS, model.transform(test)
        miss = F.col("prediction") - F.col(label)
        score = F.avg((miss == 0).cast("double")) if sorts else F.avg(miss * miss)
        row = told.agg(F.lit(kind).alias("kind"), F.lit(scaler or "none").alias("scaler"), score.alias("score"), F.count(F.lit(1)).alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


@query("m3_grid_search")
def m3(spark, d):
    """Mean cross-validated error of each parameter setting."""
    from inkling.operators import ml

    rows = read(spark, d, "lineitem").select("l_quantity", "l_discount", F.col("l_extendedprice").alias("label"))
    return ml.grid_search(rows, "linear", ["l_quantity", "l_discount"], {"regParam": [0.0, 0.1]}, folds=3)


@query("i9_i10_importances")
def i9(spark, d):
    """Mean loss of r2 when a feature is permuted, and the model's own importances."""
    from inkling.operators import ml

    rows = read(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("req_id"), "l_quantity", "l_discount", F.col("l_extendedprice").alias("label"))
    model = ml.make_model("tree", ["l_quantity", "l_discount"]).fit(rows)
    return ml.permutation_importance(model, materialize(rows), "req_id", ["l_quantity", "l_discount"], repeats=3).join(ml.importances(model, ["l_quantity", "l_discount"]), "fname")


_STEP = lambda k: f"(SELECT l_suppkey AS req_id, avg(l_quantity) AS m, CASE WHEN count(*) < 30 THEN 1e9 ELSE stddev_samp(l_quantity) / sqrt(count(*)) END AS e FROM lineitem WHERE {PID} < {k} GROUP BY 1)"
_DRAWN = lambda k: f"d{k} AS (SELECT req_id, m + e * {sql_normal_ppf('u')} + 5.0 AS x FROM (SELECT f.*, {u32(chr(39) + '0|' + chr(39) + ' || req_id || ' + chr(39) + '|avg_qty|' + chr(39) + ' || i')} AS u FROM {_STEP(k)} f, range(100) r(i))), c{k} AS (SELECT req_id, avg(cast(abs(x - mu) <= 1.5 AS INTEGER)) AS conf FROM d{k} JOIN (SELECT req_id, avg(x) AS mu FROM d{k} GROUP BY 1) USING (req_id) GROUP BY 1)"


@query("i7_previous_step_influence", f"WITH {_DRAWN(30)}, {_DRAWN(20)} SELECT req_id, 'q2' AS frozen, round(c30.conf - c20.conf, 6) AS qinf FROM c30 JOIN c20 USING (req_id)")
def i7(spark, d):
    """Gain in confidence from the last sample step: the same prediction from pid < 30 and from pid < 20."""
    from inkling.operators import influence as I
    from inkling.operators import propagate as U

    from .estimate_queries import BIAS, WEIGHTS

    def told(k):
        rows = assign_pid(read(spark, d, "lineitem"), KEY).filter(F.col("pid") < k)
        from inkling.operators.estimate import estimates

        f = estimates(rows, ["l_suppkey"], "l_quantity", k / 100, 1, ["avg"]).select(F.col("l_suppkey").alias("req_id"), F.lit("avg_qty").alias("fname"), "fval", "fest", "fdist")
        return U.summarise(U.linear(U.draws(f, 100), WEIGHTS, BIAS, ["req_id", "i"]), "error", 1.5)

    return rounded(I.gain(told(30).withColumn("frozen", F.lit("q2")), told(20)))
