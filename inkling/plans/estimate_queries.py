"""Sampled estimates, bootstrap, propagation and influence."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkling.functions.estimators import normal_ppf, sql_normal_cdf, sql_normal_ppf
from inkling.functions.hashing import uniform
from inkling.operators import estimate as E
from inkling.operators import influence as I
from inkling.operators import propagate as U
from inkling.operators.matching import default_estimates
from inkling.operators.metrics import jarque_bera, ks_normal, ks_two_sample
from inkling.sources.ingest import assign_pid, read

from .base import h32, query, rounded, u32

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = " || '|' || ".join(KEY)
PID = f"({h32(chr(39) + '0|' + chr(39) + ' || ' + KEY_SQL)} % 100)"
P = 0.3
OPS = ["count", "sum", "avg", "varSamp", "stdSamp", "varPop", "stdPop", "min", "max", "unique", "median", "percentile90", "percentile99"]


def sampled(spark, d, k=30):
    return assign_pid(read(spark, d, "lineitem"), KEY).filter(F.col("pid") < k)


def _estimate_sql(ops, p=P, unknown=1e9):
    n, n1 = "n", "(n - 1)"
    fc = f"(n / (T * {p}))"
    var_s, var_p = f"CASE WHEN n > 1 THEN n / {n1} * v WHEN n = 1 THEN 0 END", "CASE WHEN n > 1 THEN v WHEN n = 1 THEN 0 END"
    table = {
        "count": (f"cast(round_even(n / {p}, 0) AS DOUBLE)", f"T * sqrt(greatest(0, (1 - {p}) * {fc} * (1 - {fc})) / ({p} * (T - 1)))"),
        "sum": (f"s1 / {p}", f"T * sqrt(v) * sqrt((1 - {p}) / ({p} * (T - 1)))"),
        "avg": ("m", "sqrt(v) / sqrt(n)"),
        "varSamp": (var_s, f"2 * v * v / {n1} * pow(n / {n1}, 2)"),
        "stdSamp": (f"sqrt({var_s})", f"sqrt(2 * v * v / {n1} * pow(n / {n1}, 2))"),
        "varPop": (var_p, f"2 * v * v / {n1}"),
        "stdPop": (f"sqrt({var_p})", f"sqrt(2 * v * v / {n1})"),
        "min": ("lo", "NULL"), "max": ("hi", "NULL"), "unique": ("cast(u AS DOUBLE)", "NULL"), "median": ("q50", "NULL"), "percentile90": ("q90", "NULL"), "percentile99": ("q99", "NULL"),
    }
    exact = "true" if p == 1 else "false"
    rows = " UNION ALL ".join(f"SELECT l_suppkey, '{o}' AS op, {table[o][0]} AS fval, CASE WHEN {exact} THEN 0 WHEN n < 30 THEN {unknown} ELSE {table[o][1]} END AS fest, cast(round_even(n / {p}, 0) AS DOUBLE) AS card FROM g" for o in ops)
    return f"""WITH t AS (SELECT count(*) AS T FROM lineitem), g AS (SELECT l_suppkey, any_value(T) AS T, count(l_quantity) AS n, sum(l_quantity) AS s1, avg(l_quantity) AS m, var_samp(l_quantity) AS v, min(l_quantity) AS lo, max(l_quantity) AS hi, count(DISTINCT l_quantity) AS u,
    quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.9) AS q90, quantile_cont(l_quantity, 0.99) AS q99 FROM lineitem, t WHERE {PID} < {int(100 * p)} GROUP BY 1), r AS ({rows})
    SELECT l_suppkey, op, round(fval, 5) AS fval, round(fest, 5) AS fest, card, CASE WHEN abs(fest) < 1e-9 THEN 'fixed' WHEN op = 'max' THEN 'r-normal' ELSE 'normal' END AS fdist FROM r"""


@query("e1_e15_sampled_estimates", _estimate_sql(OPS))
def e1(spark, d):
    size = read(spark, d, "lineitem").count()
    return rounded(E.estimates(sampled(spark, d), ["l_suppkey"], "l_quantity", P, size, OPS), 5)


@query("e15_whole_table_is_exact", _estimate_sql(["count", "sum", "avg", "varPop", "stdSamp"], 1))
def e15(spark, d):
    size = read(spark, d, "lineitem").count()
    return rounded(E.estimates(sampled(spark, d, 100), ["l_suppkey"], "l_quantity", 1.0, size, ["count", "sum", "avg", "varPop", "stdSamp"]), 5)


@query("e8_biased_variants", f"SELECT l_suppkey, round(var_samp(l_quantity), 5) AS \"varSamp_biased\", round(stddev_samp(l_quantity), 5) AS \"stdSamp_biased\", round(var_pop(l_quantity), 5) AS \"varPop_biased\", round(stddev_pop(l_quantity), 5) AS \"stdPop_biased\" FROM lineitem WHERE {PID} < 30 GROUP BY 1")
def e8(spark, d):
    v = "l_quantity"
    return rounded(sampled(spark, d).groupBy("l_suppkey").agg(F.var_samp(v).alias("varSamp_biased"), F.stddev_samp(v).alias("stdSamp_biased"), F.var_pop(v).alias("varPop_biased"), F.stddev_pop(v).alias("stdPop_biased")), 5)


_W = f"({' + '.join(f'cast(u > {c!r} AS INTEGER)' for c in E.POISSON_CUTS)})"
BOOT = f"""b AS (SELECT l_suppkey, rep, l_quantity AS x, {_W} AS w FROM (SELECT *, {u32(f"'0|' || rep || '|' || {KEY_SQL}")} AS u FROM lineitem, range(20) r(rep) WHERE {PID} < 10) WHERE w > 0),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey, rep ORDER BY x RANGE UNBOUNDED PRECEDING) AS cw, sum(w) OVER (PARTITION BY l_suppkey, rep) AS n FROM b),
boot AS (SELECT l_suppkey, rep, sum(w * x) / sum(w) AS mean, min(x) FILTER (WHERE cw * 2 >= n) AS median FROM c GROUP BY 1, 2)"""


def _means(spark, d):
    return E.bootstrap_means(sampled(spark, d, 10).select(*KEY, "l_quantity"), ["l_suppkey"], KEY, "l_quantity", 20)


def _boot(spark, d):
    return E.poisson_bootstrap(sampled(spark, d, 10).select(*KEY, "l_quantity"), ["l_suppkey"], KEY, "l_quantity", 20)


@query("e16_poisson_bootstrap", f"WITH {BOOT} SELECT l_suppkey, round(stddev_samp(mean), 6) AS fest, round(avg(mean), 6) AS fval FROM boot GROUP BY 1")
def e16(spark, d):
    return rounded(E.bootstrap_error(_means(spark, d), ["l_suppkey"], "mean"))


_STATS = {"varSamp": "n / (n - 1) * v", "stdSamp": "sqrt(n / (n - 1) * v)", "varPop": "v", "stdPop": "sqrt(v)", "min": "lo", "max": "hi", "unique": "u", "median": "p50", "percentile90": "p90", "percentile99": "p99"}
_ALL = f"""b AS (SELECT l_suppkey, rep, l_quantity AS x, {_W} AS w FROM (SELECT *, {u32(f"'0|' || rep || '|' || {KEY_SQL}")} AS u FROM lineitem, range(20) r(rep) WHERE {PID} < 10) WHERE w > 0),
m AS (SELECT l_suppkey, rep, x FROM b, range(8) c(i) WHERE i < w),
boot AS (SELECT l_suppkey, rep, count(*) AS n, var_samp(x) AS v, min(x) AS lo, max(x) AS hi, count(DISTINCT x) AS u, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.99) AS p99 FROM m GROUP BY 1, 2),
err AS ({' UNION ALL '.join(f"SELECT l_suppkey, '{o}' AS op, stddev_samp(cast({x} AS DOUBLE)) AS e FROM boot GROUP BY 1" for o, x in _STATS.items())}),
size AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE {PID} < 10 GROUP BY 1)"""


@query("e9_e10_e16_bootstrap_errors", f"WITH {_ALL} SELECT l_suppkey, op, round(CASE WHEN n < 30 THEN 1e9 ELSE e END + 1e-8, 5) AS fest FROM err JOIN size USING (l_suppkey)")
def e9(spark, d):
    """Errors of the aggregates without a closed form, and of variances and deviations, from resamples."""
    points = E.estimates(sampled(spark, d, 10), ["l_suppkey"], "l_quantity", 0.1, read(spark, d, "lineitem").count(), list(_STATS))
    out = E.with_bootstrap(points, _boot(spark, d), ["l_suppkey"], 0.1)
    return out.select("l_suppkey", "op", F.round(F.col("fest") + 1e-8, 5).alias("fest"))


@query("e17_bias_correction", f"WITH {BOOT}, p AS (SELECT l_suppkey, avg(l_quantity) AS f FROM lineitem WHERE {PID} < 10 GROUP BY 1) SELECT l_suppkey, round(stddev_samp(mean), 6) AS fest, round(2 * any_value(f) - avg(mean), 6) AS fval FROM boot JOIN p USING (l_suppkey) GROUP BY 1")
def e17(spark, d):
    point = sampled(spark, d, 10).groupBy("l_suppkey").agg(F.avg("l_quantity").alias("fval"))
    return rounded(E.bootstrap_error(_means(spark, d), ["l_suppkey"], "mean", point, bias_correction=True))


@query("e18_e19_replicates", f"WITH {BOOT} SELECT l_suppkey, round(stddev_samp(median), 6) AS fest, round(avg(median), 6) AS fval, cast(count(*) AS INTEGER) AS n_reps, CASE WHEN stddev_samp(median) < 1e-9 THEN 'fixed' ELSE 'unknown' END AS fdist FROM boot GROUP BY 1")
def e18(spark, d):
    from inkling.functions.estimators import distribution

    out = E.bootstrap_error(_boot(spark, d), ["l_suppkey"], "median", keep=True)
    return rounded(out.select("l_suppkey", "fest", "fval", F.size("reps").alias("n_reps"), distribution(F.col("fest"), "median", F.col("reps")).alias("fdist")))


@query(
    "e21_prefix_profile",
    f"""WITH g AS (SELECT l_suppkey, cast({PID} AS INTEGER) AS pid, count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS ss, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2),
    c AS (SELECT l_suppkey, pid, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(ss) OVER w AS ss, min(lo) OVER w AS lo, max(hi) OVER w AS hi FROM g WINDOW w AS (PARTITION BY l_suppkey ORDER BY pid)),
    v AS (SELECT *, CASE WHEN n > 1 THEN greatest(0, (ss - s * s / n) / (n - 1)) WHEN n = 1 THEN 0 END AS var FROM c)
    SELECT l_suppkey, pid, cast(round_even(n / ((pid + 1) / 100.0), 0) AS DOUBLE) AS count, round(s / ((pid + 1) / 100.0), 4) AS sum, round(s / n, 4) AS avg,
    round(CASE WHEN pid = 99 THEN 0 WHEN n < 30 THEN 1e9 ELSE sqrt(var) / sqrt(n) END, 4) AS avg_error, round(var, 4) AS "varPop", round(sqrt(var), 4) AS "stdPop", lo, hi FROM v""",
)
def e21(spark, d):
    return rounded(E.prefix_profile(assign_pid(read(spark, d, "lineitem"), KEY), ["l_suppkey"], "l_quantity", 100), 4)


STUDY = f"""x AS (SELECT l_suppkey, avg(l_quantity) AS exact FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey, seed, l_quantity AS q FROM lineitem, range(10) r(seed) WHERE {u32(f"seed || '|' || {KEY_SQL}")} < 0.2),
study AS (SELECT l_suppkey, seed, avg(q) - any_value(exact) AS error, abs(avg(q) - any_value(exact)) <= 1.959963984540054 * stddev_samp(q) / sqrt(count(q)) AS covered FROM s JOIN x USING (l_suppkey) GROUP BY 1, 2)"""


def _study(spark, d):
    return E.error_study(read(spark, d, "lineitem").select(*KEY, "l_quantity"), ["l_suppkey"], KEY, "l_quantity", 0.2, 10)


@query("e22_v10_error_study", f"WITH {STUDY} SELECT l_suppkey, round(avg(error), 6) AS bias, round(stddev_samp(error), 6) AS spread, round(avg(cast(covered AS INTEGER)), 6) AS coverage FROM study GROUP BY 1")
def e22(spark, d):
    return rounded(_study(spark, d).groupBy("l_suppkey").agg(F.avg("error").alias("bias"), F.stddev_samp("error").alias("spread"), F.avg(F.col("covered").cast("int")).alias("coverage")))


@query("v11_jarque_bera", f"WITH {STUDY}, m AS (SELECT l_suppkey, error, avg(error) OVER (PARTITION BY l_suppkey) AS mu FROM study), g AS (SELECT l_suppkey, count(*) AS n, avg((error - mu) ** 3) / stddev_pop(error) ** 3 AS s, avg((error - mu) ** 4) / stddev_pop(error) ** 4 - 3 AS k FROM m GROUP BY 1) SELECT l_suppkey, round(n / 6 * (s ** 2 + k ** 2 / 4), 5) AS jb, round(exp(-n / 6 * (s ** 2 + k ** 2 / 4) / 2), 5) AS p FROM g")
def v11(spark, d):
    return rounded(jarque_bera(_study(spark, d), ["l_suppkey"], "error"), 5)


@query("v12_ks_statistic", "WITH p AS (SELECT l_suppkey, l_quantity AS x, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS a, count(*) FILTER (WHERE l_linenumber % 2 = 1) AS b FROM lineitem GROUP BY 1, 2), c AS (SELECT l_suppkey, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY l_suppkey) - sum(b) OVER w / sum(b) OVER (PARTITION BY l_suppkey)) AS gap FROM p WINDOW w AS (PARTITION BY l_suppkey ORDER BY x)) SELECT l_suppkey, round(max(gap), 6) AS ks FROM c GROUP BY 1")
def v12(spark, d):
    rows = read(spark, d, "lineitem").select("l_suppkey", "l_quantity", (F.col("l_linenumber") % 2).alias("side"))
    return rounded(ks_two_sample(rows, ["l_suppkey"], "l_quantity", "side"))


_Z = sql_normal_cdf("((x - m) / s)")


@query("v12_ks_normal", f"WITH p AS (SELECT l_suppkey, l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1, 2), q AS (SELECT l_suppkey, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, count(*) AS c FROM lineitem GROUP BY 1), f AS (SELECT l_suppkey, n / c AS own, sum(n) OVER (PARTITION BY l_suppkey ORDER BY x) / c AS f, {_Z} AS g FROM p JOIN q USING (l_suppkey) WHERE s > 0) SELECT l_suppkey, round(max(greatest(abs(f - g), abs(g - f + own))), 6) AS ks FROM f GROUP BY 1")
def v12_normal(spark, d):
    return rounded(ks_normal(read(spark, d, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity"))


@query("p12_default_vectors", f"WITH r AS (SELECT DISTINCT user_id AS req_id FROM events), g AS (SELECT user_id AS req_id, count(value) AS n, avg(value) AS m, stddev_samp(value) AS s FROM events WHERE {h32(chr(39) + '0|' + chr(39) + ' || event_id')} % 100 < 20 GROUP BY 1) SELECT req_id, round(coalesce(m, 0) + 1e-8, 5) AS fval, round(CASE WHEN n IS NULL OR n < 3 THEN 1e9 ELSE s / sqrt(n) END + 1e-8, 5) AS fest FROM r LEFT JOIN g USING (req_id)")
def p12(spark, d):
    """Averages of a user's sampled events; users with no sampled event get the default vector."""
    e = read(spark, d, "events")
    est = E.estimates(assign_pid(e, ["event_id"]).filter("pid < 20"), ["user_id"], "value", 0.2, 1, ["avg"], min_support=3)
    out = default_estimates(e.select(F.col("user_id").alias("req_id")).distinct(), est.select(F.col("user_id").alias("req_id"), "fval", "fest"), "req_id", 0.2)
    return out.select("req_id", *[F.round(F.col(c) + 1e-8, 5).alias(c) for c in ("fval", "fest")])


# --- propagation: three features of each supplier, a linear model ---------------------------------------------

WEIGHTS, BIAS = {"avg_price": 0.001, "avg_qty": 1.0, "n": 0.01}, 5.0
GROUPS = {"avg_price": 1, "avg_qty": 2, "n": 3}


def features(spark, d):
    """(req_id, fname, qname, fval, fest, fdist) of every supplier from a 30 % sample."""
    size = read(spark, d, "lineitem").count()
    s = sampled(spark, d)
    price = E.estimates(s, ["l_suppkey"], "l_extendedprice", P, size, ["avg"]).withColumn("fname", F.lit("avg_price"))
    qty = E.estimates(s, ["l_suppkey"], "l_quantity", P, size, ["avg", "count"]).withColumn("fname", F.when(F.col("op") == "avg", "avg_qty").otherwise("n"))
    return price.unionByName(qty).select(F.col("l_suppkey").alias("req_id"), "fname", F.col("fname").alias("qname"), "fval", "fest", "fdist")


FEAT = f"""t AS (SELECT count(*) AS T FROM lineitem), g AS (SELECT l_suppkey AS req_id, any_value(T) AS T, count(*) AS n, avg(l_extendedprice) AS mp, stddev_samp(l_extendedprice) AS sp, avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq FROM lineitem, t WHERE {PID} < 30 GROUP BY 1),
feat AS (SELECT req_id, 'avg_price' AS fname, mp AS fval, CASE WHEN n < 30 THEN 1e9 ELSE sp / sqrt(n) END AS fest FROM g UNION ALL SELECT req_id, 'avg_qty', mq, CASE WHEN n < 30 THEN 1e9 ELSE sq / sqrt(n) END FROM g
UNION ALL SELECT req_id, 'n', cast(round_even(n / {P}, 0) AS DOUBLE), CASE WHEN n < 30 THEN 1e9 ELSE T * sqrt((1 - {P}) * (n / (T * {P})) * (1 - n / (T * {P})) / ({P} * (T - 1))) END FROM g),
w AS (SELECT * FROM (VALUES ('avg_price', 0.001::DOUBLE, 1, 0), ('avg_qty', 1.0::DOUBLE, 2, 1), ('n', 0.01::DOUBLE, 3, 2)) v(fname, weight, grp, dim))"""
DRAWS = f"""d AS (SELECT req_id, i, fname, fval + fest * {sql_normal_ppf('u')} AS x FROM (SELECT *, {u32("'0|' || req_id || '|' || fname || '|' || i")} AS u FROM feat, range(100) r(i))), preds AS (SELECT req_id, i, sum(x * weight) + {BIAS} AS pred FROM d JOIN w USING (fname) GROUP BY 1, 2)"""


def _preds(spark, d):
    return U.linear(U.draws(features(spark, d), 100), WEIGHTS, BIAS, ["req_id", "i"])


@query("u1_normal_ppf", f"SELECT event_id, round({sql_normal_ppf('((event_id % 9973 + 0.5) / 9973.0)')}, 6) AS z FROM events")
def u0(spark, d):
    return rounded(read(spark, d, "events").select("event_id", ((F.col("event_id") % 9973 + 0.5) / 9973.0).alias("_u")).select("event_id", normal_ppf(F.col("_u")).alias("z")))


@query("u1_feature_draws", f"WITH {FEAT}, {DRAWS} SELECT req_id, fname, round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS std FROM d GROUP BY 1, 2")
def u1(spark, d):
    return rounded(U.draws(features(spark, d), 100).groupBy("req_id", "fname").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")), 5)


def _constraint(name, kind, value, dev):
    share = f"{value}::DOUBLE AS pred_conf, round(quantile_cont(dev, {value}), 5) AS pred_error" if kind == "conf" else f"{value}::DOUBLE AS pred_error, round(avg(cast(dev <= {value} AS INTEGER)), 5) AS pred_conf"

    @query(name, f"WITH {FEAT}, {DRAWS}, a AS (SELECT req_id, avg(pred) AS pv, var_pop(pred) AS pvar FROM preds GROUP BY 1), e AS (SELECT req_id, pv, pvar, {dev} AS dev FROM preds JOIN a USING (req_id)) SELECT req_id, round(any_value(pv), 5) AS pred_value, round(any_value(pvar), 5) AS pred_var, {share} FROM e GROUP BY 1")
    def run(spark, d):
        return rounded(U.summarise(_preds(spark, d), kind, value), 5)


_constraint("u2_u6_u7_monte_carlo_error", "error", 1.5, "abs(pred - pv)")
_constraint("u8_confidence_constraint", "conf", 0.95, "abs(pred - pv)")
_constraint("u9_relative_error_constraint", "relative_error", 0.02, "abs(pred - pv) / greatest(abs(pv), 1e-9)")


@query("u6_classifier_mode", f"WITH {FEAT}, {DRAWS}, c AS (SELECT req_id, cast(pred > 80 AS INTEGER) AS cls, count(*) AS n FROM preds GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY n DESC, cls) AS i FROM c) SELECT req_id, cls AS pred_value, round(n / 100, 4) AS pred_conf FROM r WHERE i = 1")
def u6(spark, d):
    p = _preds(spark, d).select("req_id", (F.col("pred") > 80).cast("int").alias("pred"))
    out = U.summarise(p, "error", 0.0, classifier=True)
    return rounded(out.select("req_id", "pred_value", "pred_conf"), 4)


NQ = 64
_REC = lambda step: f"greatest(1e-9, (i + 1) * {step} + 0.5 - floor((i + 1) * {step} + 0.5))"
_STEP = lambda o: "CASE dim " + " ".join(f"WHEN {j} THEN {U.root(j + o)!r}" for j in range(3)) + " END"
SALT = f"""sal AS (SELECT req_id, i, k, weight * (fval + greatest(fest, 1e-9) * {sql_normal_ppf('u')}) AS y FROM (SELECT *, CASE WHEN k = 4 OR k = grp THEN {_REC('(' + _STEP(3) + ')')} ELSE {_REC('(' + _STEP(0) + ')')} END AS u FROM feat JOIN w USING (fname), range({NQ}) r(i), range(5) s(k))), sp AS (SELECT req_id, i, k, sum(y) + {BIAS} AS pred FROM sal GROUP BY 1, 2, 3)"""
ENDS = "z AS (SELECT req_id, avg(pred) AS mu, var_pop(pred) AS v FROM sp WHERE k IN (0, 4) GROUP BY 1), tri AS (SELECT c.req_id, c.k, c.i, a.pred AS a, b.pred AS b, c.pred AS c, mu, v FROM sp c JOIN sp a ON a.req_id = c.req_id AND a.i = c.i AND a.k = 0 JOIN sp b ON b.req_id = c.req_id AND b.i = c.i AND b.k = 4 JOIN z ON z.req_id = c.req_id WHERE c.k BETWEEN 1 AND 3)"


def _salt(spark, d):
    return U.linear(U.saltelli(features(spark, d), GROUPS, NQ), WEIGHTS, BIAS, ["req_id", "i", "k"])


@query("u3_u4_quasi_monte_carlo", f"WITH {FEAT}, {SALT} SELECT req_id, k, round(avg(pred), 5) AS mean, round(var_pop(pred), 5) AS var FROM sp GROUP BY 1, 2")
def u3(spark, d):
    return rounded(_salt(spark, d).groupBy("req_id", "k").agg(F.avg("pred").alias("mean"), F.var_pop("pred").alias("var")), 5).withColumn("k", F.col("k").cast("long"))


_AGAIN = lambda k: f"SELECT l_suppkey AS req_id, {k} AS k, avg(l_quantity) AS fval, stddev_samp(l_quantity) / sqrt(count(l_quantity)) AS fest FROM lineitem WHERE {PID} < {k} GROUP BY 1"


@query("u5_reused_sequence", f"WITH f AS ({_AGAIN(20)} UNION ALL {_AGAIN(30)}), d AS (SELECT req_id, k, i, fval + fest * {sql_normal_ppf('u')} AS x FROM (SELECT *, {_REC(repr(U.root(0)))} AS u FROM f, range({NQ}) r(i))) SELECT a.req_id, round(avg(b.x - a.x), 5) AS shift, round(stddev_pop(b.x - a.x), 5) AS spread FROM d a JOIN d b USING (req_id, i) WHERE a.k = 20 AND b.k = 30 GROUP BY 1")
def u5(spark, d):
    """Two rounds draw from one sequence, so their draws differ by what the estimates differ by, not by chance."""
    both = None
    for k in (20, 30):
        f = E.estimates(sampled(spark, d, k), ["l_suppkey"], "l_quantity", k / 100, 1, ["avg"], min_support=1).withColumn("k", F.lit(k))
        both = f if both is None else both.unionByName(f)
    x = both.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(NQ - 1)))).withColumn("_u", U.recurrence(F.col("i"), 0))
    x = x.select("l_suppkey", "i", "k", U.draw(F.col("_u"), F.col("fval"), F.col("fest"), F.lit("normal")).alias("x"))
    pairs = x.groupBy("l_suppkey", "i").agg((F.max(F.when(F.col("k") == 30, F.col("x"))) - F.max(F.when(F.col("k") == 20, F.col("x")))).alias("g"))
    return rounded(pairs.groupBy(F.col("l_suppkey").alias("req_id")).agg(F.avg("g").alias("shift"), F.stddev_pop("g").alias("spread")), 5)


@query("i1_i2_first_order_influence", f"WITH {FEAT}, {SALT}, {ENDS} SELECT req_id, k, round(avg((b - mu) * (c - a)) / any_value(v), 5) AS qinf FROM tri GROUP BY 1, 2")
def i1(spark, d):
    return rounded(I.sobol(_salt(spark, d), 3), 5).withColumn("k", F.col("k").cast("long"))


@query("i3_total_influence", f"WITH {FEAT}, {SALT}, {ENDS} SELECT req_id, k, round(avg(0.5 * (a - c) ** 2) / any_value(v), 5) AS qinf FROM tri GROUP BY 1, 2")
def i3(spark, d):
    return rounded(I.sobol(_salt(spark, d), 3, total=True), 5).withColumn("k", F.col("k").cast("long"))


FROZEN = f"""fd AS (SELECT req_id, i, z, fname, CASE WHEN z = fname THEN fval ELSE fval + fest * {sql_normal_ppf('u')} END AS x FROM (SELECT f.*, i, z, {u32("'0|' || req_id || '|' || f.fname || '|' || i")} AS u FROM feat f, range(100) r(i), (SELECT fname AS z FROM w))),
fp AS (SELECT req_id, z, i, sum(x * weight) + {BIAS} AS pred FROM fd JOIN w USING (fname) GROUP BY 1, 2, 3), fa AS (SELECT req_id, z, avg(pred) AS pv FROM fp GROUP BY 1, 2), fc AS (SELECT req_id, z, avg(cast(abs(pred - pv) <= 1.5 AS INTEGER)) AS conf, var_pop(pred) AS pvar FROM fp JOIN fa USING (req_id, z) GROUP BY 1, 2),
ba AS (SELECT req_id, avg(pred) AS pv, var_pop(pred) AS pvar FROM preds GROUP BY 1), bc AS (SELECT req_id, avg(cast(abs(pred - pv) <= 1.5 AS INTEGER)) AS conf, any_value(pvar) AS pvar FROM preds JOIN ba USING (req_id) GROUP BY 1)"""


def _direct(spark, d, measure="pred_conf"):
    return I.direct(features(spark, d), "qname", WEIGHTS, BIAS, 100, 1.5, measure)


@query("i4_i5_direct_influence", f"WITH {FEAT}, {DRAWS}, {FROZEN} SELECT req_id, z AS frozen, round(fc.conf - bc.conf, 5) AS qinf FROM fc JOIN bc USING (req_id)")
def i4(spark, d):
    return rounded(_direct(spark, d), 5)


@query("i6_influence_by_features", f"WITH {FEAT}, {DRAWS}, {FROZEN} SELECT req_id, CASE WHEN z = 'n' THEN 'q2' ELSE 'q1' END AS qname, round(sum(fc.conf - bc.conf), 5) AS qinf FROM fc JOIN bc USING (req_id) GROUP BY 1, 2")
def i6(spark, d):
    g = _direct(spark, d).withColumn("qname", F.when(F.col("frozen") == "n", "q2").otherwise("q1"))
    return rounded(g.groupBy("req_id", "qname").agg(F.sum("qinf").alias("qinf")), 5)


@query("i8_variance_influence", f"WITH {FEAT}, {DRAWS}, {FROZEN} SELECT req_id, z AS frozen, round(bc.pvar - fc.pvar, 5) AS qinf FROM fc JOIN bc USING (req_id)")
def i8(spark, d):
    return rounded(_direct(spark, d, "pred_var"), 5)
