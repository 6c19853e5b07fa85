"""Joins of requests with facts, and exact aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkling.functions.hashing import hash32, uniform
from inkling.functions.scalar import epoch_s, epoch_us
from inkling.operators import exact as A
from inkling.operators import matching as J
from inkling.operators import windows as W
from inkling.sources.ingest import hourly_store, read

from .base import DAY, HOUR, REQ, facts, h32, query, requests, rounded, u32


@query(
    "j1_trailing_window",
    f"""WITH {REQ} SELECT req_id, count(value) AS n, round(coalesce(avg(value), 0), 6) AS mean, round(coalesce(stddev_pop(value), 0), 6) AS std, round(coalesce(max(value), 0), 6) AS top, count(DISTINCT f.user_id) AS users
    FROM req LEFT JOIN f ON req.event_type = f.event_type AND f.ts >= req_ts - {7 * DAY} AND f.ts < req_ts GROUP BY req_id""",
)
def j1(spark, d):
    e = read(spark, d, "events")
    features = {"n": ("count", "value"), "mean": ("avg", "value"), "std": ("stdPop", "value"), "top": ("max", "value"), "users": ("unique", "user_id")}
    agg = W.trailing(requests(e), facts(e), ["event_type"], 7 * DAY, features)
    out = J.with_defaults(requests(e).select("req_id"), agg, "req_id", dict.fromkeys(features, 0.0))
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("n", "users")}))


@query("j2_forward_window", f"WITH {REQ} SELECT req_id, count(value) AS n, round(coalesce(avg(value), 0), 6) AS mean FROM req LEFT JOIN f ON req.event_type = f.event_type AND f.ts >= req_ts AND f.ts < req_ts + {HOUR} GROUP BY req_id")
def j2(spark, d):
    e = read(spark, d, "events")
    agg = W.trailing(requests(e), facts(e), ["event_type"], HOUR, {"n": ("count", "value"), "mean": ("avg", "value")}, forward=True)
    return rounded(J.with_defaults(requests(e).select("req_id"), agg, "req_id", {"n": 0.0, "mean": 0.0}).withColumn("n", F.col("n").cast("long")))


@query("j3_expanding_window", f"WITH {REQ} SELECT req_id, count(f.event_id) AS n, round(coalesce(sum(value), 0), 6) AS total FROM req LEFT JOIN f ON req.user_id = f.user_id AND req.event_type = f.event_type AND f.ts < req_ts GROUP BY req_id")
def j3(spark, d):
    e = read(spark, d, "events")
    out = J.expanding(requests(e), facts(e), ["user_id", "event_type"], {"n": F.col("_fact"), "total": F.col("value")}, values=["value"])
    return rounded(out.select("req_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("total", F.lit(0.0)).alias("total")))


@query(
    "j4_prefix_in_group",
    "WITH r AS (SELECT l_suppkey, m, l_suppkey * 100 + m AS req_id, epoch_us(TIMESTAMP '1996-01-01' + to_days(cast(365 * m AS INTEGER))) AS t FROM (SELECT DISTINCT l_suppkey FROM lineitem), range(1, 4) x(m)) SELECT req_id, count(l_quantity) AS n, round(coalesce(avg(l_extendedprice), 0), 3) AS mean FROM r LEFT JOIN lineitem l ON l.l_suppkey = r.l_suppkey AND epoch_us(l_shipdate) < t GROUP BY req_id",
)
def j4(spark, d):
    l = read(spark, d, "lineitem").select("l_suppkey", epoch_us(F.col("l_shipdate")).alias("ts"), "l_extendedprice")
    r = l.select("l_suppkey").distinct().withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(3)))).select("l_suppkey", (F.col("l_suppkey") * 100 + F.col("m")).alias("req_id"), (F.lit(820454400000000) + F.col("m") * 365 * DAY).alias("req_ts"))
    price = F.col("l_extendedprice")
    out = J.expanding(r, l, ["l_suppkey"], {"n": F.col("_fact"), "total": price, "priced": F.when(price.isNotNull(), 1)}, values=["l_extendedprice"])
    return rounded(out.select("req_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(F.col("total") / F.col("priced"), F.lit(0.0)).alias("mean")), 3)


@query("j5_group_lookup", f"WITH {REQ}, a AS (SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM f GROUP BY 1, 2) SELECT req_id, n, mean FROM req JOIN a USING (user_id, event_type)")
def j5(spark, d):
    e = read(spark, d, "events")
    return rounded(requests(e).join(A.exact(e, ["user_id", "event_type"], ["value"], ["count", "avg"]), ["user_id", "event_type"]).select("req_id", F.col("count_value").cast("long").alias("n"), F.col("avg_value").alias("mean")))


@query("j6_unkeyed_window", f"WITH r AS (SELECT o_orderkey AS req_id, epoch_us(o_orderdate) AS t FROM orders WHERE o_orderkey % 100 = 0), o AS (SELECT epoch_us(o_orderdate) AS ts, o_totalprice FROM orders) SELECT req_id, count(o_totalprice) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS s FROM r LEFT JOIN o ON ts >= t - {7 * DAY} AND ts < t GROUP BY req_id")
def j6(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", epoch_us(F.col("o_orderdate")).alias("ts"), "o_totalprice")
    r = o.filter("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("req_id"), F.col("ts").alias("req_ts"))
    return rounded(J.with_defaults(r.select("req_id"), J.unkeyed_window(r, o, 7 * DAY, DAY, "o_totalprice"), "req_id", {"n": 0, "s": 0.0}), 2)


@query("j7_store_lookup", "SELECT o_orderkey AS req_id, coalesce(c_nationkey, 0) AS c_nationkey, coalesce(c_acctbal, 0) AS c_acctbal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) c ON o_custkey = c_custkey")
def j7(spark, d):
    r = read(spark, d, "orders").select(F.col("o_orderkey").alias("req_id"), F.col("o_custkey").alias("c_custkey"))
    store = read(spark, d, "customer").filter("c_custkey % 3 > 0")
    return J.lookup(r, store, ["c_custkey"], ["c_nationkey", "c_acctbal"], "c_name").select("req_id", "c_nationkey", "c_acctbal")


@query(
    "j8_hour_offsets",
    "WITH s AS (SELECT event_type, date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT event_id AS req_id, event_type, date_trunc('hour', ts) AS h FROM events WHERE event_id % 100 = 0) SELECT req_id, " + ", ".join(f"round(coalesce(max(CASE WHEN k = {k} THEN v END), 0), 6) AS lag_{k}" for k in range(1, 7)) + " FROM r CROSS JOIN range(1, 7) x(k) LEFT JOIN s ON s.event_type = r.event_type AND s.h = r.h - to_hours(cast(k AS INTEGER)) GROUP BY req_id",
)
def j8(spark, d):
    e = read(spark, d, "events")
    store = hourly_store(e, ["event_type"], "ts", ["value"], ["avg"])
    r = e.filter("event_id % 100 = 0").select(F.col("event_id").alias("req_id"), "event_type", F.date_trunc("hour", "ts").alias("hour"))
    return rounded(J.hour_offsets(r, store, ["event_type"], "hour", "avg_value", 6))


@query("j9_label_join", f"WITH {REQ} SELECT req_id, quality AS label FROM req LEFT JOIN labels ON req_id = doc_id")
def j9(spark, d):
    return requests(read(spark, d, "events")).join(read(spark, d, "labels").withColumnRenamed("doc_id", "req_id"), "req_id", "left").select("req_id", F.col("quality").alias("label"))


@query("j10_next_hour_label", "WITH s AS (SELECT event_type, date_trunc('hour', ts) AS hour_ts, avg(value) AS v FROM events GROUP BY 1, 2) SELECT a.event_type, a.hour_ts, round(b.v, 6) AS label FROM s a LEFT JOIN s b ON a.event_type = b.event_type AND b.hour_ts = a.hour_ts + INTERVAL 1 HOUR")
def j10(spark, d):
    s = hourly_store(read(spark, d, "events"), ["event_type"], "ts", ["value"], ["avg"])
    nxt = s.select("event_type", (F.col("hour_ts") - F.expr("INTERVAL 1 HOUR")).alias("hour_ts"), F.col("avg_value").alias("label"))
    return rounded(s.select("event_type", "hour_ts").join(nxt, ["event_type", "hour_ts"], "left"))


@query("j11_j12_semi_and_two_key_merge", f"WITH {REQ}, a AS (SELECT user_id, event_type, max(value) AS top FROM f WHERE user_id IN (SELECT user_id FROM req) GROUP BY 1, 2) SELECT req_id, top FROM req LEFT JOIN a USING (user_id, event_type)")
def j11(spark, d):
    e = read(spark, d, "events")
    features = e.join(requests(e).select("user_id").distinct(), "user_id", "left_semi").groupBy("user_id", "event_type").agg(F.max("value").alias("top"))
    return requests(e).join(features, ["user_id", "event_type"], "left").select("req_id", "top")


@query(
    "j13_donor_delay",
    f"""WITH r AS (SELECT event_id, epoch_us(ts) // 1000000 AS t, epoch_us(ts) // 1000000 + event_id % 7 - 2 AS lt FROM events), d AS (SELECT t // 60 AS m, min_by(lt - t, {h32('event_id')} * 1000000 + event_id) AS delay FROM r WHERE lt >= t GROUP BY 1)
    SELECT event_id, cast(CASE WHEN lt < t THEN t + coalesce(delay, 0) ELSE lt END AS BIGINT) AS lt FROM r LEFT JOIN d ON t // 60 = m""",
)
def j13(spark, d):
    r = read(spark, d, "events").select("event_id", epoch_s(F.col("ts")).alias("t")).withColumn("lt", F.col("t") + F.col("event_id") % 7 - 2)
    return J.donor_delay(r, "event_id", "t", "lt", F.struct(hash32(F.col("event_id")), F.col("event_id"))).select("event_id", "lt")


@query("fn_category_codes", "SELECT event_id, coalesce(code, 0) AS code FROM events LEFT JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) AS code FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error')) USING (event_type)")
def codes(spark, d):
    e = read(spark, d, "events").select("event_id", "event_type")
    known = J.category_codes(e.filter("event_type <> 'error'"), "event_type")
    return e.join(known, "event_type", "left").select("event_id", F.coalesce("code", F.lit(0)).cast("long").alias("code"))


EXACT = {"count": "cast(count(x) AS DOUBLE)", "sum": "sum(x)", "avg": "avg(x)", "varSamp": "var_samp(x)", "stdSamp": "stddev_samp(x)", "varPop": "var_pop(x)", "stdPop": "stddev_pop(x)", "min": "min(x)", "max": "max(x)", "percentile90": "quantile_cont(x, 0.9)", "percentile99": "quantile_cont(x, 0.99)", "median": "median(x)", "unique": "cast(count(DISTINCT x) AS DOUBLE)"}


def _exact(name, sql):
    @query(f"a_{name}", f"SELECT l_suppkey, round({sql.replace('x)', 'l_quantity)').replace('x,', 'l_quantity,')}, 6) AS {name}_l_quantity FROM lineitem GROUP BY 1")
    def run(spark, d):
        return rounded(A.exact(read(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity"], [name]))


for _n, _s in EXACT.items():
    _exact(_n, _s)


@query("a14_conditional_rate", "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS hits, round(count(*) FILTER (WHERE event_type = 'purchase') / count(*), 6) AS rate FROM events GROUP BY 1")
def a14(spark, d):
    return rounded(A.rates(read(spark, d, "events"), ["user_id"], F.col("event_type") == "purchase"), 6)


@query("a15_profiling", "SELECT event_type, min(value) FILTER (WHERE value > 5) AS lo, max(value) FILTER (WHERE user_id % 2 = 0) AS hi, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events GROUP BY 1")
def a15(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.min(F.when(F.col("value") > 5, F.col("value"))).alias("lo"), F.max(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("hi"), F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("props"))


@query("a16_moments", "WITH m AS (SELECT l_suppkey, l_quantity AS x, avg(l_quantity) OVER (PARTITION BY l_suppkey) AS mu FROM lineitem) SELECT l_suppkey, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(avg((x - mu) ** 3) / stddev_pop(x) ** 3, 6) AS skew, round(avg((x - mu) ** 4) / stddev_pop(x) ** 4 - 3, 6) AS kurt FROM m GROUP BY 1")
def a16(spark, d):
    return rounded(A.moments(read(spark, d, "lineitem"), ["l_suppkey"], "l_quantity"))


@query("a17_value_frequencies", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def a17(spark, d):
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a18_feature_matrix", "SELECT user_id, week, count(DISTINCT event_type) AS nunique_event_type, count(DISTINCT props) AS nunique_props, round(coalesce(avg(value), -1), 6) AS mean_value, round(coalesce(stddev_samp(value), -1), 6) AS std_value FROM (SELECT *, cast(floor(day(ts) / 7) AS BIGINT) AS week FROM events) GROUP BY 1, 2")
def a18(spark, d):
    e = read(spark, d, "events").withColumn("week", F.floor(F.day("ts") / 7))
    return rounded(A.matrix(e, ["user_id", "week"], ["event_type", "props"], ["value"]))


@query(
    "a19_prefix_aggregates",
    f"""WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS t, value FROM events), s AS (SELECT user_id, hi, cast(floor(lo + {u32("'cut|' || user_id")} * (hi - lo)) AS BIGINT) AS cut FROM (SELECT user_id, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1))
    SELECT user_id, cut, cast(hi - cut AS BIGINT) AS "left", round(avg(value) FILTER (WHERE t < cut), 6) AS mean_value, round(stddev_pop(value) FILTER (WHERE t < cut), 6) AS std_value FROM e JOIN s USING (user_id) GROUP BY 1, 2, 3""",
)
def a19(spark, d):
    e = read(spark, d, "events").select("user_id", epoch_s(F.col("ts")).alias("t"), "value")
    return rounded(A.prefix_aggregates(e, "user_id", "t", ["value"], uniform("cut", F.col("user_id"))))
