"""The inference pipelines as lists of feature specifications over the test tables, with their median variants."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from inkling.functions.scalar import epoch_us, is_weekend, monday_weekday
from inkling.operators import matching as J
from inkling.operators import windows as W
from inkling.operators.spec import FeatureSpec, assemble
from inkling.sources.ingest import read

from .base import DAY, HOUR, REQ, facts, query, requests

#: Added before rounding: averages of few decimals often end on a five, where engines differ by their last bit.
NUDGE = 1e-8

TYPES = ["click", "login", "purchase", "scroll", "signup", "view"]


def code(column, values):
    """1-based code of a value in a fixed list, 0 for others."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), column), F.lit(0)).cast("long")


def code_sql(column: str, values) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{v}' THEN {k}" for k, v in enumerate(values, 1)) + " ELSE 0 END"


SQL_OPS = {"count": "count({c})", "sum": "sum({c})", "avg": "avg({c})", "stdPop": "stddev_pop({c})", "stdSamp": "stddev_samp({c})", "min": "min({c})", "max": "max({c})", "median": "median({c})", "unique": "count(DISTINCT {c})"}


def sql_features(features: dict, prefix: str = "") -> str:
    return ", ".join(f"coalesce(cast({SQL_OPS[op].format(c=prefix + c)} AS DOUBLE), 0) AS {n}" for n, (op, c) in features.items())


def sql_trailing(name: str, keys: list[str], width: int | None, features: dict) -> str:
    """A CTE with the features of a window of each request; without a width, of the whole past."""
    same = " AND ".join([f"f.{k} = req.{k}" for k in keys] + ["f.ts < req_ts"] + ([f"f.ts >= req_ts - {width}"] if width else []))
    return f"{name} AS (SELECT req_id, {sql_features(features, 'f.')} FROM req LEFT JOIN f ON {same} GROUP BY req_id)"


def sql_rounded(names, digits: int = 5) -> str:
    return ", ".join(f"round({n} + {NUDGE}, {digits}) AS {n}" for n in names)


def rounded(df, digits: int = 5):
    return df.select(*[F.round(F.col(c) + NUDGE, digits).alias(c) if t in ("double", "float") else c for c, t in df.dtypes])


def event_requests(spark, d):
    return requests(read(spark, d, "events")).join(read(spark, d, "events").select(F.col("event_id").alias("req_id"), "ts", "value"), "req_id")


def request_features():
    return FeatureSpec("request", {"code": (lambda c: code(c, TYPES), "event_type"), "weekend": (is_weekend, "ts"), "value": (lambda c: c, "value")})


REQUEST_SQL = f"q AS (SELECT event_id AS req_id, {code_sql('event_type', TYPES)} AS code, CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS weekend, value FROM events WHERE event_id % 100 = 0)"

# --- taxi trips: windows by pick-up key -------------------------------------------------------------------------
FARE_1H, FARE_30M = {"n_1h": ("count", "value"), "avg_1h": ("avg", "value")}, {"n_30m": ("count", "value")}
TRIPS = {HOUR: {"avg_1h": ("avg", "value"), "std_1h": ("stdPop", "value"), "users_1h": ("unique", "user_id")}, DAY: {"avg_24h": ("avg", "value"), "max_24h": ("max", "value"), "median_24h": ("median", "value")}, 7 * DAY: {"max_7d": ("max", "value")}}


def median_of(features: dict) -> dict:
    return {n: ("median" if op == "avg" else op, c) for n, (op, c) in features.items()}


def fare_sql(swap=lambda f: f):
    a, b = swap(FARE_1H), swap(FARE_30M)
    return f"WITH {REQ}, {REQUEST_SQL}, {sql_trailing('a', ['event_type'], HOUR, a)}, {sql_trailing('b', ['event_type'], HOUR // 2, b)} SELECT req_id, code, weekend, {sql_rounded(['value', *a, *b])} FROM q JOIN a USING (req_id) JOIN b USING (req_id)"


def fare_specs(spark, d):
    f = facts(read(spark, d, "events"))
    return [request_features(), FeatureSpec("trailing", FARE_1H, f, ["event_type"], HOUR), FeatureSpec("trailing", FARE_30M, f, ["event_type"], HOUR // 2)]


@query("pl_trip_fare", fare_sql())
def trip_fare(spark, d):
    return rounded(assemble(event_requests(spark, d), fare_specs(spark, d)), 5)


@query("pl_trip_fare_median", fare_sql(median_of))
def trip_fare_median(spark, d):
    return rounded(assemble(event_requests(spark, d), [s.swapped("avg", "median") for s in fare_specs(spark, d)]), 5)


TRIPS_NAMES = [n for f in TRIPS.values() for n in f]


@query("pl_trips_windows", f"WITH {REQ}, " + ", ".join(sql_trailing(f"w{k}", ["event_type"], width, f) for k, (width, f) in enumerate(TRIPS.items())) + f" SELECT req_id, {sql_rounded(TRIPS_NAMES)} FROM w0 JOIN w1 USING (req_id) JOIN w2 USING (req_id)")
def trips(spark, d):
    f = facts(read(spark, d, "events"))
    return rounded(assemble(event_requests(spark, d), [FeatureSpec("trailing", x, f, ["event_type"], width) for width, x in TRIPS.items()]), 5)


# --- ticks: hourly lags and the hour so far ----------------------------------------------------------------------
def tick_sql(op: str) -> str:
    agg = SQL_OPS[op].format(c="value")
    lags = ", ".join(f"round(coalesce(max(CASE WHEN k = {k} THEN v END), 0) + {NUDGE}, 5) AS lag_{k}" for k in range(1, 7))
    return f"""WITH r AS (SELECT event_id AS req_id, event_type, ts, date_trunc('hour', ts) AS h FROM events WHERE event_id % 100 = 0), s AS (SELECT event_type, date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1, 2),
    l AS (SELECT req_id, {lags} FROM (SELECT r.*, k, r.h - to_hours(k) AS was FROM r, range(1, 7) x(k)) y LEFT JOIN s ON s.event_type = y.event_type AND s.h = y.was GROUP BY 1),
    c AS (SELECT req_id, round(coalesce({agg}, 0) + {NUDGE}, 5) AS now FROM r LEFT JOIN events e ON e.event_type = r.event_type AND e.ts >= r.h AND e.ts < r.ts GROUP BY 1) SELECT * FROM l JOIN c USING (req_id)"""


def tick(spark, d, op: str):
    e = read(spark, d, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    r = event_requests(spark, d).withColumn("hour_ts", hour)
    store = e.groupBy("event_type", hour.alias("hour_ts")).agg(F.avg("value").alias("v"))
    lags = J.hour_offsets(r.select("req_id", "event_type", "hour_ts"), store, ["event_type"], "hour_ts", "v", 6)
    so_far = r.select("req_id", "event_type", (F.floor(F.col("req_ts") / HOUR) * HOUR).alias("_lo"), F.col("req_ts").alias("_hi"))
    current = W.between(so_far, facts(e), ["event_type"], HOUR, {"now": (op, "value")})
    return rounded(lags.join(current, "req_id", "left").fillna(0.0, ["now"]), 5)


@query("pl_tick_price", tick_sql("avg"))
def tick_price(spark, d):
    return tick(spark, d, "avg")


@query("pl_tick_price_median", tick_sql("median"))
def tick_price_median(spark, d):
    return tick(spark, d, "median")


# --- click fraud: counts over the past ----------------------------------------------------------------------------
FRAUD = [("trailing", ["user_id"], DAY, {"n_user_1d": ("count", "event_id")}), ("expanding", ["user_id"], None, {"n_user": ("count", "event_id")}), ("expanding", ["user_id", "event_type"], None, {"n_user_type": ("count", "event_id")})]


@query("pl_fraud_detection", f"WITH {REQ}, {REQUEST_SQL}, " + ", ".join(sql_trailing(f"w{k}", keys, width, f) for k, (_, keys, width, f) in enumerate(FRAUD)) + " SELECT req_id, code, weekend, value, n_user_1d, n_user, n_user_type FROM q JOIN w0 USING (req_id) JOIN w1 USING (req_id) JOIN w2 USING (req_id)")
def fraud(spark, d):
    f = facts(read(spark, d, "events"))
    return assemble(event_requests(spark, d), [request_features(), *[FeatureSpec(kind, x, f, keys, width or 0) for kind, keys, width, x in FRAUD]])


@query("pl_fraud_calendar", f"WITH {REQ}, q AS (SELECT event_id AS req_id, (dayofweek(ts) + 6) % 7 AS weekday, cast(dayofyear(ts) AS INTEGER) AS day_of_year FROM events WHERE event_id % 100 = 0), {sql_trailing('w', ['user_id'], None, {'n_user': ('count', 'event_id')})} SELECT req_id, weekday, day_of_year, n_user FROM q JOIN w USING (req_id)")
def fraud_calendar(spark, d):
    own = FeatureSpec("request", {"weekday": (lambda c: monday_weekday(c).cast("long"), "ts"), "day_of_year": (F.dayofyear, "ts")})
    return assemble(event_requests(spark, d), [own, FeatureSpec("expanding", {"n_user": ("count", "event_id")}, facts(read(spark, d, "events")), ["user_id"])])


# --- card fraud: codes, lookups and long windows ------------------------------------------------------------------
CARD = {n: {f"sum_{n}d": ("sum", "price"), f"avg_{n}d": ("avg", "price"), f"n_{n}d": ("count", "price")} for n in (30, 360)}
CARD_SQL = "req AS (SELECT o_orderkey AS req_id, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS req_ts FROM orders WHERE o_orderkey % 100 = 0), f AS (SELECT o_custkey, o_totalprice AS price, epoch_us(o_orderdate) AS ts FROM orders)"


def card_parts(spark, d):
    """Requests, the request's own features, the lookup and the facts."""
    o = read(spark, d, "orders")
    r = o.filter("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("req_id"), "o_custkey", "o_orderstatus", "o_totalprice", epoch_us(F.col("o_orderdate")).alias("req_ts"))
    f = o.select("o_custkey", F.col("o_totalprice").alias("price"), epoch_us(F.col("o_orderdate")).alias("ts"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    own = FeatureSpec("request", {"status": (lambda x: code(x, "FOP"), "o_orderstatus"), "amount": (lambda x: x, "o_totalprice")})
    return r, own, FeatureSpec("lookup", {"balance": ("first", "c_acctbal"), "nation": ("first", "c_nationkey")}, c, ["o_custkey"]), f


@query("pl_card_fraud", f"WITH {CARD_SQL}, {sql_trailing('a', ['o_custkey'], 30 * DAY, CARD[30])}, {sql_trailing('b', ['o_custkey'], 360 * DAY, CARD[360])} SELECT req_id, {code_sql('o_orderstatus', 'FOP')} AS status, round(o_totalprice + {NUDGE}, 3) AS amount, round(coalesce(c_acctbal, 0) + {NUDGE}, 3) AS balance, coalesce(cast(c_nationkey AS DOUBLE), 0) AS nation, {sql_rounded([*CARD[30], *CARD[360]], 3)} FROM req LEFT JOIN customer ON c_custkey = o_custkey JOIN a USING (req_id) JOIN b USING (req_id)")
def card_fraud(spark, d):
    r, own, lookup, f = card_parts(spark, d)
    windows = [FeatureSpec("trailing", x, f, ["o_custkey"], n * DAY) for n, x in CARD.items()]
    return rounded(assemble(r, [own, lookup, *windows]), 3)


# --- machines: aggregates of a block ------------------------------------------------------------------------------
SENSORS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def block_sql(keys: list[str], features: dict, digits: int = 5) -> str:
    ids = ", ".join(keys)
    return f"SELECT {ids}, {', '.join(f'round({SQL_OPS[op].format(c=c)} + {NUDGE}, {digits}) AS {n}' for n, (op, c) in features.items())} FROM lineitem GROUP BY {ids}"


def blocks(spark, d, keys: list[str], features: dict):
    """Features of every block: the distinct keys are the requests."""
    l = read(spark, d, "lineitem")
    r = l.select(*keys).distinct().withColumn("req_id", F.struct(*keys))
    return rounded(assemble(r, [FeatureSpec("group", features, l, keys)]).select(*[F.col(f"req_id.{k}").alias(k) for k in keys], *features), 5)


def register_blocks(name: str, keys: list[str], features: dict) -> None:
    query(name, block_sql(keys, features))(lambda spark, d: blocks(spark, d, keys, features))


BEARING = {f"avg_{c}": ("avg", c) for c in SENSORS}
TURBOFAN_ALL = {f"{op}_{c}": (op, c) for c in SENSORS for op in ("avg", "stdPop", "median", "min", "max")}
register_blocks("pl_bearing_imbalance", ["l_suppkey"], BEARING)
register_blocks("pl_bearing_imbalance_median", ["l_suppkey"], median_of(BEARING))
register_blocks("pl_turbofan", ["l_suppkey", "l_returnflag", "l_linestatus"], BEARING)
register_blocks("pl_turbofan_median", ["l_suppkey", "l_returnflag", "l_linestatus"], median_of(BEARING))
register_blocks("pl_turbofan_all", ["l_suppkey", "l_returnflag", "l_linestatus"], TURBOFAN_ALL)

# --- battery: the part of a block before a time -------------------------------------------------------------------
BATTERY = {f"{op}_{c}": (op, c) for c in SENSORS for op in ("avg", "stdPop")}
BATTERY_FROM, BATTERY_TO = 820454400000000, 978307200000000  # 1996 to 2001: the cut of a part lies between, by its key


def battery_sql(swap=lambda f: f) -> str:
    f = swap(BATTERY)
    return f"WITH req AS (SELECT DISTINCT l_partkey AS req_id, l_partkey, {BATTERY_FROM} + (l_partkey % 7) * {(BATTERY_TO - BATTERY_FROM) // 7} AS req_ts FROM lineitem), f AS (SELECT l_partkey, epoch_us(l_shipdate) AS ts, {', '.join(SENSORS)} FROM lineitem), {sql_trailing('w', ['l_partkey'], None, f)} SELECT req_id, req_ts, {sql_rounded(f, 3)} FROM req JOIN w USING (req_id)"


def battery(spark, d, median: bool):
    l = read(spark, d, "lineitem").select("l_partkey", epoch_us(F.col("l_shipdate")).alias("ts"), *SENSORS)
    cut = F.lit(BATTERY_FROM) + (F.col("l_partkey") % 7) * ((BATTERY_TO - BATTERY_FROM) // 7)
    r = l.select("l_partkey").distinct().select(F.col("l_partkey").alias("req_id"), "l_partkey", cut.alias("req_ts"))
    spec = FeatureSpec("expanding", BATTERY, l, ["l_partkey"])
    spec = spec.swapped("avg", "median") if median else spec
    own = FeatureSpec("request", {"req_ts": (lambda c: c, "req_ts")})
    return rounded(assemble(r, [own, spec]), 3)


@query("pl_battery", battery_sql())
def battery_mean(spark, d):
    return battery(spark, d, False)


@query("pl_battery_median", battery_sql(median_of))
def battery_median(spark, d):
    return battery(spark, d, True)


# --- students: sessions and level groups --------------------------------------------------------------------------
STUDENT = {"avg_value": ("avg", "value"), "std_value": ("stdSamp", "value"), "avg_hour": ("avg", "hour"), "std_hour": ("stdSamp", "hour"), "types": ("unique", "event_type"), "days": ("unique", "day")}


def student_sql(swap=lambda f: f) -> str:
    return f"WITH e AS (SELECT user_id, (day(ts) - 1) // 7 AS week, value, hour(ts) AS hour, event_type, day(ts) AS day FROM events) SELECT user_id, week, {', '.join(f'round(coalesce(cast({SQL_OPS[op].format(c=c)} AS DOUBLE), -1) + {NUDGE}, 5) AS {n}' for n, (op, c) in swap(STUDENT).items())} FROM e GROUP BY 1, 2"


def student(spark, d, features):
    e = read(spark, d, "events").select("user_id", F.floor((F.day("ts") - 1) / 7).alias("week"), "value", F.hour("ts").alias("hour"), "event_type", F.day("ts").alias("day"))
    r = e.select("user_id", "week").distinct().withColumn("req_id", F.struct("user_id", "week"))
    return rounded(assemble(r, [FeatureSpec("group", features, e, ["user_id", "week"], default=-1.0)]).select("req_id.user_id", "req_id.week", *features), 5)


@query("pl_student_qa", student_sql())
def student_qa(spark, d):
    return student(spark, d, STUDENT)


@query("pl_student_qa_median", student_sql(median_of))
def student_qa_median(spark, d):
    return student(spark, d, median_of(STUDENT))


# --- features of one's own ----------------------------------------------------------------------------------------
@pandas_udf(DoubleType())
def value_range(x: pd.Series) -> float:
    """Any function of a group's values, as a grouped aggregate."""
    return float(x.max() - x.min()) if len(x) else 0.0


@query("fs_own_expressions_and_udaf", f"WITH {REQ}, a AS (SELECT req_id, count(f.event_id) FILTER (WHERE value > 50) AS high, max(value) - min(value) AS span FROM req LEFT JOIN f ON f.user_id = req.user_id AND f.event_type <> 'click' GROUP BY 1) SELECT req_id, cast(high AS DOUBLE) AS high, round(sqrt(coalesce(span, 0)) + {NUDGE}, 5) AS span FROM a")
def own_features(spark, d):
    f = facts(read(spark, d, "events"))
    spec = FeatureSpec("group", {"high": (lambda c: F.count_if(c > 50), "value"), "span": (value_range, "value")}, f, ["user_id"], condition="event_type <> 'click'", post={"span": F.sqrt})
    return rounded(assemble(event_requests(spark, d), [spec]), 5)
