"""Joins of requests with facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkling.functions.estimators import UNKNOWN_ERROR

from .ranges import sums_below


def interval_join(requests: DataFrame, facts: DataFrame, keys: list[str], width: int, *, req_ts: str = "req_ts", ts: str = "ts", forward: bool = False) -> DataFrame:
    """Facts of the same keys in [t - width, t), or [t, t + width) if ``forward``; one row a match (``with_defaults`` brings back requests without any).

    Times are integers. Facts carry the bucket of their time and requests the two buckets that their window meets, so
    the join is an equi-join on keys and bucket whose rows follow the matches; adaptive execution may split hot buckets.
    """
    lo = F.col(req_ts) if forward else F.col(req_ts) - width
    first = F.floor(lo / width).cast("long")
    left = requests.withColumn("_b", F.explode(F.array(first, first + 1)))
    right = facts.withColumn("_b", F.floor(F.col(ts) / width).cast("long"))
    inside = (F.col(ts) >= lo) & (F.col(ts) < lo + width)
    hits = left.join(right, [*keys, "_b"]).filter(inside).drop("_b")
    return hits


def with_defaults(requests: DataFrame, aggregated: DataFrame, req_id: str, values: dict[str, float]) -> DataFrame:
    """Every request with its aggregates; requests without any get the default."""
    return requests.join(aggregated, req_id, "left").fillna(values)


def default_estimates(requests: DataFrame, estimated: DataFrame, req_id: str, p: float) -> DataFrame:
    """Every request with fval and fest; without rows the value is 0, known exactly only if the whole table was read."""
    unknown = 0.0 if p >= 1 - 1e-9 else UNKNOWN_ERROR
    return requests.join(estimated, req_id, "left").fillna({"fval": 0.0, "fest": unknown})


def expanding(requests: DataFrame, facts: DataFrame, keys: list[str], sums: dict[str, Column], *, req_id: str = "req_id", req_ts: str = "req_ts", ts: str = "ts", values: list[str] = ()) -> DataFrame:
    """Sums over all earlier facts of the keys: ranges of (key, time) of both, with what earlier ranges add up to carried in.

    ``sums`` may use ``_fact`` (1 for facts) and the value columns; requests do not count themselves, nor do facts without a time.
    """
    left = requests.select(*keys, req_id, F.col(req_ts).alias("_t"), *[F.lit(None).cast(facts.schema[v].dataType).alias(v) for v in values], F.lit(0).alias("_fact"))
    right = facts.select(*keys, F.lit(None).cast(requests.schema[req_id].dataType).alias(req_id), F.col(ts).alias("_t"), *values, F.lit(1).alias("_fact"))
    return sums_below(left.unionByName(right.filter("_t IS NOT NULL")), keys, "_t", sums).filter("_fact = 0").select(req_id, *sums)


def unkeyed_window(requests: DataFrame, facts: DataFrame, width: int, bucket: int, value: str, *, req_id: str = "req_id", req_ts: str = "req_ts", ts: str = "ts") -> DataFrame:
    """count and sum of all facts in [t - width, t), for requests that have any.

    Whole buckets of time are added up once, from the first to before the last; running sums inside the last bucket are added and
    those inside the first taken off, so no request meets the single facts of a bucket.
    """
    place = lambda t: F.floor(t / bucket).cast("long")
    facts = facts.select(F.col(ts).alias("ts"), F.col(value).cast("double").alias("_v"), place(F.col(ts)).alias("_b"))
    totals = facts.groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("s"))
    lo, hi = F.col(req_ts) - width, F.col(req_ts)
    whole = requests.filter(place(hi) > place(lo)).select(req_id, F.explode(F.sequence(place(lo), place(hi) - 1)).alias("_b")).join(totals, "_b").select(req_id, "n", "s")
    ends = requests.select(F.explode(F.array(*[F.struct(F.struct(F.col(req_id).alias("id"), F.lit(sign).alias("sign")).alias("req_id"), t.alias("req_ts"), place(t).alias("_b")) for sign, t in ((1, hi), (-1, lo))])).alias("e")).select("e.*")
    below = expanding(ends, facts, ["_b"], {"n": F.col("_fact"), "s": F.col("_v")}, values=["_v"])
    sign = F.col("req_id.sign")
    parts = whole.unionByName(below.select(F.col("req_id.id").alias(req_id), (sign * F.col("n")).cast("long").alias("n"), (sign * F.col("s")).alias("s")))
    return parts.groupBy(req_id).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s")).filter("n > 0")


def lookup(requests: DataFrame, store: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """The first stored row of each key; requests without one get zeros."""
    first = store.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("_v")).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])
    return requests.join(first, keys, "left").fillna(0, values)


def hour_offsets(requests: DataFrame, store: DataFrame, keys: list[str], hour: str, value: str, lags: int) -> DataFrame:
    """Value of the hour k before, k = 1..lags: calendar hours, not rows; one join for all lags."""
    lagged = requests.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("hour_ts", F.col(hour) - F.make_interval(hours=F.col("_k")))
    found = lagged.join(store.select(*keys, "hour_ts", value), [*keys, "hour_ts"], "left")
    return found.groupBy("req_id").agg(*[F.max(F.when(F.col("_k") == k, F.col(value))).alias(f"lag_{k}") for k in range(1, lags + 1)]).fillna(0.0)


def donor_delay(rows: DataFrame, row_id: str, ts: str, label_ts: str, order: Column) -> DataFrame:
    """Where the label precedes the row, the row's time plus the delay of a donor from the same minute, chosen by hash."""
    minute = F.floor(F.col(ts) / 60).cast("long")
    donors = rows.filter(F.col(label_ts) >= F.col(ts)).groupBy(minute.alias("_m")).agg(F.min_by(F.col(label_ts) - F.col(ts), order).alias("_delay"))
    fixed = F.when(F.col(label_ts) < F.col(ts), F.col(ts) + F.coalesce("_delay", F.lit(0))).otherwise(F.col(label_ts))
    return rows.withColumn("_m", minute).join(donors, "_m", "left").withColumn(label_ts, fixed).drop("_m", "_delay")


def category_codes(values: DataFrame, column: str) -> DataFrame:
    """1-based dense codes of the sorted distinct values (a dictionary, small by nature)."""
    return values.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("code", F.row_number().over(Window.orderBy(column)))
