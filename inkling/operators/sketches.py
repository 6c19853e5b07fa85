"""Quantiles and distinct counts of hot keys by sketches that merge: made by hour, rolled up to any window of hours.

A quantile sketch (KLL) of parameter ``K`` is off by ``RANK_ERROR`` of the rows in rank at most (99 % of the time, merged or not); up to K
values it is exact. A distinct sketch (HyperLogLog) of 2**LG_K buckets has a relative deviation of 1.04 / sqrt(2**LG_K). A sketch takes a
few kilobytes whatever its rows, so no key's values are ever gathered. Exact forms: ``ranges.grouped_quantiles``, ``windows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, RANK_ERROR = 400, 0.01

LG_K = 12


def aggregates(value: str, distinct: str | None = None) -> list[Column]:
    """n, q (quantile sketch) and, where asked, d (distinct sketch) of a group; null values take no part."""
    out = [F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("q")]
    return out + ([F.hll_sketch_agg(F.col(distinct), LG_K).alias("d")] if distinct else [])


def hourly_sketches(events: DataFrame, key: str, ts: str, value: str, distinct: str | None = None) -> DataFrame:
    """(key, hour_ts, n, q, d): one row for each key and hour; map tasks merge their own rows first, so a hot hour is no hot task."""
    known = events.filter(F.col(value).isNotNull())
    return known.groupBy(key, F.date_trunc("hour", ts).alias("hour_ts")).agg(*aggregates(value, distinct))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of a group put together: (by, n, q, d)."""
    more = [F.hll_union_agg("d").alias("d")] if "d" in sketches.columns else []
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("q").alias("q"), *more)


def over_windows(requests: DataFrame, sketches: DataFrame, key: str, hour: str, hours: int) -> DataFrame:
    """(req_id, n, q, d): what the ``hours`` whole hours before each request's own hold; requests without any are not there."""
    asked = requests.select("req_id", key, F.explode(F.sequence(F.lit(1), F.lit(hours))).alias("_k"), F.col(hour).alias("_h"))
    asked = asked.select("req_id", key, (F.col("_h") - F.make_dt_interval(hours=F.col("_k"))).alias("hour_ts"))
    return merged(asked.join(sketches, [key, "hour_ts"]), ["req_id"])


def quantile(share: float, sketch: str = "q") -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(float(share)))


def distinct(sketch: str = "d") -> Column:
    return F.hll_sketch_estimate(F.col(sketch))
