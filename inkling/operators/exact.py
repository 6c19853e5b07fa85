"""Textbook aggregates and grouped matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXTBOOK = {
    "count": lambda x: F.count(x).cast("double"),
    "sum": F.sum,
    "avg": F.avg,
    "varSamp": F.var_samp,
    "stdSamp": F.stddev_samp,
    "varPop": F.var_pop,
    "stdPop": F.stddev_pop,
    "min": F.min,
    "max": F.max,
    "percentile90": lambda x: F.percentile(x, F.lit(0.9)),
    "percentile99": lambda x: F.percentile(x, F.lit(0.99)),
    "median": F.median,
    "unique": lambda x: F.count_distinct(x).cast("double"),
}
ALIASES = {"mean": "avg", "var": "varPop", "std": "stdPop"}


def aggregate(name: str, column) -> Column:
    """A textbook aggregate by name."""
    return TEXTBOOK[ALIASES.get(name, name)](column)


def exact(df: DataFrame, keys: list[str], values: list[str], ops: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[aggregate(o, F.col(v)).alias(f"{o}_{v}") for v in values for o in ops])


def rates(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    hits = F.count_if(condition)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), hits.alias("hits"), (hits / F.count(F.lit(1))).alias("rate"))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Size, mean, population deviation, biased skewness and excess kurtosis."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))


def matrix(df: DataFrame, keys: list[str], categorical: list[str], numeric: list[str], median: bool = False) -> DataFrame:
    """Distinct counts of categories, mean (or median) and deviation of numbers; nulls become -1."""
    middle = F.median if median else F.avg
    aggs = [F.count_distinct(c).alias(f"nunique_{c}") for c in categorical] + [f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("median" if median else "mean", middle), ("std", F.stddev_samp))]
    return df.groupBy(*keys).agg(*aggs).fillna(-1)


def prefix_aggregates(df: DataFrame, key: str, time: str, values: list[str], cut: Column) -> DataFrame:
    """Aggregates of the rows before a cut time chosen per key (by ``cut`` in [0, 1) of the key's span), and the time left."""
    span = df.groupBy(key).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi")).withColumn("cut", F.floor(F.col("_lo") + cut * (F.col("_hi") - F.col("_lo"))))
    before = F.col(time) < F.col("cut")
    aggs = [a for v in values for a in (F.avg(F.when(before, F.col(v))).alias(f"mean_{v}"), F.stddev_pop(F.when(before, F.col(v))).alias(f"std_{v}"))]
    return df.join(span, key).groupBy(key, "cut", (F.col("_hi") - F.col("cut")).alias("left")).agg(*aggs)
