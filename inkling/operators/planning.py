"""Static sampling plans: which level each query is read at, so that no other plan is both cheaper and surer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkling.sources.storage import materialize


def level_profile(facts: DataFrame, key: str, weights: dict[str, float], levels: list[int]) -> DataFrame:
    """(qname, level, cost, var) of reading ``pid < level`` for the average of each column: rows read, and the mean square over keys
    of what the prediction loses by it (``weights`` times the error). One aggregation by key and pid and a running sum; keys without a row count as 0."""
    last = max(levels)
    part = facts.filter(F.col("pid") < last).groupBy(key, "pid").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in weights])
    upto = [F.struct(F.lit(k).alias("level"), *[F.sum(F.when(F.col("pid") < k, F.col(c))).alias(c) for c in ["n", *weights]]) for k in levels]
    by = part.groupBy(key).agg(F.array(*upto).alias("_l"))
    names = list(weights)
    whole = F.element_at("_l", F.lit(len(levels)))
    rows = by.select(key, whole.alias("_w"), F.explode("_l").alias("_x"))
    error = lambda c: weights[c] * (F.coalesce(F.col(f"_x.{c}") / F.col("_x.n"), F.lit(0.0)) - F.col(f"_w.{c}") / F.col("_w.n"))
    each = F.array(*[F.struct(F.lit(c).alias("qname"), error(c).alias("e")) for c in names])
    told = rows.select(F.col("_x.level").alias("level"), F.coalesce("_x.n", F.lit(0)).alias("n"), F.explode(each).alias("_e")).select("level", "n", "_e.*")
    return told.groupBy("qname", "level").agg(F.sum("n").alias("cost"), F.avg(F.col("e") * F.col("e")).alias("var"))


def undominated(plans: DataFrame) -> DataFrame:
    """Plans (cost, var, ...) that no other one beats in one and equals or beats in the other; of equal ones one (the first plan) stays.

    Costs are put in ranges of their own: the least variance before a range is carried into it, so no task sees all plans.
    """
    parts = int(plans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(materialize(plans).repartitionByRange(parts, "cost", "var").withColumn("_part", F.spark_partition_id()))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = rows.groupBy("_part").agg(F.min("var").alias("_m")).select("_part", F.min("_m").over(ahead).alias("_m"))
    before = Window.partitionBy("_part").orderBy("cost", "var", "plan").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("_b", F.min("var").over(before)).join(F.broadcast(carried), "_part")
    least = F.least("_b", "_m")
    return met.filter(least.isNull() | (F.col("var") < least)).select(*plans.columns)


def frontier(profile: DataFrame, queries: list[str], grid: float | None = None) -> DataFrame:
    """(cost, var, plan): the Pareto frontier over all combinations of levels, ``plan`` having the level of each query in the order given.

    Errors of different queries are independent, so variances add up as costs do, and a dominated start never leads to an undominated
    plan: one query is added at a time and what is dominated goes. ``grid`` rounds costs up to its multiples, which bounds the frontier
    by the greatest cost over it; without it the result is exact.
    """
    spark = profile.sparkSession
    profile = materialize(profile)
    plans = spark.createDataFrame([(0.0, 0.0, [])], "cost double, var double, plan array<int>")
    rounded = lambda c: F.ceil(c / grid) * grid if grid else c
    for q in queries:
        levels = profile.filter(F.col("qname") == q).agg(F.collect_list(F.struct("level", "cost", "var")).alias("_l"))  # one row: the levels of a query
        both = plans.join(F.broadcast(levels)).withColumn("_x", F.explode("_l"))
        more = both.select(rounded(F.col("cost") + F.col("_x.cost")).cast("double").alias("cost"), (F.col("var") + F.col("_x.var")).alias("var"), F.concat("plan", F.array(F.col("_x.level").cast("int"))).alias("plan"))
        plans = materialize(undominated(more))
    return plans


def cheapest(plans: DataFrame, max_var: Column | float) -> DataFrame:
    """The cheapest plan whose variance is within ``max_var``: one row, or none."""
    return plans.filter(F.col("var") <= max_var).orderBy("cost", "var").limit(1)
