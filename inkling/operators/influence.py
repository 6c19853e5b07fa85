"""Sensitivity of predictions to feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkling.operators import propagate as U


def sobol(preds: DataFrame, groups: int, total: bool = False) -> DataFrame:
    """(req_id, k, qinf): first-order (or total) index of each group from predictions (req_id, i, k, pred) of Saltelli's matrices.

    Groups of a prediction that does not vary get 1e-9.
    """
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("pred")))
    folded = preds.groupBy("req_id", "i").agg(at(0).alias("a"), at(groups + 1).alias("b"), *[at(k).alias(f"c{k}") for k in range(1, groups + 1)])
    a, b, n = F.col("a"), F.col("b"), 2 * F.count(F.lit(1))
    c = [F.col(f"c{k}") for k in range(1, groups + 1)]
    # The gain about the mean is that about zero less the mean's share: one row a request, without a second pass.
    sums = [F.avg(F.pow(a - x, F.lit(2)) * 0.5 if total else b * (x - a)).alias(f"g{k}") for k, x in enumerate(c, 1)] + [F.avg(x - a).alias(f"h{k}") for k, x in enumerate(c, 1)]
    told = folded.groupBy("req_id").agg((F.sum(a + b) / n).alias("mu"), *sums, F.collect_list(F.array(a, b)).alias("p"))
    told = told.withColumn("v", F.aggregate(F.flatten("p"), F.lit(0.0), lambda s, y: s + (y - F.col("mu")) * (y - F.col("mu"))) / F.size(F.flatten("p"))).drop("p")
    rows = told.select("req_id", "v", F.posexplode(F.array(*[F.col(f"g{k}") if total else F.col(f"g{k}") - F.col("mu") * F.col(f"h{k}") for k in range(1, groups + 1)])).alias("k", "g"))
    return rows.select("req_id", (F.col("k") + 1).alias("k"), F.when(F.col("v") < 1e-18, F.lit(1e-9)).otherwise(F.col("g") / F.col("v")).alias("qinf"))


def frozen(features: DataFrame, column: str) -> DataFrame:
    """Every feature table with one query's (or feature's) features made exact: rows (…, frozen)."""
    variants = features.select("req_id", F.col(column).alias("frozen")).distinct()
    both = features.join(variants, "req_id")
    exact = F.col(column) == F.col("frozen")
    return both.withColumn("fdist", F.when(exact, F.lit("fixed")).otherwise(F.col("fdist"))).withColumn("fest", F.when(exact, F.lit(0.0)).otherwise(F.col("fest")))


def gain(with_frozen: DataFrame, base: DataFrame, measure: str = "pred_conf") -> DataFrame:
    """(req_id, frozen, qinf): what freezing adds to the confidence (or takes from error or variance)."""
    sign = 1 if measure == "pred_conf" else -1
    left = with_frozen.select("req_id", "frozen", F.col(measure).alias("_w"))
    return left.join(base.select("req_id", F.col(measure).alias("_b")), "req_id").select("req_id", "frozen", (sign * (F.col("_w") - F.col("_b"))).alias("qinf"))


def direct(features: DataFrame, column: str, weights: dict[str, float], bias: float, n: int, tolerance: float, measure: str = "pred_conf", seed: int = 0) -> DataFrame:
    """(req_id, frozen, qinf): ``gain`` of every group of ``column`` for a linear model, each prediction within its own row.

    Draws depend on request, feature and step alone, so every variant sees the same ones. Nothing is shuffled but the features.
    """
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y) / F.size(a)
    dev = lambda y, c: F.abs(y - F.col(c))
    told = (lambda a, c: mean(F.transform(a, lambda y: (dev(y, c) <= tolerance + 1e-9).cast("double")))) if measure == "pred_conf" else (lambda a, c: mean(F.transform(a, lambda y: dev(y, c) * dev(y, c))))
    base = U.drawn_by_request(features, weights, n, column, seed).withColumn("_p", U.linear_of(n, bias)).withColumn("_c", mean(F.col("_p")))
    base = base.select("req_id", "_x", told(F.col("_p"), "_c").alias("_b"), F.explode(F.array_distinct(F.transform("_x", lambda x: x["of"]))).alias("frozen"))
    with_frozen = base.withColumn("_p", U.linear_of(n, bias, F.col("frozen"))).withColumn("_c", mean(F.col("_p")))
    sign = 1 if measure == "pred_conf" else -1
    return with_frozen.select("req_id", "frozen", (sign * (told(F.col("_p"), "_c") - F.col("_b"))).alias("qinf"))
