"""Feature uncertainty through a model: draws, predictions, constraints."""

from __future__ import annotations

from functools import lru_cache
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkling.functions.estimators import UNKNOWN_ERROR, normal_ppf
from inkling.functions.hashing import uniform

@lru_cache(maxsize=4096)
def root(k: int) -> float:
    """Square root of the k-th prime (from 0): the step of the additive recurrence in dimension k."""
    primes, n = [], 1
    while len(primes) <= k:
        n += 1
        if all(n % p for p in primes if p * p <= n):
            primes.append(n)
    return sqrt(primes[k])


def recurrence(i: Column, dimension: int) -> Column:
    """Low-discrepancy number of step ``i`` in a dimension."""
    x = (i + 1) * root(dimension) + 0.5
    return F.greatest(F.lit(1e-9), x - F.floor(x))


def draw(u: Column, fval: Column, fest: Column, fdist: Column, reps: Column | None = None) -> Column:
    """A value of a feature for the uniform number ``u``; a null error is an unknown one."""
    fest = F.coalesce(fest, F.lit(UNKNOWN_ERROR))
    z = normal_ppf(u)
    out = F.when((fdist == "fixed") | (fest < 1e-9), fval).when(fdist == "r-normal", fval + F.abs(z * fest))
    if reps is not None:
        out = out.when(fdist == "unknown", F.element_at(reps, (1 + F.floor(u * F.size(reps))).cast("int")))
    return out.otherwise(fval + fest * z)


def draws(features: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(req_id, i, fname, x): ``n`` draws of every feature, each with a seed of its own."""
    u = uniform(seed, F.col("req_id"), F.col("fname"), F.col("i"))
    stepped = features.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_u", u)  # once, as a column: draw() refers to it often
    return stepped.select("req_id", "i", "fname", draw(F.col("_u"), F.col("fval"), F.col("fest"), F.col("fdist")).alias("x"))


def linear(values: DataFrame, weights: dict[str, float], bias: float, by: list[str]) -> DataFrame:
    """Predictions of a linear model from long features: one sum, no pivot."""
    w = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
    return values.groupBy(*by).agg((F.sum(F.col("x") * F.coalesce(w[F.col("fname")], F.lit(0.0))) + bias).alias("pred"))


def drawn_by_request(features: DataFrame, weights: dict[str, float], n: int, column: str = "fname", seed: int = 0) -> DataFrame:
    """(req_id, _x): of every feature its group (``column``), weight, value and ``n`` draws, the same as those of ``draws``.

    Only features are shuffled; all that follows from the draws of a request can be worked out in its row.
    """
    w = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
    held = features.groupBy("req_id").agg(F.collect_list(F.struct("fname", F.col(column).alias("of"), F.coalesce(w[F.col("fname")], F.lit(0.0)).alias("w"), "fval", "fest", "fdist")).alias("_f"))
    # A lambda binds the uniform number once, as draw() refers to it often.
    one = lambda f, i: F.element_at(F.transform(F.array(uniform(seed, F.col("req_id"), f["fname"], i)), lambda u: draw(u, f["fval"], f["fest"], f["fdist"])), 1)
    each = F.transform("_f", lambda f: F.struct(f["of"].alias("of"), f["w"].alias("w"), f["fval"].alias("fval"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: one(f, i)).alias("draws")))
    return held.select("req_id", each.alias("_x"))


def linear_of(n: int, bias: float, frozen: Column | None = None) -> Column:
    """The ``n`` predictions of a linear model from _x; the features of the group ``frozen`` count by their values."""
    exact = (lambda x: x["of"] == frozen) if frozen is not None else (lambda x: F.lit(False))
    value = lambda x, i: x["w"] * F.when(exact(x), x["fval"]).otherwise(F.get(x["draws"], i))
    known = lambda i: F.filter(F.transform("_x", lambda x: value(x, i)), lambda y: y.isNotNull())
    total = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda t, y: t + y))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(F.transform(F.array(known(i)), total), 1) + bias)


def summarise(preds: DataFrame, constraint: str = "error", value: float = 1.0, classifier: bool = False, eps: float = 1e-9) -> DataFrame:
    """(req_id, pred_value, pred_error, pred_conf, pred_var) from draws of the prediction.

    ``error``: conf is the share within ``value`` of the prediction; ``relative_error``: within that part of it; ``conf``: error
    is the quantile of deviations at that share.
    """
    centre = F.mode("pred", True) if classifier else F.avg("pred")
    at = preds.groupBy("req_id").agg(centre.alias("pred_value"), F.var_pop("pred").alias("pred_var"))
    dev = F.abs(F.col("pred") - F.col("pred_value"))
    if constraint == "relative_error":
        dev = dev / F.greatest(F.abs("pred_value"), F.lit(eps))
    joined = preds.join(at, "req_id").withColumn("dev", dev)
    if constraint == "conf":
        measures = [F.percentile("dev", F.lit(value)).alias("pred_error"), F.lit(value).alias("pred_conf")]
    else:
        measures = [F.lit(value).alias("pred_error"), F.avg((F.col("dev") <= value + 1e-9).cast("double")).alias("pred_conf")]
    return joined.groupBy("req_id", "pred_value", "pred_var").agg(*measures)


def saltelli(features: DataFrame, groups: dict[str, int], n: int) -> DataFrame:
    """(req_id, i, k, fname, x): matrices A (k = 0), AB of each group (k = 1..G) and B (k = G + 1) of a quasi-random base.

    AB of a group takes that group's columns from B and the others from A.
    """
    g, d = max(groups.values()), len(groups)
    names = sorted(groups)
    half = lambda offset: F.coalesce(*[F.when(F.col("fname") == f, recurrence(F.col("i"), j + offset)) for j, f in enumerate(names)])
    group = F.coalesce(*[F.when(F.col("fname") == f, F.lit(groups[f])) for f in names])
    wide = features.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(g + 1))))
    u = F.when((F.col("k") == g + 1) | (F.col("k") == group), half(d)).otherwise(half(0))
    return wide.withColumn("_u", u).select("req_id", "i", "k", "fname", draw(F.col("_u"), F.col("fval"), F.greatest(F.col("fest"), F.lit(1e-9)), F.col("fdist")).alias("x"))
