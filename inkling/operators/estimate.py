"""Sampled estimates with errors, bootstrap, and profiles over sample sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkling.functions import estimators as E
from inkling.functions.hashing import uniform
from inkling.sources.storage import materialize

#: Cumulative probabilities of the Poisson(1) distribution by the first seven counts.
POISSON_CUTS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]


def estimates(matched: DataFrame, keys: list[str], value: str, p: float, tsize: int, ops: list[str], min_support: int = E.MIN_SUPPORT) -> DataFrame:
    """Long table (keys, op, fval, fest, fdist, card) of the closed-form operators over a sample of share ``p``."""
    g = matched.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("s1"), F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_distinct(value).cast("double").alias("u"), *[F.percentile(value, F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.5, 0.9, 0.99)])
    n, share, size = F.col("n"), F.lit(float(p)), F.lit(float(tsize))
    sd = F.sqrt("v")
    var_s, var_p = E.est_var_samp(n, F.col("v")), E.est_var_pop(n, F.col("v"))
    none = F.lit(None).cast("double")
    table = {
        "count": (E.est_count(n, share), E.err_count(n, share, size)),
        "sum": (E.est_sum(F.col("s1"), share), E.err_sum(sd, share, size)),
        "avg": (F.col("m"), E.err_avg(sd, n)),
        "varSamp": (var_s, E.err_var(n, F.col("v"), True)),
        "stdSamp": (F.sqrt(var_s), F.sqrt(E.err_var(n, F.col("v"), True))),
        "varPop": (var_p, E.err_var(n, F.col("v"))),
        "stdPop": (F.sqrt(var_p), F.sqrt(E.err_var(n, F.col("v")))),
        "min": (F.col("lo"), none), "max": (F.col("hi"), none), "unique": (F.col("u"), none),
        "median": (F.col("q50"), none), "percentile90": (F.col("q90"), none), "percentile99": (F.col("q99"), none),
    }
    rows = F.array(*[F.struct(F.lit(o).alias("op"), table[o][0].alias("fval"), E.guarded(table[o][1], n, share, min_support).alias("fest")) for o in ops])
    out = g.withColumn("_r", F.explode(rows)).select(*keys, "_r.op", "_r.fval", "_r.fest", E.est_count(n, share).alias("card"))
    tag = F.when(F.col("op") == "max", E.distribution(F.col("fest"), "max")).otherwise(E.distribution(F.col("fest"), "avg"))
    return out.withColumn("fdist", tag)


def poisson_weight(u: Column) -> Column:
    return sum(((u > c).cast("int") for c in POISSON_CUTS[1:]), (u > POISSON_CUTS[0]).cast("int"))


#: Replicates that one aggregation adds up side by side (more and its code no longer compiles as one); further ones take further aggregations.
SIDE_BY_SIDE = 10


def md5_chance(seed: int, row_key: list[str]) -> Callable[[Column], Column]:
    """A number in (0, 1) of a row (by its key) and a replicate, the same in any engine."""
    return lambda rep: uniform(seed, rep, *[F.col(k) for k in row_key])


def _side_by_side(matched: DataFrame, by: list[str], value: str, chance: Callable[[Column], Column], replicates: int, sums: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """(by, rep, sums): one aggregation adds up the weighted sums of many replicates, so no row is repeated for a replicate."""
    out = None
    matched = materialize(matched) if replicates > SIDE_BY_SIDE else matched
    for lo in range(0, replicates, SIDE_BY_SIDE):
        reps = range(lo, min(replicates, lo + SIDE_BY_SIDE))
        rows = matched.select(*by, *([value] if value not in by else []), *[poisson_weight(chance(F.lit(r))).alias(f"_w{r}") for r in reps])
        added = rows.groupBy(*by).agg(*[f(F.col(f"_w{r}"), F.col(value)).alias(f"{name}_{r}") for r in reps for name, f in sums.items()])
        told = added.select(*by, F.explode(F.array(*[F.struct(F.lit(r).alias("rep"), *[F.col(f"{name}_{r}").alias(name) for name in sums]) for r in reps])).alias("_r")).select(*by, "_r.*")
        out = told if out is None else out.unionByName(told)
    return out


def bootstrap_means(matched: DataFrame, keys: list[str], row_key: list[str], value: str, replicates: int = 100, seed: int = 0, chance: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keys, rep, n, s, mean, var): the moments of ``replicates`` resamples in one pass, whatever the number of distinct values."""
    there = lambda w, x: F.when(x.isNotNull(), w)
    sums = {"n": lambda w, x: F.sum(there(w, x)), "s": lambda w, x: F.sum(w * x), "ss": lambda w, x: F.sum(w * x * x)}
    m, s, ss = F.col("n"), F.col("s"), F.col("ss")
    var = F.when(m > 1, F.greatest(F.lit(0.0), (ss - s * s / m) / (m - 1)))
    return _side_by_side(matched, keys, value, chance or md5_chance(seed, row_key), replicates, sums).filter("n > 0").select(*keys, "rep", "n", "s", (s / m).alias("mean"), var.alias("var"))


def poisson_bootstrap(matched: DataFrame, keys: list[str], row_key: list[str], value: str, replicates: int = 100, seed: int = 0, chance: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keys, rep, n, s, mean, median, p50, p90, p99, var, lo, hi, u): aggregates of ``replicates`` resamples (see ``bootstrap_means`` for moments alone).

    Weights are added up by distinct value in the map tasks, those of many replicates side by side, so what is shuffled and sorted
    follows the values of a key, not its rows. ``median`` is the lower one; p50, p90 and p99 interpolate; var is the unbiased variance, u the
    distinct values. ``chance`` maps a replicate to a number in (0, 1) for the row; without it that is md5 of seed, replicate and row key.
    """
    known = matched.filter(F.col(value).isNotNull())
    counted = _side_by_side(known, [*keys, value], value, chance or md5_chance(seed, row_key), replicates, {"w": lambda w, x: F.sum(w)}).filter("w > 0")
    upto = Window.partitionBy(*keys, "rep").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_c", F.sum("w").over(upto)).withColumn("_n", F.sum("w").over(Window.partitionBy(*keys, "rep")))
    x, w, c, n = (F.col(k) for k in (value, "w", "_c", "_n"))

    def quantile(p):
        rank = (n - 1) * F.lit(p)
        lo, hi = (F.min(F.when(c > end(rank), x)) for end in (F.floor, F.ceil))
        part = F.max(rank - F.floor(rank))
        return lo * (1 - part) + hi * part

    s, ss, m = F.sum(w * x), F.sum(w * x * x), F.sum(w)
    var = F.when(m > 1, F.greatest(F.lit(0.0), (ss - s * s / m) / (m - 1)))
    return ranked.groupBy(*keys, "rep").agg(
        m.alias("n"), s.alias("s"), (s / m).alias("mean"), F.min(F.when(c * 2 >= n, x)).alias("median"), quantile(0.5).alias("p50"), quantile(0.9).alias("p90"), quantile(0.99).alias("p99"),
        var.alias("var"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).cast("double").alias("u"),
    )


def with_bootstrap(points: DataFrame, boot: DataFrame, keys: list[str], p: float, min_support: int = E.MIN_SUPPORT, keep: bool = False) -> DataFrame:
    """``points`` (see ``estimates``) where every aggregate but count, sum and avg has the deviation of its bootstrap replicates as error.

    The rules of the closed forms hold: no error for the whole table, unknown below the support. ``keep`` adds the replicates.
    """
    n, v = F.col("n"), F.col("var")
    samp, pop = E.est_var_samp(n, v), E.est_var_pop(n, v)
    table = {"varSamp": samp, "stdSamp": F.sqrt(samp), "varPop": pop, "stdPop": F.sqrt(pop), "min": F.col("lo"), "max": F.col("hi"), "unique": F.col("u"), "median": F.col("p50"), "percentile90": F.col("p90"), "percentile99": F.col("p99")}
    long = boot.select(*keys, F.explode(F.array(*[F.struct(F.lit(o).alias("op"), x.cast("double").alias("x")) for o, x in table.items()])).alias("_r")).select(*keys, "_r.*")
    errors = long.groupBy(*keys, "op").agg(F.stddev_samp("x").alias("_e"), F.sort_array(F.collect_list("x")).alias("reps"))
    told = F.when(F.col("fest").isNull() | (~F.col("op").isin("count", "sum", "avg") & (F.col("fest") != E.UNKNOWN_ERROR) & (F.lit(float(p)) < 1)), F.coalesce("_e", F.lit(E.UNKNOWN_ERROR))).otherwise(F.col("fest"))
    out = points.join(errors, [*keys, "op"], "left").withColumn("fest", told)
    tag = F.when(F.col("op") == "max", E.distribution(F.col("fest"), "max")).otherwise(E.distribution(F.col("fest"), "avg"))
    return out.withColumn("fdist", tag).select(*points.columns, *(["reps"] if keep else []))


def bootstrap_error(boot: DataFrame, keys: list[str], estimate: str, point: DataFrame | None = None, bias_correction: bool = False, keep: bool = False) -> DataFrame:
    """fest = deviation of the replicates; fval = their mean, or twice the point estimate less it; reps if ``keep``."""
    aggs = [F.stddev_samp(estimate).alias("fest"), F.avg(estimate).alias("_mean")] + ([F.sort_array(F.collect_list(estimate)).alias("reps")] if keep else [])
    out = boot.groupBy(*keys).agg(*aggs)
    if bias_correction and point is not None:
        return out.join(point, keys).withColumn("fval", 2 * F.col("fval") - F.col("_mean")).drop("_mean")
    return out.withColumnRenamed("_mean", "fval")


def prefix_profile(matched: DataFrame, keys: list[str], value: str, nparts: int) -> DataFrame:
    """Estimates at every sample size k/nparts in one pass: partials by pid, then cumulative sums over pid."""
    x = F.col(value).cast("double")
    part = matched.groupBy(*keys, "pid").agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    w = Window.partitionBy(*keys).orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)
    run = part.select(*keys, "pid", *[F.sum(c).over(w).alias(c) for c in ("n", "s", "ss")], F.min("lo").over(w).alias("lo"), F.max("hi").over(w).alias("hi"))
    n, s, share = F.col("n"), F.col("s"), (F.col("pid") + 1) / F.lit(float(nparts))
    var = F.when(n > 1, F.greatest(F.lit(0.0), (F.col("ss") - s * s / n) / (n - 1)))
    err = E.guarded(E.err_avg(F.sqrt(var), n), n, share)
    return run.select(*keys, "pid", E.est_count(n, share).alias("count"), (s / share).alias("sum"), (s / n).alias("avg"), err.alias("avg_error"), E.est_var_pop(n, var).alias("varPop"), F.sqrt(E.est_var_pop(n, var)).alias("stdPop"), "lo", "hi")


def error_study(matched: DataFrame, keys: list[str], row_key: list[str], value: str, p: float, seeds: int) -> DataFrame:
    """(keys, seed, error) of the mean over Bernoulli samples against the exact mean."""
    exact = matched.groupBy(*keys).agg(F.avg(value).alias("exact"))
    sampled = matched.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).filter(uniform(F.col("seed"), *[F.col(k) for k in row_key]) < p)
    return sampled.groupBy(*keys, "seed").agg(F.avg(value).alias("est"), F.stddev_samp(value).alias("s"), F.count(value).alias("n")).join(exact, keys).select(*keys, "seed", (F.col("est") - F.col("exact")).alias("error"), (F.abs(F.col("est") - F.col("exact")) <= 1.959963984540054 * F.col("s") / F.sqrt("n")).alias("covered"))
