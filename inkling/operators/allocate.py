"""How much more data each query gets: rules on a table (req_id, qname, qsample, influence, weight).

Fractions are counted in steps of ``gran``; ``valid`` is what a query has left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def start(queries: DataFrame, alpha: int, ncfgs: int) -> DataFrame:
    """First fractions: ``alpha`` steps of sampled queries, all of the others."""
    gran = round(1 / ncfgs, 3)
    return queries.withColumn("qsample", F.when(F.col("kind") == "AGG", F.least(F.lit(1.0), F.lit(alpha * gran))).otherwise(1.0))


def step_size(beta: int, rounds: int, naggs: int) -> int:
    return beta if beta else max(1, round(2 ** (rounds / naggs)))


def with_steps(plan: DataFrame, gran: float) -> DataFrame:
    return plan.withColumn("valid", F.round((1 - F.col("qsample")) / gran).cast("long"))


def min_card(plan: DataFrame, gran: float, support: int = 30) -> DataFrame:
    """Queries whose expected rows fall short jump to the fraction that has them (to a half first if that is far); ``jumped`` tells if any of the request did."""
    need = F.least(F.lit(float(support)) / F.col("qcard"), F.lit(1.0))
    short = F.col("qcard").isNotNull() & (F.col("qsample") < need)
    target = F.least(F.lit(1.0), F.ceil(need / gran - 1e-9) * gran)
    jump = F.when((F.col("qsample") <= 0.1) & (need >= 0.5), F.lit(0.5)).otherwise(target)
    out = plan.withColumn("_up", short).withColumn("qnext", F.when(short, jump).otherwise(F.col("qsample")))
    return out.withColumn("jumped", F.max("_up").over(Window.partitionBy("req_id"))).drop("_up")


def priority(policy: str) -> Column:
    """greedy: influence for what is left; greedy_plus and optimizer: per cost too; blqcost: cost alone."""
    left = F.greatest(1 - F.col("qsample"), F.lit(1e-9))
    return {
        "greedy": F.col("influence") / left,
        "greedy_plus": F.col("influence") / (F.col("weight") * left),
        "optimizer": F.greatest(F.col("influence"), F.lit(0.0)) / (F.col("weight") * left),
        "blqcost": 1 / (F.col("weight") * left),
    }[policy]


def round_robin(plan: DataFrame, score: Column, steps: int | Column, gran: float) -> DataFrame:
    """``steps`` steps (of each request, where it is a column), one at a time to each query in order of score, until used up."""
    steps = steps if isinstance(steps, Column) else F.lit(steps)
    ranked = with_steps(plan, gran).withColumn("_p", score).withColumn("_steps", steps.cast("long")).withColumn("_rank", F.row_number().over(Window.partitionBy("req_id").orderBy(F.desc("_p"), "qname")))
    units = ranked.filter("valid > 0 and _steps > 0").select("req_id", "qname", "_rank", "_steps", F.explode(F.sequence(F.lit(1).cast("long"), F.least("valid", "_steps"))).alias("_level"))
    taken = units.withColumn("_i", F.row_number().over(Window.partitionBy("req_id").orderBy("_level", "_rank"))).filter(F.col("_i") <= F.col("_steps")).groupBy("req_id", "qname").agg(F.count(F.lit(1)).alias("_add"))
    return _apply(ranked.join(taken, ["req_id", "qname"], "left"), F.coalesce("_add", F.lit(0)), gran)


def best_first(plan: DataFrame, score: Column, steps: int, gran: float) -> DataFrame:
    """All steps to the best query until it is full, then to the next."""
    w = Window.partitionBy("req_id").orderBy(F.desc("_p"), "qname").rowsBetween(Window.unboundedPreceding, -1)
    ranked = with_steps(plan, gran).withColumn("_p", score).withColumn("_before", F.coalesce(F.sum("valid").over(w), F.lit(0)))
    return _apply(ranked, F.greatest(F.lit(0), F.least(F.col("valid"), F.lit(steps) - F.col("_before"))), gran)


def uniform(plan: DataFrame, steps: int, gran: float) -> DataFrame:
    return _apply(with_steps(plan, gran), F.least(F.col("valid"), F.lit(steps)), gran)


def doubled(plan: DataFrame) -> DataFrame:
    return plan.withColumn("qnext", F.least(2 * F.col("qsample"), F.lit(1.0)))


def step_gradient(plan: DataFrame, steps: int, gran: float) -> DataFrame:
    """Shares by normalised influence, variance and cost, taken in order of the share from the steps that are left; what remains goes best first."""
    g = F.greatest(F.col("influence"), F.lit(0.0)) * F.col("pvar") / (F.col("weight") * F.greatest(1 - F.col("qsample"), F.lit(1e-9)))
    w = Window.partitionBy("req_id")
    rows = with_steps(plan, gran).withColumn("_g", F.when(F.col("valid") > 0, g).otherwise(0.0)).withColumn("_norm", F.sum("_g").over(w)).withColumn("_open", F.sum((F.col("valid") > 0).cast("int")).over(w))
    share = F.when(F.col("_norm") < 1e-9, F.when(F.col("valid") > 0, 1 / F.col("_open")).otherwise(0.0)).otherwise(F.col("_g") / F.col("_norm"))
    one = rows.withColumn("_s", share).groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("_s")).alias("neg"), "qname", "valid"))).alias("q"))
    first = F.aggregate("q", F.struct(F.lit(steps).cast("long").alias("left"), F.array().cast("array<bigint>").alias("add")), lambda acc, x: F.struct((acc["left"] - F.least(x["valid"], F.floor(-x["neg"] * acc["left"]))).alias("left"), F.concat(acc["add"], F.array(F.least(x["valid"], F.floor(-x["neg"] * acc["left"])))).alias("add")))
    folded = one.withColumn("_f", first).select("req_id", F.col("_f.left").alias("_left"), F.posexplode(F.arrays_zip("q", F.col("_f.add").alias("add"))).alias("_pos", "_z"))
    before = Window.partitionBy("req_id").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    spare = F.col("_z.q.valid") - F.col("_z.add")
    more = folded.withColumn("_spare", spare).withColumn("_b", F.coalesce(F.sum("_spare").over(before), F.lit(0))).select("req_id", F.col("_z.q.qname").alias("qname"), (F.col("_z.add") + F.greatest(F.lit(0), F.least(F.col("_spare"), F.col("_left") - F.col("_b")))).alias("_add"))
    return _apply(with_steps(plan, gran).join(more, ["req_id", "qname"]), F.col("_add"), gran)


def gradient(plan: DataFrame, steps: int, gran: float) -> DataFrame:
    """Unnormalised shares, at most half of everything each; one step each where all are zero or nothing is known. Full queries stay."""
    g = F.greatest(F.col("influence"), F.lit(0.0)) * F.col("pvar") / (F.col("weight") * F.greatest(1 - F.col("qsample"), F.lit(1e-9)))
    w = Window.partitionBy("req_id")
    rows = with_steps(plan, gran).withColumn("_g", g).withColumn("_norm", F.sum("_g").over(w))
    rows = rows.withColumn("_add", F.least(F.col("valid"), F.floor(steps * F.col("_g") / gran), F.lit(int(0.5 / gran))))
    flat = (F.max("_add").over(w) == 0) | (F.col("_norm") < 1e-9)
    return _apply(rows.withColumn("_flat", flat), F.when(F.col("_flat"), F.least(F.col("valid"), F.lit(1))).otherwise(F.col("_add")), gran)


def adaptive(plan: DataFrame, gran: float, support: int = 30) -> DataFrame:
    """Base rule: queries with few rows jump to all of it; the request then has ceil(1 / conf) steps in all, one at a time by influence."""
    jumped = plan.withColumn("qsample", F.when(F.col("qcard") < support, F.lit(1.0)).otherwise(F.col("qsample")))
    return round_robin(jumped, F.col("influence"), F.ceil(1 / F.greatest(F.col("pred_conf"), F.lit(0.05))), gran)


def _apply(rows: DataFrame, add: Column, gran: float) -> DataFrame:
    out = rows.withColumn("qnext", F.least(F.lit(1.0), F.round(F.col("qsample") + add * gran, 6)))
    return out.drop(*[c for c in out.columns if c.startswith("_")], "valid")


def finished(state: DataFrame, *, max_error: float | None = None, min_conf: float | None = None, max_relative_error: float | None = None, min_max: float | None = None, max_pvar: float | None = None) -> DataFrame:
    """``done``: exact or fully sampled, or every target that is set holds."""
    targets = [F.col("pred_error") <= max_error] if max_error is not None else []
    targets += [F.col("pred_conf") >= min_conf] if min_conf is not None else []
    targets += [F.col("pred_error") / F.greatest(F.abs("pred_value"), F.lit(1e-9)) <= max_relative_error] if max_relative_error is not None else []
    targets += [1.959963984540054 * F.sqrt("pred_var") <= min_max] if min_max is not None else []
    targets += [F.col("pred_var") <= max_pvar] if max_pvar is not None else []
    met = F.lit(bool(targets))
    for t in targets:
        met = met & t
    return state.withColumn("done", ((F.col("pred_error") < 1e-9) & (F.col("pred_conf") > 1 - 1e-9)) | (F.col("min_qsample") >= 1) | met)
