"""Costs, datasets and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkling.functions.estimators import normal_cdf

from inkling.functions.hashing import uniform

EPS = 2.220446049250313e-16


def regression(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """mae, mse, mape, r2, explained variance and largest error in one aggregation."""
    e = F.col(y) - F.col(p)
    sse, n, vy = F.sum(e * e), F.count(F.lit(1)), F.var_pop(y)
    return df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPS))).alias("mape"), (1 - sse / n / vy).alias("r2"), (1 - F.var_pop(e) / vy).alias("expv"), F.max(F.abs(e)).alias("maxe"))


def binary(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 and the AUC of hard labels, (TPR + TNR) / 2; zero where undefined, AUC null with one class."""
    c = lambda a, b: F.count_if((F.col(y) == a) & (F.col(p) == b))
    out = df.groupBy(*by).agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return out.select(*by, ((tp + tn) / (tp + fp + fn + tn)).alias("acc"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), F.when((tp + fn > 0) & (tn + fp > 0), (tp / (tp + fn) + tn / (tn + fp)) / 2).alias("auc"))


def multiclass(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall and F1 weighted by class size."""
    both = df.select(F.explode(F.array(F.struct(F.col(y).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("g"), (F.col(y) == F.col(p)).cast("int").alias("ok")), F.struct(F.col(p).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("ok")))).alias("r")).select("r.*")
    per = both.groupBy("c").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("ok").alias("ok"))
    pr, rc = F.when(F.col("g") > 0, F.col("ok") / F.col("g")).otherwise(0.0), F.when(F.col("t") > 0, F.col("ok") / F.col("t")).otherwise(0.0)
    f1 = F.when(F.col("t") + F.col("g") > 0, 2 * F.col("ok") / (F.col("t") + F.col("g"))).otherwise(0.0)
    return per.agg(*[(F.sum(m * F.col("t")) / F.sum("t")).alias(n) for n, m in (("precision", pr), ("recall", rc), ("f1", f1))])


def pair_auc(scores: DataFrame, label: str) -> DataFrame:
    """AUC of each ordered class pair by rank sums, from long scores (id, label, cls, score): rows of the two classes by the first one's score."""
    classes = scores.agg(F.collect_set("cls").alias("_all"))  # one row: the classes
    y, a = F.col(label), F.col("cls")
    others = F.when(y == a, F.array_except("_all", F.array(a))).when(F.array_contains("_all", y), F.array(y))  # a row of another class meets that one alone
    pairs = scores.join(F.broadcast(classes)).select(y.alias("y"), a.alias("a"), "score", F.explode(others).alias("b"))
    by_score = pairs.groupBy("a", "b", "score").agg(F.count_if(F.col("y") == F.col("a")).alias("pos"), F.count_if(F.col("y") == F.col("b")).alias("neg"))
    w = Window.partitionBy("a", "b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    won = by_score.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    return won.groupBy("a", "b").agg((F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def threshold_sweep(scored: DataFrame, y: str, score: str, lo: int = 40, hi: int = 80) -> DataFrame:
    """(th, macro_f1): mean of both classes' F1 at every threshold from lo to hi hundredths."""
    x = scored.select(F.col(y).alias("y"), F.col(score).alias("s"), F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("k")).withColumn("th", F.col("k") / 100.0)
    x = x.withColumn("p", (F.col("s") >= F.col("th")).cast("int"))
    flipped = binary(x.select("th", (1 - F.col("y")).alias("y"), (1 - F.col("p")).alias("p")), "y", "p", ["th"]).select("th", F.col("f1").alias("f0"))
    return binary(x, "y", "p", ["th"]).join(flipped, "th").select("th", ((F.col("f1") + F.col("f0")) / 2).alias("macro_f1"))


def feature_metrics(df: DataFrame) -> DataFrame:
    """Per feature from long rows (fname, exact, approx); NaN and null count as zero."""
    clean = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(0.0)).alias(c)
    return regression(df.select("fname", clean("exact"), clean("approx")), "exact", "approx", ["fname"])


def linear_cost(profiles: DataFrame) -> DataFrame:
    """Non-negative linear fit time ~ qsample per query; a falling one becomes its mean."""
    g = profiles.groupBy("qname").agg(F.regr_slope("time", "qsample").alias("slope"), F.regr_intercept("time", "qsample").alias("intercept"), F.avg("time").alias("mean"))
    down = F.col("slope") < 0
    return g.select("qname", F.when(down, 0.0).otherwise(F.col("slope")).alias("weight"), F.when(down, F.col("mean")).otherwise(F.col("intercept")).alias("intercept"))


def random_split(df: DataFrame, key: str, ratios: tuple[float, float] = (0.5, 0.3), seed: int = 0) -> DataFrame:
    u = uniform(seed, F.col(key))
    return df.withColumn("split", F.when(u < ratios[0], "train").when(u < sum(ratios), "valid").otherwise("test"))


def latest_per_class(df: DataFrame, key: str, label: str, ts: str, per: int, top: int, tie: str) -> DataFrame:
    """The ``per`` latest rows of each label of the ``top`` keys by count."""
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), key).limit(top).select(key)
    w = Window.partitionBy(key, label).orderBy(F.desc(ts), tie)
    return df.join(keys, key, "left_semi").withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= per).drop("_i")


def jarque_bera(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Statistic n/6 (S² + K²/4) and its p-value exp(-JB/2)."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("s"), F.kurtosis(value).alias("k"))
    jb = F.col("n") / 6 * (F.col("s") ** 2 + F.col("k") ** 2 / 4)
    return g.select(*keys, jb.alias("jb"), F.exp(-jb / 2).alias("p"))


def ks_two_sample(df: DataFrame, keys: list[str], value: str, side: str) -> DataFrame:
    """Largest difference of the two samples' distribution functions (side 0 and 1)."""
    per = df.groupBy(*keys, value).agg(F.sum(F.col(side)).alias("b"), F.sum(1 - F.col(side)).alias("a"))
    w, all_ = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    gap = F.abs(F.sum("a").over(w) / F.sum("a").over(all_) - F.sum("b").over(w) / F.sum("b").over(all_))
    return per.withColumn("gap", gap).groupBy(*keys).agg(F.max("gap").alias("ks"))


def ks_normal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Largest difference of a sample's distribution function from the normal one of its own mean and deviation."""
    fitted = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count(value).alias("_all")).filter("_s > 0")
    per = df.groupBy(*keys, value).agg(F.count(value).alias("n")).join(fitted, keys)
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.col("_all")
    z = (F.col(value) - F.col("_m")) / F.col("_s")
    gaps = per.withColumn("_f", upto).withColumn("_g", normal_cdf(z))
    return gaps.groupBy(*keys).agg(F.max(F.greatest(F.abs(F.col("_f") - F.col("_g")), F.abs(F.col("_g") - F.col("_f") + F.col("n") / F.col("_all")))).alias("ks"))


def capped_regret(errors: DataFrame, key: str, cap: float) -> DataFrame:
    """Refresh priority: errors of a key by label time, each sum capped, added up."""
    per = errors.groupBy(key, "label_ts").agg(F.least(F.sum("err"), F.lit(cap)).alias("e"))
    return per.groupBy(key).agg(F.sum("e").alias("priority"))


def refresh_budget(now: Column, last: Column, budget: float) -> Column:
    return F.when(F.lit(abs(budget) < 1e-12), 0).when(last.isNull(), 1).otherwise(F.floor((now - last) * budget)).cast("long")


def run_report(run: DataFrame, by: list[str], *, max_error: float, max_relative: float, min_conf: float) -> DataFrame:
    """One row for each run of ``run`` (by; pred, pred_error, pred_conf, pred_var, rounds, shares, cost; exact, exact_cost, label).

    Means of claimed error, confidence, variance and real error; shares of requests that meet each target; rounds and the share read, by query and in
    all; similarity to the exact prediction and accuracy against the label (r2, predictions held within the run's labels), the
    loss of accuracy against the exact job, and how many times cheaper than it the run was.
    """
    real = F.abs(F.col("pred") - F.col("exact"))
    met = lambda c: F.avg(c.cast("double"))
    ends = run.groupBy(*by).agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    held = lambda c: F.least(F.greatest(F.col(c), F.col("_lo")), F.col("_hi"))
    rows = run.join(ends, by).withColumns({"_p": held("pred"), "_x": held("exact")})
    r2 = lambda y, p: 1 - F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))) / F.var_pop(y)
    width = F.size(F.first("shares"))
    told = rows.groupBy(*by).agg(
        F.avg("pred_error").alias("claimed_error"), F.avg("pred_conf").alias("conf"), F.avg("pred_var").alias("var"), F.avg(real).alias("real_error"),
        met(real <= max_error).alias("meet_error"), met(real <= max_relative * F.abs("exact")).alias("meet_relative"), met(F.col("pred_error") <= max_error).alias("meet_claimed"), met(F.col("pred_conf") >= min_conf).alias("meet_conf"),
        F.avg("rounds").alias("rounds"), r2("_x", "_p").alias("similarity"), r2("label", "_p").alias("accuracy"), r2("label", "_x").alias("exact_accuracy"), (F.avg("exact_cost") / F.avg("cost")).alias("speedup"), width.alias("_w"),
    )
    shares = list_means(run.select(*by, "shares"), by, "shares")
    loss = (F.col("exact_accuracy") - F.col("accuracy")).alias("loss")
    total = F.aggregate("shares", F.lit(0.0), lambda s, x: s + x).alias("share_total")
    return told.join(shares, by).select("*", loss, (100 * loss / F.col("exact_accuracy")).alias("loss_pct"), total).drop("_w")


def list_means(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, column): the element-wise mean of a column of lists."""
    each = df.select(*by, F.posexplode(column).alias("_at", "_x")).groupBy(*by, "_at").agg(F.avg("_x").alias("_x"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda x: x["_x"]).alias(column))


def over_seeds(reports: DataFrame, keys: list[str], seed: str, values: list[str], lists: list[str] = (), order: str | None = None) -> DataFrame:
    """Means over the seeds of each configuration, lists element by element; of several reports of a seed the first by ``order`` counts."""
    first = reports.groupBy(*keys, seed).agg(F.min_by(F.struct(*values, *lists), order or F.lit(0)).alias("_r")).select(*keys, seed, "_r.*")
    out = first.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("seeds"))
    for c in lists:
        out = out.join(list_means(first.select(*keys, c), keys, c), keys)
    return out


def round_counts(run: DataFrame, by: list[str]) -> DataFrame:
    """(by, rounds, n, share, failed_share): the histogram of rounds, and the share of all rounds that did not end a request."""
    counted = run.groupBy(*by, "rounds").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    failed = F.sum((F.col("rounds") - 1) * F.col("n")).over(w) / F.sum(F.col("rounds") * F.col("n")).over(w)
    return counted.select(*by, "rounds", "n", (F.col("n") / F.sum("n").over(w)).alias("share"), failed.alias("failed_share"))
