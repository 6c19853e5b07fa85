"""Evaluation of sampled runs against exact answers and labels: every run reads the real table at growing levels until its error is told to be small."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkling.operators import metrics as V
from inkling.sources.ingest import assign_pid, read
from inkling.sources.storage import materialize

from .base import query, rounded
from .estimate_queries import KEY, PID

LEVELS, SEEDS, TOLERANCES, Z = [10, 20, 40, 70, 100], 3, {"loose": 2.0, "tight": 1.0}, 1.959963984540054
#: Columns, their weights in the prediction, and the error of each that a configuration with tolerance 1 accepts.
COLUMNS = {"l_quantity": (1.0, 1.5), "l_discount": (100.0, 0.003)}
MAX_ERROR, MAX_RELATIVE, MIN_CONF = 2.0, 0.05, 0.95

_EST = " UNION ALL ".join(f"SELECT l_suppkey AS req_id, seed, lv, '{c}' AS col, {w} AS w, {t} AS tol, count(*) AS n, avg({c}) AS m, coalesce(stddev_samp({c}), 0) AS s FROM lineitem, range({SEEDS}) r(seed), (VALUES {', '.join(f'({k})' for k in LEVELS)}) v(lv) WHERE ({PID} + 33 * seed) % 100 < lv GROUP BY 1, 2, 3" for c, (w, t) in COLUMNS.items())
RUN = f"""est AS ({_EST}), cf AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {t}::DOUBLE)" for n, t in TOLERANCES.items())}) v(cfg, k)),
ok AS (SELECT *, CASE WHEN lv = 100 THEN 0 ELSE {Z} * s / sqrt(n) END AS e, row_number() OVER (PARTITION BY cfg, req_id, seed, col ORDER BY lv) AS try FROM est, cf WHERE lv = 100 OR (n >= 30 AND {Z} * s / sqrt(n) <= tol * k)),
ch AS (SELECT cfg, req_id, seed, sum(w * m) AS pred, sum(w * e) AS pred_error, sum((w * e / {Z}) ** 2) AS pred_var, max(CASE lv {' '.join(f'WHEN {k} THEN {i}' for i, k in enumerate(LEVELS, 1))} END) AS rounds, list(lv / 100.0::DOUBLE ORDER BY col DESC) AS shares, sum(n) AS cost FROM ok WHERE try = 1 GROUP BY 1, 2, 3),
ex AS (SELECT req_id, sum(w * m) AS exact, sum(n) AS exact_cost FROM est WHERE lv = 100 AND seed = 0 GROUP BY 1),
run AS (SELECT *, CASE WHEN pred_error = 0 THEN 1.0 ELSE 0.95 END AS pred_conf, round(exact * 2) / 2 AS label FROM ch JOIN ex USING (req_id)),
b AS (SELECT cfg, seed, min(label) AS lo, max(label) AS hi FROM run GROUP BY 1, 2),
rp AS (SELECT cfg, seed, avg(pred_error) AS claimed_error, avg(pred_conf) AS conf, avg(pred_var) AS var, avg(abs(pred - exact)) AS real_error, avg((abs(pred - exact) <= {MAX_ERROR})::INTEGER) AS meet_error, avg((abs(pred - exact) <= {MAX_RELATIVE} * abs(exact))::INTEGER) AS meet_relative,
avg((pred_error <= {MAX_ERROR})::INTEGER) AS meet_claimed, avg((pred_conf >= {MIN_CONF})::INTEGER) AS meet_conf, avg(rounds) AS rounds, 1 - avg((least(greatest(exact, lo), hi) - least(greatest(pred, lo), hi)) ** 2) / var_pop(least(greatest(exact, lo), hi)) AS similarity,
1 - avg((label - least(greatest(pred, lo), hi)) ** 2) / var_pop(label) AS accuracy, 1 - avg((label - least(greatest(exact, lo), hi)) ** 2) / var_pop(label) AS exact_accuracy, avg(exact_cost) / avg(cost) AS speedup, avg(shares[1]) AS share_quantity, avg(shares[2]) AS share_discount FROM run JOIN b USING (cfg, seed) GROUP BY 1, 2)"""
VALUES = ["claimed_error", "conf", "var", "real_error", "meet_error", "meet_relative", "meet_claimed", "meet_conf", "rounds", "similarity", "accuracy", "exact_accuracy", "speedup"]


def run(spark, d):
    """(cfg, seed, req_id, …): suppliers' predictions, each column read at the first level whose half-width is within its tolerance."""
    rows = assign_pid(read(spark, d, "lineitem"), KEY).select(F.col("l_suppkey").alias("req_id"), "pid", *COLUMNS)
    # Every row counts at a level of each seed and all above: partials by pid, then one sum for each level.
    parts = rows.groupBy("req_id", "pid").agg(F.count(F.lit(1)).alias("n"), *[f(F.col(c)).alias(f"{p}_{c}") for c in COLUMNS for p, f in (("s", F.sum), ("q", lambda x: F.sum(x * x)))])
    levels = F.filter(F.array(*[F.lit(k) for k in LEVELS]), lambda k: k > F.col("_at"))
    seen = parts.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1)))).withColumn("_at", (F.col("pid") + 33 * F.col("seed")) % 100).withColumn("lv", F.explode(levels))
    est = seen.groupBy("req_id", "seed", "lv").agg(F.sum("n").alias("n"), *[F.sum(f"{p}_{c}").alias(f"{p}_{c}") for c in COLUMNS for p in "sq"])
    n = F.col("n")

    def one(c, w, tol):
        var = F.when(n > 1, F.greatest(F.lit(0.0), (F.col(f"q_{c}") - F.col(f"s_{c}") * F.col(f"s_{c}") / n) / F.when(n > 1, n - 1)))
        return F.struct(F.lit(c).alias("col"), F.lit(w).alias("w"), F.lit(tol).alias("tol"), (F.col(f"s_{c}") / n).alias("m"), (Z * F.sqrt(F.coalesce(var, F.lit(0.0))) / F.sqrt(n)).alias("e"))

    long = est.withColumn("_c", F.explode(F.array(*[one(c, w, t) for c, (w, t) in COLUMNS.items()]))).select("req_id", "seed", "lv", "n", "_c.*")
    long = materialize(long.withColumn("e", F.when(F.col("lv") == 100, 0.0).otherwise(F.col("e"))))
    cfgs = F.explode(F.array(*[F.struct(F.lit(name).alias("cfg"), F.lit(k).alias("k")) for name, k in TOLERANCES.items()]))
    tried = long.withColumn("_g", cfgs).select("*", "_g.*").filter((F.col("lv") == 100) | ((n >= 30) & (F.col("e") <= F.col("tol") * F.col("k"))))
    chosen = tried.groupBy("cfg", "req_id", "seed", "col").agg(F.min_by(F.struct("lv", "n", "w", "m", "e"), "lv").alias("_b")).select("cfg", "req_id", "seed", "col", "_b.*")
    w, m, e = F.col("w"), F.col("m"), F.col("e")
    made = chosen.groupBy("cfg", "req_id", "seed").agg(
        F.sum(w * m).alias("pred"), F.sum(w * e).alias("pred_error"), F.sum((w * e / Z) * (w * e / Z)).alias("pred_var"), F.max(F.array_position(F.array(*[F.lit(k) for k in LEVELS]), F.col("lv"))).alias("rounds"),
        F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("col", (F.col("lv") / 100.0).alias("x"))))), lambda x: x["x"]).alias("shares"), F.sum("n").alias("cost"),
    )
    exact = long.filter("lv = 100 and seed = 0").groupBy("req_id").agg(F.sum(w * m).alias("exact"), F.sum("n").alias("exact_cost"))
    return made.join(exact, "req_id").withColumns({"pred_conf": F.when(F.col("pred_error") == 0, 1.0).otherwise(0.95), "label": F.round(F.col("exact") * 2) / 2})


def reports(spark, d):
    return V.run_report(run(spark, d), ["cfg", "seed"], max_error=MAX_ERROR, max_relative=MAX_RELATIVE, min_conf=MIN_CONF)


@query("v5_v6_v7_run_reports", f"WITH {RUN} SELECT cfg, seed, {', '.join(f'round({v} + 1e-9, 6) AS {v}' for v in [*VALUES, 'share_quantity', 'share_discount'])}, round(share_quantity + share_discount + 1e-9, 6) AS share_total, round(exact_accuracy - accuracy + 1e-9, 6) AS loss, round(100 * (exact_accuracy - accuracy) / exact_accuracy + 1e-9, 5) AS loss_pct FROM rp")
def run_reports(spark, d):
    """A report of each run: real and claimed errors, targets met, shares read, similarity, accuracy and its loss, speed-up in rows read."""
    r = reports(spark, d).withColumns({"share_quantity": F.col("shares")[0], "share_discount": F.col("shares")[1]}).drop("shares")
    return r.select("cfg", F.col("seed").cast("long").alias("seed"), *[F.round(F.col(c) + 1e-9, 5 if c == "loss_pct" else 6).alias(c) for c in r.columns if c not in ("cfg", "seed")])


@query("v8_over_seeds", f"WITH {RUN} SELECT cfg, {', '.join(f'round(avg({v}) + 1e-9, 6) AS {v}' for v in VALUES)}, round(avg(share_quantity) + 1e-9, 6) AS share_quantity, round(avg(share_discount) + 1e-9, 6) AS share_discount, count(*) AS seeds FROM rp GROUP BY 1")
def v8(spark, d):
    r = V.over_seeds(reports(spark, d), ["cfg"], "seed", VALUES, ["shares"])
    r = r.withColumns({"share_quantity": F.col("shares")[0], "share_discount": F.col("shares")[1]}).drop("shares")
    return r.select("cfg", "seeds", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in r.columns if c not in ("cfg", "seeds")])


@query("v9_rounds", f"WITH {RUN}, h AS (SELECT cfg, rounds, count(*) AS n FROM run GROUP BY 1, 2) SELECT cfg, rounds, n, round(n / sum(n) OVER (PARTITION BY cfg), 6)::DOUBLE AS share, round(sum((rounds - 1) * n) OVER (PARTITION BY cfg) / sum(rounds * n) OVER (PARTITION BY cfg), 6)::DOUBLE AS failed_share FROM h")
def v9(spark, d):
    return rounded(V.round_counts(run(spark, d), ["cfg"]))
