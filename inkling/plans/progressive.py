"""Exact and progressive prediction over tables of requests, from feature specifications.

The state of a request is one row: for every sampled query the share read so far, the merged partials of its columns and, where an aggregate
has no closed-form error, the states of its resamples. A round matches the open requests with the pids that they have not read yet, merges,
and does all else (errors, draws, predictions, influence, the next steps) by request, so it shuffles by request alone and
writes one table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import add
from statistics import NormalDist

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkling.functions import estimators as E
from inkling.operators import matching as J
from inkling.operators import ml
from inkling.operators import policies as P
from inkling.operators import propagate as U
from inkling.operators import resample as B
from inkling.operators import slices as S
from inkling.operators.allocate import finished, step_size
from inkling.operators.exact import ALIASES
from inkling.operators.spec import FeatureSpec, assemble
from inkling.sources.storage import materialize

#: Partials of a column: rows, sum, sum of squares, least and greatest.
PARTS = {"n": "sum", "s": "sum", "ss": "sum", "lo": "min", "hi": "max"}

#: Aggregates with a closed-form error, and those whose error comes from resamples.
CLOSED = ("count", "sum", "avg", "varPop", "stdPop", "varSamp", "stdSamp")
RESAMPLED = ("min", "max", "unique", "median", "percentile90", "percentile99")

#: Draws that a task scores before it is worth another.
DRAWS_A_TASK = 50_000

#: What a request lacks (a row without features, a missing extra one) counts as this.
MISSING = 0.0

Predict = Callable[[DataFrame], DataFrame]


def linear_model(weights: dict[str, float], bias: float) -> Predict:
    """Adds ``pred``: a weighted sum of the feature columns."""
    return lambda df: df.withColumn("pred", reduce(add, [F.col(f) * w for f, w in weights.items()], F.lit(bias)))


def ml_model(model: PipelineModel) -> Predict:
    """Adds ``pred`` from a fitted Spark ML pipeline over the feature columns (its assembler is the first stage). No row is skipped."""
    scoring = ml.scoring(model)

    def predict(df: DataFrame) -> DataFrame:
        out = scoring.transform(df)
        return out.select(*df.columns, F.col("prediction").cast("double").alias("pred"))

    return predict


def value_and_error(op: str, parts: dict[str, Column], p: Column, tsize: int, default: float = 0.0) -> tuple[Column, Column]:
    """Estimate of a closed-form aggregate and its error from merged partials and the share read.

    At the whole table the estimates are the exact values: variances lose the factor of the sample.
    """
    n, s, ss = (F.coalesce(parts[x], F.lit(0)) for x in ("n", "s", "ss"))
    size, full = F.lit(float(max(2, tsize))), p >= 1 - 1e-9
    if op == "count":
        value, error = F.when(full, n.cast("double")).otherwise(E.est_count(n, p)), E.err_count(n, p, size)
        return F.coalesce(value, F.lit(default)), F.when(full, 0.0).otherwise(F.coalesce(E.guarded(error, n, p), F.lit(E.UNKNOWN_ERROR)))
    n = F.when(n > 0, n)  # nothing is told without rows
    var = F.when(n > 1, F.greatest(F.lit(0.0), (ss - s * s / n) / (n - 1)))
    if op == "sum":
        value, error = F.when(n > 0, E.est_sum(s, p)), E.err_sum(F.sqrt(var), p, size)
    elif op == "avg":
        value, error = s / n, E.err_avg(F.sqrt(var), n)
    else:
        sample = op.endswith("Samp")
        estimate, error = (E.est_var_samp if sample else E.est_var_pop)(n, var), E.err_var(n, var, sample)
        value = F.when(full, var if sample else F.when(n == 1, 0.0).otherwise(var * (n - 1) / n)).otherwise(estimate)
        if op.startswith("std"):
            value, error = F.sqrt(value), F.sqrt(error)
    return F.coalesce(value, F.lit(default)), F.when(full, 0.0).otherwise(F.coalesce(E.guarded(error, n, p), F.lit(E.UNKNOWN_ERROR)))


@dataclass(frozen=True)
class Query:
    """A sampled specification: its number, and for each feature the operator, the place of its column, and whether resamples tell its error."""

    j: int
    spec: FeatureSpec
    columns: list[str]
    features: dict[str, tuple[str, int, bool]]

    @property
    def asked(self) -> list[tuple[int, str]]:
        return [(i, op) for op, i, boot in self.features.values() if boot]

    @property
    def source(self):
        s = self.spec
        return id(s.facts), s.kind, tuple(s.keys), s.width, str(s.condition)


def sampled(spec: FeatureSpec) -> bool:
    """Whether a specification is read by pids; others are worked out exactly before the first round."""
    known = all(isinstance(op, str) and ALIASES.get(op, op) in CLOSED + RESAMPLED for op, _ in spec.features.values())
    return spec.kind in ("group", "trailing", "expanding") and spec.facts is not None and "pid" in spec.facts.columns and known


def _query(j: int, spec: FeatureSpec, boot_all: bool) -> Query:
    columns = list(dict.fromkeys(c for _, c in spec.features.values()))
    ops = {n: (ALIASES.get(op, op), columns.index(c)) for n, (op, c) in spec.features.items()}
    return Query(j, spec, columns, {n: (op, i, boot_all or op in RESAMPLED) for n, (op, i) in ops.items()})


def _all_parts(queries: list[Query], prefix: str = "") -> list[tuple[str, str]]:
    return [(f"{prefix}{x}_{q.j}_{i}", how) for q in queries for i in range(len(q.columns)) for x, how in PARTS.items()] + [(f"{prefix}rows_{q.j}", "sum") for q in queries]


def matched(plan: DataFrame, queries: list[Query], ncfgs: int, ends: dict) -> DataFrame:
    """The facts of one source that the open requests of ``plan`` want: each with the request's first and last wanted pids by query."""
    spec = queries[0].spec
    facts = spec.facts if spec.condition is None else spec.facts.filter(spec.condition)
    lo, hi = (min(ends[q.j][0] for q in queries), max(ends[q.j][1] for q in queries))
    columns = dict.fromkeys(c for q in queries for c in [*q.columns, *q.spec.row_key])
    facts = facts.filter((F.col("pid") >= lo) & (F.col("pid") < hi))
    slim = facts.select(*[F.col(k).alias(f"k_{k}") for k in spec.keys], "pid", *([F.col("ts").alias("_ts")] if spec.kind != "group" else []), F.xxhash64(*(spec.row_key or facts.columns)).alias("_row"), *[F.col(c).alias(f"c_{c}") for c in columns])
    froms, tos = ([F.bround(F.col(f"{at}_{q.j}") * ncfgs).cast("int").alias(f"{name}_{q.j}") for q in queries] for at, name in (("qs", "_lo"), ("qn", "_hi")))
    wants = plan.select("req_id", *[f"k_{k}" for k in spec.keys], *(["req_ts"] if spec.kind != "group" else []), *froms, *tos)
    open_ = [F.col(f"_hi_{q.j}") > F.col(f"_lo_{q.j}") for q in queries]
    wants = wants.filter(reduce(lambda a, b: a | b, open_))
    first = F.least(*[F.when(o, F.col(f"_lo_{q.j}")) for o, q in zip(open_, queries)], F.lit(ncfgs))
    last = F.greatest(*[F.when(o, F.col(f"_hi_{q.j}")) for o, q in zip(open_, queries)], F.lit(0))
    wants = wants.withColumns({"_from": first, "_to": last})
    keys = [f"k_{k}" for k in spec.keys]
    if spec.kind == "trailing":
        met = J.interval_join(wants, slim, keys, spec.width, ts="_ts")
    else:
        met = wants.join(slim, keys)
        met = met.filter(F.col("_ts") < F.col("req_ts")) if spec.kind == "expanding" else met
    return met.filter((F.col("pid") >= F.col("_from")) & (F.col("pid") < F.col("_to")))


def _wanted(q: Query, before: bool = False) -> Column:
    return (F.col("pid") >= F.col(f"_lo_{q.j}")) & (F.col("pid") < F.col(f"_hi_{q.j}") - (1 if before else 0))


def partials(queries: list[Query], previous: bool) -> list[Column]:
    """Aggregates over the pids that each query has not read yet; with ``previous`` those without the last step too (named b_…)."""
    aggs = []
    for prefix, before in [("", False)] + ([("b_", True)] if previous else []):
        for q in queries:
            wanted = _wanted(q, before)
            aggs.append(F.count_if(wanted).alias(f"{prefix}rows_{q.j}"))
            for i, c in enumerate(q.columns):
                value = F.col(f"c_{c}")
                x = F.when(wanted, value if q.spec.facts.schema[c].dataType.typeName() == "string" else value.cast("double"))
                number = x.cast("double") if q.spec.facts.schema[c].dataType.typeName() != "string" else F.lit(None).cast("double")
                aggs += [F.count(x).alias(f"{prefix}n_{q.j}_{i}"), *[f(y).alias(f"{prefix}{name}_{q.j}_{i}") for name, f, y in (("s", F.sum, number), ("ss", F.sum, number * number), ("lo", F.min, number), ("hi", F.max, number))]]
    return aggs


def merging(queries: list[Query], carried: list[str], previous: bool, told: list[str] = ()) -> list[Column]:
    """The state after a round, over the plan joined with the new partials (named _…): those of before and of now, the planned shares, and what
    resamples have ``told`` last."""
    put = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
    parts = [put[how](F.col(c), F.col(f"_{c}")).alias(c) for c, how in _all_parts(queries)]
    if previous:
        parts += [put[how](F.col(c), F.col(f"_b_{c}")).alias(f"b_{c}") for c, how in _all_parts(queries)]
    return [*[F.col(c) for c in carried], *[F.col(f"qn_{q.j}").alias(f"qs_{q.j}") for q in queries], *[F.col(f"qs_{q.j}").alias(f"qb_{q.j}") for q in queries], *parts, *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in told]]


def merged(plan: DataFrame, fresh: list[DataFrame], columns: list[Column]) -> DataFrame:
    for one in fresh:
        plan = plan.join(one.withColumnsRenamed({c: f"_{c}" for c in one.columns if c != "req_id"}), "req_id", "left")
    return plan.select(*columns)


def resampled(state: DataFrame, met: DataFrame, q: Query, gran: float, replicates: int, limit: int, keep: bool, correction: str | None, seed: int) -> DataFrame:
    """``state`` with what the resamples of a query tell: merged states, values, errors and, if ``keep``, replicates."""
    asked = q.asked
    columns = {f"c_{q.columns[i]}": (any(k == i and op in B.QUANTILES for k, op in asked), any(k == i and op == "unique" for k, op in asked)) for i in sorted({k for k, _ in asked})}
    place = {i: at for at, i in enumerate(sorted({k for k, _ in asked}))}
    types = {c: q.spec.facts.schema[c[2:]].dataType.typeName() for c in columns}
    # Distinct texts count by their hashes, which a double tells apart up to 52 bits.
    told = [(F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(c), F.lit(2**52))) if types[c] == "string" else F.col(c)).cast("double").alias(c) for c in columns]
    rows = met.filter(_wanted(q)).select("req_id", F.when(_wanted(q, True), 1).otherwise(2).alias("part"), *told, "_row")
    # By request: else a batch holds rows of as many requests as rows, with a state for each. Weights are made after the shuffle.
    rows = rows.repartition("req_id").sortWithinPartitions("req_id", "part").withColumn("w", B.weights(F.col("_row"), replicates, seed).cast("array<tinyint>"))
    plain = not any(x for asks in columns.values() for x in asks)
    new = B.sorted_sums(rows, ["req_id", "part"], list(columns)) if plain else B.states(rows, ["req_id", "part"], columns, limit)
    shares = state.select("req_id", F.col(f"qs_{q.j}").alias("share"), F.greatest(F.col(f"qs_{q.j}") - gran, F.lit(gran)).alias("share_b"))
    old = state.filter(F.col(f"st_{q.j}").isNotNull()).select(F.col("req_id").cast("long"), F.lit(0).cast("long").alias("part"), F.col(f"st_{q.j}").alias("states"))
    parts = old.unionByName(new).join(shares, "req_id")
    out = B.put_together(parts, [(place[i], op) for i, op in asked], limit, keep, correction)
    names = {"states": f"st_{q.j}", "n": f"rn_{q.j}", "value": f"rv_{q.j}", "error": f"re_{q.j}", "value_b": f"bv_{q.j}", "error_b": f"be_{q.j}", "reps": f"rr_{q.j}"}
    return state.drop(f"st_{q.j}").join(out.withColumnsRenamed(names), "req_id", "left")


@dataclass(frozen=True)
class Estimate:
    """Columns of a feature's estimate, of its replicates if they are drawn from, and of the estimate one step before."""

    query: int
    op: str
    value: Column
    error: Column
    reps: Column | None
    value_b: Column
    error_b: Column


def estimates(queries: list[Query], tsizes: dict[int, int], keep: bool, previous: bool) -> dict[str, Estimate]:
    out = {}
    for q in queries:
        share, at, default = F.col(f"qs_{q.j}"), 0, q.spec.default
        full = share >= 1 - 1e-9
        for name, (op, i, boot) in q.features.items():
            if boot:
                n, v, e, vb, eb = (F.get(F.col(f"{c}_{q.j}"), F.lit(at)) for c in ("rn", "rv", "re", "bv", "be"))
                sure = lambda n, e: F.when(full, 0.0).when(n.isNull() | (n < E.MIN_SUPPORT) | F.isnan(e) | e.isNull(), E.UNKNOWN_ERROR).otherwise(e)
                value = lambda v: F.coalesce(F.when(~F.isnan(v), v), F.lit(default))
                out[name] = Estimate(q.j, op, value(v), sure(n, e), F.when(n >= E.MIN_SUPPORT, F.filter(F.get(F.col(f"rr_{q.j}"), F.lit(at)), lambda x: ~F.isnan(x))) if keep else None, value(vb), sure(n, eb))
                at += 1
            else:
                now, was = ({x: F.col(f"{b}{x}_{q.j}_{i}") for x in PARTS} for b in ("", "b_"))
                v, e = value_and_error(op, now, share, tsizes[q.j], default)
                out[name] = Estimate(q.j, op, v, e, None, *(value_and_error(op, was, F.col(f"qp_{q.j}"), tsizes[q.j], default) if previous else (v, e)))
    return out


@lru_cache(maxsize=16)
def base(draws: int, dimensions: int) -> tuple:
    """Rows (i, z, u): numbers of an additive low-discrepancy recurrence in each dimension, as standard normal ones and as they are."""
    ppf = NormalDist().inv_cdf
    u = [[max(1e-9, ((i + 1) * U.root(k) + 0.5) % 1.0) for k in range(dimensions)] for i in range(draws)]
    return tuple((i, [ppf(min(x, 1 - 1e-12)) for x in row], row) for i, row in enumerate(u))


#: How influence is measured: Sobol indices (first-order or total), or what the target gains by an exact query (or each of its
#: features, added up), or what it has gained by the last step; "variance…" looks at the prediction's variance.
INFLUENCES = ("sobol", "total", "direct", "features", "variance", "previous", "previous_variance")


def drawn(v: Column, e: Column, op: str, reps: Column | None, z: Column, u: Column) -> Column:
    """A value of a feature: a greatest value can only grow, replicates are drawn from where they are kept."""
    step = e * z
    out = F.when(e < 1e-9, v)
    if reps is not None:
        return out.when(F.coalesce(F.size(reps), F.lit(0)) > 2, F.get(reps, F.floor(u * F.size(reps)).cast("int"))).otherwise(v + step)
    return out.otherwise(v + (F.abs(step) if op == "max" else step))


def judge(spark: SparkSession, extras: list[str], queries: list[Query], told: dict[str, Estimate], predict: Predict, draws: int, influence: str, constraint: str, target: float, classifier: bool) -> Callable[[DataFrame], DataFrame]:
    """A function that adds pred_value, pred_error, pred_conf, pred_var and the influence of each query to a state, all from one set of draws.

    Matrices come from one low-discrepancy sequence, the same for every request and round, held in a table of ``draws`` rows that is
    broadcast. All variants of a request are scored by the model in one go; the rows of a request never leave its partition.
    """
    names, d, g = list(told), len(told), len(queries)
    post = {n: f for q in queries for n, f in q.spec.post.items()}
    sobol, stepped = influence in ("sobol", "total"), influence.startswith("previous")
    needed = [t for n in names for e in [told[n]] for t in [e.value.alias(f"v_{n}"), e.error.alias(f"e_{n}")] + ([e.reps.alias(f"r_{n}")] if e.reps is not None else []) + ([e.value_b.alias(f"vb_{n}"), e.error_b.alias(f"eb_{n}")] if stepped else [])]
    # Twice the dimensions: the second half is for Saltelli's other matrix.
    table = spark.createDataFrame(list(base(draws, 2 * d)), "_i int, _z array<double>, _u array<double>")
    each = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_i")
    reps = {n: F.col(f"r_{n}") if told[n].reps is not None else None for n in names}
    from_a = {n: drawn(F.col(f"v_{n}"), F.col(f"e_{n}"), told[n].op, reps[n], F.col("_z")[j], F.col("_u")[j]) for j, n in enumerate(names)}
    from_b = {n: drawn(F.col(f"v_{n}"), F.col(f"e_{n}"), told[n].op, reps[n], F.col("_z")[j + d], F.col("_u")[j + d]) for j, n in enumerate(names)}
    variants: list[dict] = [{}]
    if sobol:
        other = from_b
        variants += [{n for n in names if told[n].query == q.j} for q in queries] + [set(names)]
    elif stepped:
        other = {n: drawn(F.col(f"vb_{n}"), F.col(f"eb_{n}"), told[n].op, None, F.col("_z")[j], F.col("_u")[j]) for j, n in enumerate(names)}
        variants += [{n for n in names if told[n].query == q.j} for q in queries]
    else:
        other = {n: F.col(f"v_{n}") for n in names}
        variants += [{n} for n in names] if influence == "features" else [{n for n in names if told[n].query == q.j} for q in queries]
    plain = ["req_id", "_i", *[c[2:] for c in extras], *[from_a[n].alias(f"_a_{n}") for n in names], *[other[n].alias(f"_o_{n}") for n in names]]
    done = lambda n, x: post[n](x) if n in post else x
    rows = F.array(*[F.struct(*[done(n, F.col(f"{'_o' if n in v else '_a'}_{n}")).alias(n) for n in names]) for v in variants])
    stacked = F.posexplode(rows).alias("_k", "_x")
    listed = F.sort_array(F.collect_list(F.struct("_k", "_i", "pred"))).alias("_p")
    slices = [F.transform(F.slice("_p", 1 + k * draws, draws), lambda x: x["pred"]).alias(f"_p{k}") for k in range(len(variants))]
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y) / F.size(a)

    def measures(a: Column) -> Column:
        """(value, error, conf, var) of the predictions of one variant."""
        centre = mean(a)
        if classifier:  # the most frequent class, the smallest of equally frequent ones
            counted = F.transform(F.array_distinct(a), lambda c: F.struct((-F.size(F.filter(a, lambda y: y == c))).alias("n"), c.alias("c")))
            centre = F.array_min(counted)["c"]

        def around(c: Column, mu: Column) -> Column:
            var = mean(F.transform(a, lambda y: (y - mu) * (y - mu)))
            gap = lambda y: F.abs(y - c) / (F.greatest(F.abs(c), F.lit(1e-9)) if constraint == "relative_error" else F.lit(1.0))
            if constraint == "conf":
                sorted_ = F.array_sort(F.transform(a, gap))
                at = (F.size(a) - 1) * F.lit(float(target))
                lo, hi = (F.get(sorted_, end(at).cast("int")) for end in (F.floor, F.ceil))
                error, conf = lo + (hi - lo) * (at - F.floor(at)), F.lit(float(target))
            else:
                error, conf = F.lit(float(target)), F.size(F.filter(a, lambda y: gap(y) <= target + 1e-9)) / F.size(a)
            return F.struct(c.alias("value"), error.cast("double").alias("error"), conf.cast("double").alias("conf"), var.alias("var"), mu.alias("mu"))

        return P.let(F.struct(centre.alias("c"), mean(a).alias("mu")), lambda m: around(m["c"], m["mu"]))

    first = F.concat("_p0", f"_p{g + 1}") if sobol else F.col("_p0")
    judged = measures(first).alias("_m")
    if sobol:
        mu, var = F.col("_m.mu"), F.col("_m.var")
        pair = lambda k: F.zip_with(F.arrays_zip(F.col("_p0").alias("a"), F.col(f"_p{g + 1}").alias("b")), F.col(f"_p{k}"), lambda x, c: (x["a"] - c) * (x["a"] - c) * 0.5 if influence == "total" else (x["b"] - mu) * (c - x["a"]))
        gains = {f"inf_{q.j}": F.when(var < 1e-18, 1e-9).otherwise(mean(pair(k)) / var) for k, q in enumerate(queries, 1)}
    else:
        good = (lambda m: -m["var"]) if "variance" in influence else (lambda m: -m["error"]) if constraint == "conf" else (lambda m: m["conf"])
        sign = -1 if stepped else 1  # what was gained by the last step
        gain = [sign * (good(measures(F.col(f"_p{k}"))) - good(F.col("_m"))) for k in range(1, len(variants))]
        if influence == "features":
            gains = {f"inf_{q.j}": reduce(add, [x for x, n in zip(gain, names) if told[n].query == q.j]) for q in queries}
        else:
            gains = {f"inf_{q.j}": x for q, x in zip(queries, gain)}
    results = [F.col(f"_m.{x}").alias(f"pred_{x}") for x in ("value", "error", "conf", "var")] + [x.alias(n) for n, x in gains.items()]
    own = [F.col(c).alias(c[2:]) for c in extras]

    def run(state: DataFrame, requests: int = 1) -> DataFrame:
        # A few small rows become many: dealt to as many tasks as their draws are worth, where they stay until they are added up.
        most = max(48, int(spark.conf.get("spark.sql.shuffle.partitions")))
        tasks = min(most, 1 + requests * draws * len(variants) // DRAWS_A_TASK)
        features = state.select("req_id", *own, *needed).repartition(tasks, "req_id").select("*", each).join(F.broadcast(table), "_i")
        wide = features.select(*plain).select("req_id", "_i", *[c[2:] for c in extras], stacked).select("req_id", "_i", "_k", *[c[2:] for c in extras], "_x.*")
        preds = predict(wide).groupBy("req_id").agg(listed).select("req_id", *slices).select("*", judged).select("req_id", *results)
        return state.join(preds, "req_id")

    return run


def _steps(policy: str, k: int, alpha: int, beta: int, n: int) -> tuple[str, int]:
    """The rule, and the steps of round ``k`` (for uniform rules by query, else in all)."""
    each = beta if beta else step_size(0, k, n)
    rule = {"uniformexpbatch": "uniform", "optimizerexpbatch": "optimizer", "optimizerexpinit": "optimizer"}.get(policy, policy)
    each = {"uniformexpbatch": each * 2**k, "optimizerexpbatch": each * 2**k, "optimizerexpinit": alpha * 2 ** (k - 1)}.get(policy, each)
    return rule, each if rule == "uniform" or not beta else each * n


def exact_job(requests: DataFrame, specs: list[FeatureSpec], predict: Predict, extra: DataFrame | None = None) -> DataFrame:
    """(req_id, pred_value) of every request from all rows, in one plan; a missing feature of ``extra`` (req_id, features) counts as 0."""
    features = assemble(requests, specs)
    if extra is not None:
        features = features.join(extra, "req_id", "left")
    return predict(features.fillna(MISSING)).select("req_id", F.col("pred").alias("pred_value"))


def progressive_job(
    requests: DataFrame, specs: list[FeatureSpec], predict: Predict, *, max_error: float | None = None, min_conf: float | None = None, max_relative_error: float | None = None, max_pvar: float | None = None,
    constraint: str = "error", policy: str | Callable[[P.Round], Column] = "optimizer", influence: str = "sobol", min_card: bool = False, costs: dict[str, float] | None = None, tsizes: dict[str, int] | None = None,
    extra: DataFrame | None = None, classifier: bool = False, alpha: int = 10, beta: int = 10, ncfgs: int = 100, draws: int = 64, max_rounds: int = 20,
    replicates: int = 50, draw_replicates: bool = False, bootstrap_all: bool = False, correction: str | None = None, limit: int = B.LIMIT, seed: int = 0,
) -> DataFrame:
    """(req_id, pred_value, pred_error, pred_conf, pred_var, rounds, qsample, met, trace, shares): every request once, by rounds on those still open.

    Specifications with facts that have a ``pid`` (0 to ncfgs - 1, stored by it) and known aggregates are read by pids; all others, and
    ``extra`` (req_id, features), count as exact. A request without matching rows gets its default, unknown until all is read; a missing exact feature
    counts as 0. Names of features are unique; a query goes by its first feature in ``costs`` (a step's price) and ``tsizes`` (rows of its
    facts; counted where not given).

    ``constraint``: "error" (conf is the share of draws within max_error of the prediction), "relative_error" (within max_relative_error of it),
    "conf" (error is the quantile of deviations at min_conf). A request is done when all targets that are set hold, when its prediction is
    exact, or when all is read; ``met`` says whether the targets hold, or all is read: after ``max_rounds`` it may not. ``policy`` is a name in
    ``policies.POLICIES``, one of its growing forms, or a function of a Round; ``min_card`` lets queries of few rows jump first. ``influence``:
    see INFLUENCES. Errors of order statistics and distinct counts come from ``replicates`` resamples, those of all aggregates if ``bootstrap_all``
    (req_id is a long then); ``draw_replicates`` draws from them instead of a normal distribution. Requests that end with everything read
    take these features from the exact job. The driver sees three numbers for each query and how many requests are open.
    """
    gran = round(1 / ncfgs, 6)
    queries = [_query(j, s, bootstrap_all) for j, s in enumerate(s for s in specs if sampled(s))]
    if influence not in INFLUENCES:
        raise ValueError(f"unknown influence: {influence}")
    others = [s for s in specs if not sampled(s)]
    if not queries:
        out = exact_job(requests, specs, predict, extra)
        return out.select("req_id", "pred_value", F.lit(0.0).alias("pred_error"), F.lit(1.0).alias("pred_conf"), F.lit(0.0).alias("pred_var"), F.lit(0).alias("rounds"), F.lit(1.0).alias("qsample"), F.lit(True).alias("met"), F.lit("").alias("trace"), F.array().cast("array<double>").alias("shares"))
    name = {q.j: next(iter(q.features)) for q in queries}
    previous = influence.startswith("previous")
    counted: dict = {}
    for q in queries:
        if name[q.j] not in (tsizes or {}) and q.source[0] not in counted:
            counted[q.source[0]] = q.spec.facts.count()
    sizes = {q.j: tsizes[name[q.j]] if name[q.j] in (tsizes or {}) else counted[q.source[0]] for q in queries}
    sources: dict = {}
    for q in queries:
        sources.setdefault(q.source, []).append(q)
    # Windows with many matches are sampled as slices, and told anew of all pids read; others keep the states of their resamples.
    spans = {s: S.stretch(requests, of[0].spec.facts, of[0].spec.keys, of[0].spec.width) for s, of in sources.items() if of[0].spec.kind == "trailing" and not previous}
    narrow = [s for s in spans if spans[s]]
    boot = [q for q in queries if q.asked and q.source not in narrow]
    anew = [f"{c}_{q.j}" for q in queries if q.asked and q.source in narrow for c in ("rn", "rv", "re", "rr")]

    keys = list(dict.fromkeys(k for q in queries for k in q.spec.keys))
    start = requests.select("req_id", *(["req_ts"] if "req_ts" in requests.columns else []), *[F.col(k).alias(f"k_{k}") for k in keys])
    known = assemble(requests, others) if others else requests.select("req_id")
    if extra is not None:
        known = known.join(extra, "req_id", "left")
    known = known.select("req_id", *[F.coalesce(F.col(c).cast("double"), F.lit(MISSING)).alias(f"x_{c}") for c in known.columns if c != "req_id"])
    none = F.lit(None).cast("double")
    fresh = {f"qs_{q.j}": F.lit(0.0) for q in queries} | {f"qn_{q.j}": F.lit(min(1.0, alpha * gran)) for q in queries}
    fresh |= {c: F.lit(0).cast("long") if c.split("_")[0] in ("n", "rows") else F.lit(0.0) if how == "sum" else none for c, how in _all_parts(queries)}
    fresh |= {f"st_{q.j}": F.lit(None).cast(f"array<{B.STATE_DDL}>") for q in boot}
    fresh |= {c: F.lit(None).cast("array<array<double>>" if c.startswith("rr") else "array<double>") for c in anew}
    plan = materialize(start.join(known, "req_id").withColumns(fresh | {"x__trace": F.array().cast("array<string>")}))
    done, n = None, len(queries)
    # What every round does, as columns that are made once.
    extras = [c for c in plan.columns if c.startswith("x_") and c != "x__trace"]
    told = estimates(queries, sizes, draw_replicates, previous)
    target = {"error": max_error, "relative_error": max_relative_error, "conf": min_conf}[constraint]
    judged = judge(plan.sparkSession, extras, queries, told, predict, draws, influence, constraint, target, classifier)
    aggs = {s: partials(of, previous) for s, of in sources.items() if s not in narrow}
    merge = merging(queries, [c for c in plan.columns if c in ("req_id", "req_ts") or c.startswith(("x_", "k_", "st_"))], previous, anew)
    before = {f"qp_{q.j}": F.when(F.col(f"qs_{q.j}") > F.col(f"qb_{q.j}"), F.greatest(F.col(f"qs_{q.j}") - gran, F.lit(gran))).otherwise(F.col(f"qs_{q.j}")) for q in queries} if previous else {}
    least = F.least(*[F.col(f"qs_{q.j}") for q in queries], F.lit(1.0))
    goals = {"max_error": max_error, "min_conf": min_conf, "max_pvar": max_pvar} | ({"max_relative_error": max_relative_error} if constraint != "relative_error" else {})
    shares = F.array(*[F.col(f"qs_{q.j}") for q in queries])
    trace = F.concat("x__trace", F.array(F.concat_ws(",", *[F.format_number(F.col(f"qs_{q.j}"), 2) for q in queries])))
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"qs_{q.j}").alias("share"), F.coalesce(F.col(f"inf_{q.j}"), F.lit(0.0)).alias("inf"), F.lit(float((costs or {}).get(name[q.j], 1.0))).alias("weight"), F.when(F.col(f"rows_{q.j}") > 0, F.col(f"rows_{q.j}") / F.col(f"qs_{q.j}")).alias("card")) for i, q in enumerate(queries)])
    rule = _steps(policy, 1, alpha, beta, n)[0] if isinstance(policy, str) else policy
    given = P.Round(F.col("_q"), F.col("_steps"), gran, F.col("pred_var"), F.col("pred_conf"), F.col("req_id"))
    nexts = (P.POLICIES[rule] if isinstance(rule, str) else rule)(given)
    nexts = P.min_card(given, nexts) if min_card else nexts
    raised = {f"qn_{q.j}": F.greatest(F.get("_n", F.lit(i)), F.col(f"qs_{q.j}")) for i, q in enumerate(queries)}
    mean = F.aggregate("_shares", F.lit(0.0), lambda s, x: s + x) / n
    for k in range(1, max_rounds + 1):
        last = [F.max(F.when(F.col(f"qn_{q.j}") < 1 - 1e-9, F.col(f"qn_{q.j}"))).alias(f"part_{q.j}") for q in queries]
        at = plan.agg(*[f(F.col(f"{c}_{q.j}")).alias(f"{c}_{q.j}") for q in queries for f, c in ((F.min, "qs"), (F.max, "qn"))], *last, F.count(F.lit(1)).alias("open")).first()
        ends = {q.j: (round((at[f"qs_{q.j}"] or 0) * ncfgs), round((at[f"qn_{q.j}"] or 0) * ncfgs)) for q in queries}
        parts = {q.j: round((at[f"part_{q.j}"] or 0) * ncfgs) for q in queries}
        mets = {s: matched(plan, of, ncfgs, ends) for s, of in sources.items() if s not in narrow}
        slices = [S.sampled(plan, sources[s], spans[s], ncfgs, ends, parts, replicates, draw_replicates, correction, seed) for s in narrow]
        state = merged(plan, [*[mets[s].groupBy("req_id").agg(*aggs[s]) for s in mets], *slices], merge)
        if narrow:  # both the draws and the next plan are made of it, and slices would be told once for each; it is small by its file, but not in the driver
            state = materialize(state).hint("merge")
        for q in boot:
            state = resampled(state, mets[q.source], q, gran, replicates, limit, draw_replicates, correction, seed)
        rows = judged(state.withColumns(before) if previous else state, at["open"])
        rows = finished(rows.withColumn("min_qsample", F.when(least >= 1 - 1e-9, 1.0).otherwise(least)), **goals).withColumnRenamed("done", "met")
        steps = _steps(policy, k, alpha, beta, n)[1] if isinstance(policy, str) else beta * n
        rows = rows.withColumns({"x__trace": trace, "_q": asked, "_steps": F.lit(steps).cast("long"), "_shares": shares}).withColumn("_n", nexts).withColumns(raised)
        carried = [*plan.columns, "pred_value", "pred_error", "pred_conf", "pred_var", "met", "_shares"]
        rows = materialize(rows.select(*carried))
        ready = rows if k == max_rounds else rows.filter("met")
        ready = ready.select("req_id", "pred_value", "pred_error", "pred_conf", "pred_var", F.lit(k).alias("rounds"), mean.alias("qsample"), "met", F.array_join("x__trace", " ").alias("trace"), F.col("_shares").alias("shares"))
        done = ready if done is None else done.unionByName(ready)
        plan = rows.filter(~F.col("met")).select(*plan.columns)
        if k == max_rounds or plan.isEmpty():
            break
    return _whole_ones_exact(done, requests, specs, extra, predict) if boot or anew else done


def _whole_ones_exact(done: DataFrame, requests: DataFrame, specs: list[FeatureSpec], extra: DataFrame | None, predict: Predict) -> DataFrame:
    """Requests that have read all of everything take their prediction from the exact job, as states may have been thinned."""
    whole = done.filter(F.forall("shares", lambda x: x >= 1 - 1e-9)).select("req_id")
    exact = exact_job(requests.join(whole, "req_id", "left_semi"), specs, predict, extra).withColumnRenamed("pred_value", "_exact")
    return done.join(exact, "req_id", "left").withColumn("pred_value", F.coalesce("_exact", "pred_value")).drop("_exact")


def _as_specs(facts: DataFrame, queries: dict[str, tuple[str, str]]) -> list[FeatureSpec]:
    keyed = facts.withColumn("_key", F.col("req_id"))
    return [FeatureSpec("group", {q: f}, keyed, ["_key"]) for q, f in queries.items()]


def _with_key(facts: DataFrame, requests: DataFrame | None) -> DataFrame:
    base = facts.select("req_id").distinct() if requests is None else requests
    return base.withColumn("_key", F.col("req_id"))


def exact_predictions(facts: DataFrame, queries: dict[str, tuple[str, str]], predict: Predict, extra: DataFrame | None = None, requests: DataFrame | None = None) -> DataFrame:
    """(req_id, pred_value) from all rows of facts that are keyed by request; of ``requests``, or else of those that have facts."""
    spec = FeatureSpec("group", dict(queries), facts.withColumn("_key", F.col("req_id")), ["_key"])
    return exact_job(_with_key(facts, requests), [spec], predict, extra)


def progressive_predictions(facts: DataFrame, queries: dict[str, tuple[str, str]], predict: Predict, *, tsize: int, requests: DataFrame | None = None, **settings) -> DataFrame:
    """``progressive_job`` over facts that are keyed by request (req_id, pid, columns): one query for each feature (aggregate, column)."""
    out = progressive_job(_with_key(facts, requests), _as_specs(facts, queries), predict, tsizes=dict.fromkeys(queries, tsize), **settings)
    return out.drop("shares")
