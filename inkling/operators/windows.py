"""Aggregates over ranges of time without the matches of requests and facts.

The facts of a key get their rank in time; a request's window is then a range of ranks, found by counting. Partials of a tree over the ranks
(16 facts, 256, ... under a node) give sums, moments, least and greatest values: a range is a few nodes a level. Distinct values are the facts
of the range whose value was last seen before it, counted node by node. A quantile is found digit by digit in the rank
by value: counts of the next digit in the range tell where to go. All of it is joins on nodes and running counts over range partitions, so
rows follow requests and facts (times the levels of the tree), and no hot key is one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from inkling.operators import matching as J
from inkling.operators import ordered as O
from inkling.operators.exact import ALIASES, aggregate
from inkling.operators.ranges import previous, row_numbers
from inkling.sources.storage import materialize

FAN = 16

QUANTILES = {"median": 0.5, "percentile90": 0.9, "percentile99": 0.99}
MOMENTS = ("count", "sum", "avg", "varPop", "stdPop", "varSamp", "stdSamp", "min", "max")
OPERATORS = (*MOMENTS, "unique", *QUANTILES)


def known(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def levels(facts: int) -> int:
    """Digits to base ``FAN`` of the ranks of so many facts."""
    n = 1
    while FAN**n < facts:
        n += 1
    return n


def ranked(facts: DataFrame, keys: list[str]) -> DataFrame:
    """``facts`` with _r, their rank from 0 in their key by ts; written once, as facts of one time may stand either way."""
    rows = row_numbers(facts, keys, ["ts"], "_r")
    return materialize(rows.withColumn("_r", F.col("_r").cast("long") - 1))


def positions(requests: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``requests`` (req_id, keys, _lo, _hi) with _a and _b: the ranks that lie in [_lo, _hi) are those in [_a, _b)."""
    ends = requests.select(*keys, F.explode(F.array(*[F.struct(F.struct(F.col("req_id").alias("id"), F.lit(w).alias("end")).alias("req_id"), F.col(c).alias("req_ts")) for w, c in ((0, "_lo"), (1, "_hi"))])).alias("_e")).select(*keys, "_e.*")
    below = J.expanding(ends, facts.select(*keys, "ts"), keys, {"n": F.col("_fact")})
    at = lambda w: F.coalesce(F.max(F.when(F.col("req_id.end") == w, F.col("n"))), F.lit(0)).cast("long")
    both = below.groupBy(F.col("req_id.id").alias("req_id")).agg(at(0).alias("_a"), at(1).alias("_b"))
    return materialize(requests.select("req_id", *keys).join(both.filter("_b > _a"), "req_id"))


def _between(a: Column, b: Column) -> Column:
    return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))


def nodes_of(ranges: DataFrame, top: int) -> DataFrame:
    """``ranges`` (_a, _b) by the nodes (_l, _i) that make them up: whole ones, the largest that fit, on either side."""
    ceil = lambda x, n: F.floor((x + (n - 1)) / F.lit(n)).cast("long")
    floor = lambda x, n: F.floor(x / F.lit(n)).cast("long")

    def at_level(here: Column, lv: int) -> Column:
        return F.transform(here, lambda i: F.struct(F.lit(lv).alias("_l"), i.alias("_i")))

    parts = []
    for lv in range(top + 1):
        a, b = ceil(F.col("_a"), FAN**lv), floor(F.col("_b"), FAN**lv)
        up, down = ceil(F.col("_a"), FAN ** (lv + 1)) * FAN, floor(F.col("_b"), FAN ** (lv + 1)) * FAN
        whole = F.lit(lv == top) | (up > down)
        here = F.when(a > b, F.array().cast("array<bigint>")).when(whole, _between(a, b)).otherwise(F.concat(_between(a, up), _between(down, b)))
        parts.append(at_level(here, lv))
    return ranges.withColumn("_node", F.explode(F.concat(*parts))).select("*", "_node._l", "_node._i").drop("_node")


def _tree(rows: DataFrame, keys: list[str], columns: list[str], centres: dict[str, float], top: int) -> DataFrame:
    """Partials (rows, sum, sum of squares, least, greatest) of every node; squares are taken around a centre, so that little cancels."""
    parts = {"n": F.sum, "s": F.sum, "q": F.sum, "lo": F.min, "hi": F.max}
    names = {f"_{p}_{c}": f for c in columns for p, f in parts.items()}

    def first(c):
        x = F.col(c).cast("double")
        return [F.col(c).isNotNull().cast("long").alias(f"_n_{c}"), (x - centres[c]).alias(f"_s_{c}"), ((x - centres[c]) * (x - centres[c])).alias(f"_q_{c}"), x.alias(f"_lo_{c}"), x.alias(f"_hi_{c}")]

    level = rows.select(*keys, F.col("_r").alias("_i"), *[x for c in columns for x in first(c)])
    out = level.withColumn("_l", F.lit(0))
    for lv in range(1, top + 1):
        level = level.groupBy(*keys, F.floor(F.col("_i") / FAN).cast("long").alias("_i")).agg(*[f(n).alias(n) for n, f in names.items()])
        if lv == 1:
            level = materialize(level)
        out = out.unionByName(level.withColumn("_l", F.lit(lv)))
    return out


def _moments(rows: DataFrame, nodes: DataFrame, keys: list[str], features: dict[str, tuple[str, str]], top: int) -> DataFrame:
    columns = sorted({c for _, c in features.values()})
    # Only counts are asked of columns that are no numbers.
    numbers = rows.select(*keys, "_r", *[F.col(c) if rows.schema[c].dataType.typeName() != "string" else F.when(F.col(c).isNotNull(), 0.0).alias(c) for c in columns])
    means = numbers.agg(*[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in columns]).first()  # one row
    tree = _tree(numbers, keys, columns, means.asDict(), top)
    # Spark takes nodes for as few bytes as the ranges that they are made of, and would send all of them to the driver.
    met = nodes.select("req_id", *keys, "_l", "_i").hint("merge").join(tree, [*keys, "_l", "_i"])
    told = met.groupBy("req_id").agg(*[f(f"_{p}_{c}").alias(f"_{p}_{c}") for c in columns for p, f in (("n", F.sum), ("s", F.sum), ("q", F.sum), ("lo", F.min), ("hi", F.max))])

    def value(op, c):
        n, s, q = (F.col(f"_{p}_{c}") for p in "nsq")
        some = F.when(n > 0, n)
        m2 = F.greatest(F.lit(0.0), q - s * s / some)
        by = {"count": lambda: n, "sum": lambda: F.when(n > 0, s + n * means[c]), "avg": lambda: s / some + means[c], "min": lambda: F.col(f"_lo_{c}"), "max": lambda: F.col(f"_hi_{c}"), "varPop": lambda: m2 / some, "stdPop": lambda: F.sqrt(m2 / some), "varSamp": lambda: m2 / F.when(n > 1, n - 1), "stdSamp": lambda: F.sqrt(m2 / F.when(n > 1, n - 1))}
        return by[op]().cast("double")

    return told.select("req_id", *[value(op, c).alias(n) for n, (op, c) in features.items()])


def _distinct(rows: DataFrame, nodes: DataFrame, keys: list[str], column: str, name: str, top: int) -> DataFrame:
    """Facts of the range whose value last came before its begin."""
    seen = previous(rows.filter(F.col(column).isNotNull()).select(*keys, column, "_r"), [*keys, column], ["_r"], "_r", "_was")
    each = seen.select(*keys, F.coalesce("_was", F.lit(-1).cast("long")).alias("ts"), F.posexplode(F.array(*[F.floor(F.col("_r") / F.lit(FAN**lv)).cast("long") for lv in range(top + 1)])).alias("_l", "_i"))
    asked = nodes.select(*keys, "_l", "_i", "req_id", F.col("_a").alias("req_ts"))
    counted = J.expanding(asked, each, [*keys, "_l", "_i"], {"n": F.col("_fact")})
    return counted.groupBy("req_id").agg(F.sum("n").cast("double").alias(name))


def _ranks(facts: DataFrame, requests: DataFrame, keys: list[str], column: str, asked: dict[str, float]) -> DataFrame:
    """Interpolated quantiles by name: the ranks around them are looked for digit by digit."""
    rows = ranked(facts.filter(F.col(column).isNotNull()).select(*keys, "ts", column), keys)
    rows = materialize(row_numbers(rows, keys, [column, "_r"], "_v").withColumn("_v", F.col("_v").cast("long") - 1))
    ranges = positions(requests, rows, keys)
    digits = levels((rows.agg(F.max("_v")).first()[0] or 0) + 1)  # one number
    at = {n: (F.col("_b") - F.col("_a") - 1) * F.lit(float(p)) for n, p in asked.items()}
    wants = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(e).alias("end"), f(x).cast("long").alias("k")) for n, x in at.items() for e, f in enumerate((F.floor, F.ceil))])
    state = ranges.withColumn("_w", F.explode(wants)).select(*keys, F.struct("req_id", "_w.name", "_w.end").alias("req_id"), "_a", "_b", F.col("_w.k").alias("_k"), F.lit(0).cast("long").alias("_node"))
    for d in range(digits):
        unit = FAN ** (digits - d - 1)
        facts_at = rows.select(*keys, F.floor(F.col("_v") / F.lit(unit * FAN)).cast("long").alias("_node"), F.col("_r").alias("ts"), (F.floor(F.col("_v") / F.lit(unit)) % FAN).cast("int").alias("_d"))
        ends = state.select(*keys, "_node", F.explode(F.array(*[F.struct(F.struct(F.col("req_id").alias("id"), F.lit(s).alias("sign")).alias("req_id"), F.col(c).alias("req_ts")) for s, c in ((-1, "_a"), (1, "_b"))])).alias("_e")).select(*keys, "_node", "_e.*")
        below = J.expanding(ends, facts_at, [*keys, "_node"], {f"_c{x}": (F.col("_d") == x).cast("long") for x in range(FAN)}, values=["_d"])
        inside = below.groupBy(F.col("req_id.id").alias("req_id")).agg(F.array(*[F.sum(F.col("req_id.sign") * F.coalesce(f"_c{x}", F.lit(0))) for x in range(FAN)]).alias("_n"))
        runs = F.transform(F.sequence(F.lit(0), F.lit(FAN)), lambda j: F.aggregate(F.slice("_n", F.lit(1), j), F.lit(0).cast("long"), lambda s, x: s + x))
        moved = state.join(inside, "req_id").withColumn("_runs", runs)
        digit = F.size(F.filter("_runs", lambda x: x <= F.col("_k"))) - 1
        moved = moved.withColumn("_digit", digit).withColumn("_k", F.col("_k") - F.get("_runs", F.col("_digit")))
        state = materialize(moved.select(*keys, "req_id", "_a", "_b", "_k", (F.col("_node") * FAN + F.col("_digit")).alias("_node")))
    found = state.join(rows.select(*keys, F.col("_v").alias("_node"), F.col(column).cast("double").alias("_x")), [*keys, "_node"])

    def value(n):
        lo, hi = (F.max(F.when((F.col("req_id.name") == n) & (F.col("req_id.end") == e), F.col("_x"))) for e in (0, 1))
        size = F.max(F.col("_b") - F.col("_a")) - 1
        over = size * F.lit(float(asked[n])) - F.floor(size * F.lit(float(asked[n])))
        return (lo * (1 - over) + hi * over).alias(n)

    return found.groupBy(F.col("req_id.req_id").alias("req_id")).agg(*[value(n) for n in asked])


def range_features(requests: DataFrame, facts: DataFrame, keys: list[str], features: dict[str, tuple[str, str]]) -> DataFrame:
    """(req_id, features): aggregates (``OPERATORS``) of the facts (keys, integer ts, columns) in [_lo, _hi) of the same keys, for requests
    (req_id, keys, _lo, _hi) that have any fact there. Facts without a time and null keys take no part."""
    features = {n: (ALIASES.get(op, op), c) for n, (op, c) in features.items()}
    requests = known(requests, ["_lo", "_hi", *keys]).filter("_lo < _hi").select("req_id", *keys, "_lo", "_hi")
    facts = known(facts, ["ts", *keys]).select(*keys, "ts", *sorted({c for _, c in features.values()}))
    rows = ranked(facts, keys)
    top = levels((rows.agg(F.max("_r")).first()[0] or 0) + 1)  # one number
    ranges = positions(requests, rows, keys)
    nodes = nodes_of(ranges, top)
    out = ranges.select("req_id")
    moments = {n: f for n, f in features.items() if f[0] in MOMENTS}
    if moments:
        out = out.join(_moments(rows, nodes, keys, moments, top), "req_id", "left")
    for n, (op, c) in features.items():
        if op == "unique":
            out = out.join(_distinct(rows, nodes, keys, c, n, top), "req_id", "left").fillna(0.0, [n])
    for c in sorted({c for op, c in features.values() if op in QUANTILES}):
        asked = {n: QUANTILES[op] for n, (op, x) in features.items() if op in QUANTILES and x == c}
        out = out.join(_ranks(facts, requests, keys, c, asked), "req_id", "left")
    return out


#: Matches for each request and fact up to which they are simply made.
FEW = 4


#: Facts of a key in two buckets up to which they are gathered in one group, and matches that make a group worth its overhead.
GATHERED, DENSE = 8_000_000, 1000


def matches(requests: DataFrame, facts: DataFrame, keys: list[str], width: int | None) -> Row:
    """How many pairs (``made``) requests (keys, _lo, _hi at most ``width`` later) and facts of equal keys and near times make, for how many rows
    (``size``), in how many ``groups`` of a key and bucket, and the facts of the ``largest``.

    Counts by key and bucket are multiplied; four numbers come to the driver.
    """
    bucket = lambda t: F.floor(F.col(t) / width).cast("long") if width else F.lit(0).cast("long")
    left = requests.groupBy(*keys, bucket("_lo").alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("_q"))
    right = facts.groupBy(*keys, bucket("ts").alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("_f"))
    near = F.explode(F.array("_b", F.col("_b") + 1)) if width else F.col("_b")
    none = F.lit(0.0)
    made = left.withColumn("_b", near).join(right, [*keys, "_b"]).agg(F.sum(F.col("_q") * F.col("_f")).alias("made"), none.alias("size"), none.alias("groups"), none.alias("largest"))
    asked = left.agg(none.alias("made"), F.sum("_q").alias("size"), F.count(F.lit(1)).cast("double").alias("groups"), none.alias("largest"))
    there = right.agg(none.alias("made"), F.sum("_f").alias("size"), F.count(F.lit(1)).cast("double").alias("groups"), F.max("_f").alias("largest"))
    total = made.unionAll(asked).unionAll(there)
    return total.agg(*[F.coalesce(f(c), none).alias(c) for c, f in (("made", F.sum), ("size", F.sum), ("groups", F.sum), ("largest", F.max))]).first()


def few_matches(m: Row) -> bool:
    return m.made <= FEW * max(m["size"], 1000.0)


def gatherable(m: Row) -> bool:
    """Whether groups of a key and bucket are small enough for one task, and full enough to be worth a call."""
    return 2 * m.largest <= GATHERED and m.made >= DENSE * m.groups


def _of_slices(ops: dict[str, str], x: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """By name, what aggregates (counts and distinct values apart) tell of the numbers x[a:b]; something for empty slices too."""
    out = {}
    if any(op in MOMENTS for op in ops.values()):
        n, s, q, lo, hi = O.moments(x, a, b)
        with np.errstate(invalid="ignore", divide="ignore"):
            by = {"sum": s, "avg": s / n, "min": lo, "max": hi, "varPop": q / n, "stdPop": np.sqrt(q / n), "varSamp": q / (n - 1), "stdSamp": np.sqrt(q / (n - 1))}
        out |= {name: by[op] for name, op in ops.items() if op in by}
    at = {name: np.maximum(b - a - 1, 0) * QUANTILES[op] for name, op in ops.items() if op in QUANTILES}
    if at and len(x):
        values, codes = np.unique(x, return_inverse=True)
        found = values[np.minimum(O.kth(codes, a, b, np.stack([end(k).astype(np.int64) for k in at.values() for end in (np.floor, np.ceil)], 1)), len(values) - 1)]
        for i, (name, k) in enumerate(at.items()):
            lo, hi, over = found[:, 2 * i], found[:, 2 * i + 1], k - np.floor(k)
            with np.errstate(invalid="ignore"):
                out[name] = np.where(over > 0, lo * (1 - over) + hi * over, lo)
    return out


def gathered_features(requests: DataFrame, facts: DataFrame, keys: list[str], width: int, features: dict[str, tuple[str, str]]) -> DataFrame:
    """``range_features`` for windows of at most ``width`` where ``gatherable`` holds: the facts of a key and two buckets of time meet
    the requests that begin in the first; each request's window is a slice of them in order of time, so no pair is made, nor is a window looked through for each request."""
    features = {n: (ALIASES.get(op, op), c) for n, (op, c) in features.items()}
    requests = known(requests, ["_lo", "_hi", *keys]).filter("_lo < _hi")
    bucket = lambda t: F.floor(F.col(t) / width).cast("long")
    columns = sorted({c for _, c in features.values()})
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    # Of what is only counted or told apart, the values are kept as they are.
    numbers = {c: f"x{i}" for i, c in enumerate(columns) if any(x == c and op not in ("count", "unique") for op, x in features.values())}
    kept = {c: v for c, v in names.items() if any(x == c and op == "unique" for op, x in features.values())}
    flags = [F.col(c).isNotNull().alias(f"k_{v}") for c, v in names.items()]
    here = F.col("_c")
    slim = known(facts, ["ts", *keys]).withColumn("_c", bucket("ts")).select(*keys, F.explode(F.array(here, here - 1)).alias("_b"), "ts", *flags, *[F.col(c).alias(v) for c, v in kept.items()], *[F.col(c).cast("double").alias(v) for c, v in numbers.items()])
    asked = requests.select(*keys, bucket("_lo").alias("_b"), "req_id", "_lo", "_hi")
    fields = [pa.field(n, pa.float64()) for n in features]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([left.schema.field("req_id"), *fields])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        order = np.argsort(right["ts"].to_numpy(), kind="stable")
        ts = right["ts"].to_numpy()[order]
        lo, hi = (np.searchsorted(ts, left[c].to_numpy()) for c in ("_lo", "_hi"))
        some = hi > lo
        lo, hi, out = lo[some], hi[some], {}
        for c, v in names.items():
            there = right[f"k_{v}"].to_numpy()[order].astype(bool)
            at = np.r_[0, np.cumsum(there)]
            a, b = at[lo], at[hi]
            ops = {n: op for n, (op, x) in features.items() if x == c}
            told = _of_slices(ops, right[numbers[c]].to_numpy()[order][there], a, b) if c in numbers else {}
            if "unique" in ops.values():
                told |= dict.fromkeys([n for n, op in ops.items() if op == "unique"], O.different(pd.factorize(right[v].take(pa.array(order[there])).to_pandas(), use_na_sentinel=False)[0], a, b))
            told |= dict.fromkeys([n for n, op in ops.items() if op == "count"], b - a)
            for n, op in ops.items():
                least = 0 if op in ("count", "unique") else 2 if op.endswith("Samp") else 1
                out[n] = pa.array(told[n].astype(float), mask=b - a < least) if n in told else pa.nulls(len(a), pa.float64())
        return pa.Table.from_arrays([left["req_id"].filter(pa.array(some)), *[out[n] for n in features]], schema=schema)

    ddl = ", ".join([f"req_id {dict(requests.dtypes)['req_id']}", *[f"`{n}` double" for n in features]])
    by = [*keys, "_b"]
    return asked.groupBy(*by).cogroup(slim.groupBy(*by)).applyInArrow(run, ddl)


def between(requests: DataFrame, facts: DataFrame, keys: list[str], width: int | None, features: dict[str, tuple]) -> DataFrame:
    """(req_id, features as doubles) of the facts (keys, integer ts) in [_lo, _hi) of the same keys, for requests that have any.

    ``width`` is the longest window, none if they are unbounded. Where the pairs are few they are made and added up; else, and
    if all aggregates are known by name, slices of gathered facts (narrow windows) or ranges of ranks give the same without them.
    """
    slim = known(requests.select("req_id", *keys, "_lo", "_hi"), ["_lo", "_hi", *keys])
    if all(isinstance(op, str) and ALIASES.get(op, op) in OPERATORS for op, _ in features.values()):
        made = matches(slim, facts, keys, width)
        if not few_matches(made):
            return gathered_features(slim, facts, keys, width, features) if width and gatherable(made) else range_features(slim, facts, keys, features)
    if width:
        bucket = F.floor(F.col("_lo") / width).cast("long")
        met = slim.withColumn("_b", F.explode(F.array(bucket, bucket + 1))).join(facts.withColumn("_b", F.floor(F.col("ts") / width).cast("long")), [*keys, "_b"])
    else:
        met = slim.join(facts, keys)
    met = met.filter((F.col("ts") >= F.col("_lo")) & (F.col("ts") < F.col("_hi")))
    return met.groupBy("req_id").agg(*[(op(F.col(c)) if callable(op) else aggregate(op, F.col(c))).cast("double").alias(n) for n, (op, c) in features.items()])


def trailing(requests: DataFrame, facts: DataFrame, keys: list[str], width: int | None, features: dict[str, tuple], forward: bool = False) -> DataFrame:
    """``between`` for [t - width, t), for [t, t + width) if ``forward``, or for all before t without a width; t is req_ts."""
    t = F.col("req_ts")
    lo, hi = (t, t + width) if forward else (t - width if width else F.lit(-(2**62)).cast("long"), t)
    return between(requests.select("req_id", *keys, lo.alias("_lo"), hi.alias("_hi")), facts, keys, width, features)
