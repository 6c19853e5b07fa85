"""Samples of trailing windows without the matches of requests and facts: slices of gathered facts, and what their resamples tell.

The requests of a key and a stretch of time meet the facts of that stretch and of a width before it; a window is a slice of them in order of time.
Sums are differences of running sums. Order statistics of all resamples are found bit by bit in the rank by value: running sums of the
weights with a zero bit tell how many of a slice go left (a wavelet tree, of which one level is held). A value is distinct in a slice up to its
next occurrence, so, as both ends of the windows only move on, it counts for a run of requests. Work follows facts and requests, times the
bits of a rank and the replicates, once for each different end of the pids that are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkling.operators import resample as B
from inkling.operators import windows as W

#: Facts that a group may have, those that are worth a call, and matches that make a group worth its overhead: a match costs the weights
#: of all replicates.
GATHERED, FULL, DENSE = 8_000_000, 100_000, 100

#: Matches for each request and fact up to which they are simply made.
FEW = 0.4

#: Weights that are added up side by side.
SIDE = 4_000_000

#: Groups are few and full: tasks for them, whatever their bytes.
TASKS = 48


def stretch(requests: DataFrame, facts: DataFrame, keys: list[str], width: int) -> int | None:
    """Time that a group spans: some widths, so that groups are full but enough for all tasks; none where matches are few or groups too large for one task."""
    asked = W.known(requests.withColumn("_lo", F.col("req_ts") - width), ["_lo", *keys])
    m = W.matches(asked, facts, keys, width)
    groups = m.groups / 2
    some = int(max(1, min(FULL // max(2 * m.largest, 1), groups // TASKS)))
    return None if m.made <= FEW * max(m["size"], 1000.0) or 2 * m.largest > GATHERED or m.made * some < DENSE * groups else width * some


def _running(x: np.ndarray) -> np.ndarray:
    """Sums of what is before each place; wide floating-point numbers keep the differences of long sums."""
    return np.r_[np.zeros(1, np.longdouble), np.cumsum(x, dtype=np.longdouble)]


def slice_sums(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of x[a:b]; numbers that are not finite count for the slices that hold them alone."""
    at = _running(np.where(np.isfinite(x), x, 0.0))
    out = (at[b] - at[a]).astype(float)
    if not np.isfinite(x).all():
        for odd, there in ((np.nan, np.isnan(x)), (np.inf, x == np.inf), (-np.inf, x == -np.inf)):
            n = np.r_[0, np.cumsum(there)]
            with np.errstate(invalid="ignore"):
                out = np.where(n[b] > n[a], out + odd, out)
    return out


def kth(codes: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The code that is ``k``-th (replicate, slice, …) from 0 among codes[a:b], each as often as its weight ``w`` (replicate, row) says."""
    a, b = (np.broadcast_to(x[None, :, None], k.shape) for x in (a, b))
    out, rep = np.zeros(k.shape, np.int64), np.arange(len(w))[:, None, None]
    for bit in reversed(range(int(codes.max(initial=0)).bit_length())):
        zero = codes >> bit & 1 == 0
        before = np.r_[0, np.cumsum(zero)]
        run = np.zeros((len(w), len(codes) + 1), np.int64)
        np.cumsum(w * zero, axis=1, out=run[:, 1:])
        there = run[rep, b] - run[rep, a]
        left, za, zb = k < there, before[a], before[b]
        a, b = np.where(left, za, before[-1] + a - za), np.where(left, zb, before[-1] + b - zb)
        out += np.where(left, 0, 1 << bit)
        k = np.where(left, k, k - there)
        order = np.r_[np.flatnonzero(zero), np.flatnonzero(~zero)]
        codes, w = codes[order], w[:, order]
    return out


def distinct(codes: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(replicate, slice): different codes of positive weight in codes[a:b], for ``a`` and ``b`` in order."""
    here, n = np.arange(len(codes) + 1), len(a)
    opens, ends = np.searchsorted(b, here, "right"), np.searchsorted(a, here, "right")  # the slices from the first that reaches a row, to the last that has not passed it
    order, out = np.argsort(codes, kind="stable"), np.zeros((len(w), n))
    for r, x in enumerate(w):
        at = order[x[order] > 0]
        again = np.r_[np.where(codes[at[1:]] == codes[at[:-1]], opens[at[1:]], n), n][: len(at)]
        first, last = opens[at], np.minimum(ends[at], again)
        some = first < last
        out[r] = np.cumsum(np.bincount(first[some], minlength=n + 1) - np.bincount(last[some], minlength=n + 1))[:n]
    return out


def slice_told(x: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray, ops: list[str], share: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Rows with a value of each slice, and of each operator what it gives in each replicate and slice; as ``resample.told`` of the slices' states.

    ``x`` are values (NaN: none) in order of time, ``w`` their weights (replicate, row), ``a`` and ``b`` ascend.
    """
    there = ~np.isnan(x)
    at = np.r_[0, np.cumsum(there)]
    x, w, a, b = x[there] + 0.0, w[:, there], at[a], at[b]
    values, codes = np.unique(x, return_inverse=True)
    ranked = [op for op in ops if op in B.QUANTILES or op in ("min", "max")]
    moments = [op for op in ops if op not in (*ranked, "unique")]
    out = {op: np.full((len(w), len(a)), np.nan) for op in ops}
    if "unique" in ops:
        out["unique"] = distinct(codes, w, a, b)
    if len(x) == 0:
        none = np.zeros((len(w), len(a)))
        return b - a, out | {op: B.of_sums((none, none, none, none + np.inf, none - np.inf), op, share) for op in moments}
    side = max(1, SIDE // len(x))
    for lo in range(0, len(w), side):
        part = w[lo : lo + side]
        run = np.zeros((len(part), len(x) + 1), np.int64)
        np.cumsum(part, axis=1, out=run[:, 1:])
        n = run[:, b] - run[:, a]
        if ranked:
            pos = [(n - 1) * B.QUANTILES[op] if op in B.QUANTILES else n - 1 if op == "max" else 0 * n for op in ranked]
            wanted = np.stack([np.maximum(end(p), 0).astype(np.int64) for p in pos for end in (np.floor, np.ceil)], 2)
            found = values[np.minimum(kth(codes, part, a, b, wanted), len(values) - 1)]
            for i, (op, p) in enumerate(zip(ranked, pos)):
                more = p - np.floor(p)
                told = np.where(more > 0, found[:, :, 2 * i] * (1 - more) + found[:, :, 2 * i + 1] * more, found[:, :, 2 * i])
                out[op][lo : lo + side] = np.where(n > 0, told, np.nan)
        if moments:
            total, squares = (np.stack([slice_sums(y * v, a, b) for v in part]) for y in (x, x * x))
            for op in moments:
                out[op][lo : lo + side] = B.of_sums((n.astype(float), total, squares, np.full(n.shape, np.inf), np.full(n.shape, -np.inf)), op, share)
    return b - a, out


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.to_numpy(), float)


def sampled(plan: DataFrame, queries: list, span: int, ncfgs: int, ends: dict, parts: dict, replicates: int, keep: bool, correction: str | None, seed: int) -> DataFrame:
    """Of the open requests of ``plan`` with facts in their window: partials of the pids that each query has not read yet, and for queries with
    resampled features rows, values, errors and, if ``keep``, replicates (rn, rv, re, rr) of all pids up to its next end.

    The queries share their facts, keys and width; requests of ``span`` (at least a width) and a key are a group. ``ends`` has the first and last wanted pids of a query, ``parts`` the last one of those
    requests that will not have read all: what is read whole has no error, so its facts need no weights beyond.
    """
    spec = queries[0].spec
    width, keys = spec.width, [f"k_{k}" for k in spec.keys]
    facts = spec.facts if spec.condition is None else spec.facts.filter(spec.condition)
    types = {f.name: f.dataType.typeName() for f in spec.facts.schema}
    boot = [q for q in queries if q.asked]
    most = max((parts[q.j] for q in boot), default=0)
    lo, hi = 0 if boot else min(ends[q.j][0] for q in queries), max(ends[q.j][1] for q in queries)
    names = {c: f"c{i}" for i, c in enumerate(dict.fromkeys(c for q in queries for c in q.columns))}
    number = lambda c: F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(c), F.lit(2**52))) if types[c] == "string" else F.col(c)
    row = F.xxhash64(*(spec.row_key or spec.facts.columns))
    weights = [F.when(F.col("pid") < most, B.weights(row, replicates, seed).cast("array<tinyint>")).alias("_w")] if most else []
    bucket = lambda t: F.floor(t / F.lit(span)).cast("long")
    slim = W.known(facts.filter((F.col("pid") >= lo) & (F.col("pid") < hi)), ["ts", *spec.keys])
    slim = slim.select(*[F.col(k).alias(f"k_{k}") for k in spec.keys], F.col("ts").cast("long").alias("_ts"), F.col("pid").cast("int").alias("pid"), *[number(c).cast("double").alias(n) for c, n in names.items()], *weights)
    slim = slim.withColumn("_b", F.explode(F.array_distinct(F.array(bucket(F.col("_ts")), bucket(F.col("_ts") + width)))))
    at = lambda x: F.bround(x * ncfgs).cast("int")
    wants = plan.select("req_id", *keys, F.col("req_ts").cast("long").alias("_t"), bucket(F.col("req_ts")).alias("_b"), *[at(F.col(f"{x}_{q.j}")).alias(f"{n}_{q.j}") for q in queries for n, x in (("_lo", "qs"), ("_hi", "qn"))])
    wants = W.known(wants, ["_t", *keys]).filter(reduce(Column.__or__, [F.col(f"_hi_{q.j}") > F.col(f"_lo_{q.j}") for q in queries]))
    doubles, lists = pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64()))
    fields = [(f"{p}_{q.j}_{i}", pa.int64() if p == "n" else pa.float64()) for q in queries for i in range(len(q.columns)) for p in ("n", "s", "ss", "lo", "hi")] + [(f"rows_{q.j}", pa.int64()) for q in queries]
    fields += [(f"{p}_{q.j}", t) for q in boot for p, t in (("rn", doubles), ("rv", doubles), ("re", doubles), ("rr", lists))]
    tell = {q.j: (list(q.columns), q.asked) for q in queries}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([left.schema.field("req_id"), *fields])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left = left.sort_by("_t")
        order = np.argsort(right["_ts"].to_numpy(), kind="stable")
        ts, pid, t = right["_ts"].to_numpy()[order], right["pid"].to_numpy()[order], left["_t"].to_numpy()
        x = {c: _doubles(right[n])[order] for c, n in names.items()}
        known = {c: right[n].is_valid().to_numpy().astype(bool)[order] for c, n in names.items()}
        if most:
            listed = right["_w"].combine_chunks()
            place = np.cumsum(listed.is_valid().to_numpy(zero_copy_only=False))[order] - 1
            w = np.ascontiguousarray(listed.flatten().to_numpy().reshape(-1, replicates + 1).T)
        out = {n: [None] * len(t) if n[0] == "r" and n[1] != "o" else np.full(len(t), np.nan) if n.startswith(("lo_", "hi_")) else np.zeros(len(t), k.to_pandas_dtype()) for n, k in fields}
        met = np.zeros(len(t), bool)
        for j, (columns, asked) in tell.items():
            start, end = (left[f"{n}_{j}"].to_numpy() for n in ("_lo", "_hi"))
            for first, last in set(zip(start[end > start].tolist(), end[end > start].tolist())):
                those = np.flatnonzero((start == first) & (end == last))
                here = np.flatnonzero((pid >= first) & (pid < last))
                a, b = (np.searchsorted(ts[here], y) for y in (t[those] - width, t[those]))
                out[f"rows_{j}"][those] = b - a
                met[those] |= b > a
                for i, c in enumerate(columns):
                    there = np.r_[0, np.cumsum(known[c][here])]
                    y = np.where(known[c][here], 0.0 if types[c] == "string" else x[c][here], 0.0)
                    out[f"n_{j}_{i}"][those] = there[b] - there[a]
                    out[f"s_{j}_{i}"][those], out[f"ss_{j}_{i}"][those] = slice_sums(y, a, b), slice_sums(y * y, a, b)
            for last in set(end[end > start].tolist()) if asked else ():
                those = np.flatnonzero((end == last) & (end > start))
                here, full = np.flatnonzero(pid < last), last >= ncfgs
                a, b = (np.searchsorted(ts[here], y) for y in (t[those] - width, t[those]))
                mine = np.ones((1, len(here)), np.int8) if full else w[:, place[here]]
                told = {c: slice_told(x[c][here], mine, a, b, [op for k, op in asked if columns[k] == c], last / ncfgs) for c in {columns[k] for k, _ in asked}}
                each = [told[columns[k]][1][op] for k, op in asked]
                counts = np.stack([told[columns[k]][0] for k, _ in asked]).astype(float)
                for at_, r in enumerate(those):
                    if b[at_] > a[at_]:
                        reps, met[r] = [e[:, at_] for e in each], True
                        out[f"rn_{j}"][r] = counts[:, at_].tolist()
                        out[f"rv_{j}"][r] = [B.corrected(e, None if full else correction) for e in reps]
                        out[f"re_{j}"][r] = [0.0 if full else B.spread(e) for e in reps]
                        out[f"rr_{j}"][r] = [e[1:].tolist() for e in reps] if keep else []
        arrays = [pa.array(out[n], k, from_pandas=n.startswith(("lo_", "hi_"))) for n, k in fields]
        return pa.Table.from_arrays([left["req_id"], *arrays], schema=schema).filter(pa.array(met))

    kinds = {pa.int64(): "long", pa.float64(): "double", doubles: "array<double>", lists: "array<array<double>>"}
    ddl = ", ".join([f"req_id {dict(plan.dtypes)['req_id']}", *[f"{n} {kinds[k]}" for n, k in fields]])
    by = [*keys, "_b"]
    tasks = max(TASKS, int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return wants.repartition(tasks, *by).groupBy(*by).cogroup(slim.repartition(tasks, *by).groupBy(*by)).applyInArrow(run, ddl)
