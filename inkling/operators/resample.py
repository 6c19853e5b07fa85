"""Bootstrap state that merges: what each resample of the rows seen so far amounts to, in bounded memory.

A row takes part in replicate b with a Poisson(1) weight of its own, so states of disjoint rows add up, in any order and over any number of
rounds. Replicate 0 has weight 1 everywhere: it is the sample itself. A state holds five sums a replicate, and where quantiles are
asked the weights by value. Past ``limit`` values neighbours are put together in bins of at most 4 / limit of the rows: each merge
moves a quantile by that rank at most. Where distinct values are asked it keeps values by hash, and past ``limit`` those of half the
hashes, so that a count has a relative deviation of about sqrt(2 / limit).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkling.operators.estimate import POISSON_CUTS, poisson_weight

LIMIT = 512

QUANTILES = {"median": 0.5, "percentile90": 0.9, "percentile99": 0.99}

STATE_DDL = "struct<sums: binary, v: binary, w: binary, level: int, h: binary, hw: binary>"
STATE = pa.struct([("sums", pa.binary()), ("v", pa.binary()), ("w", pa.binary()), ("level", pa.int32()), ("h", pa.binary()), ("hw", pa.binary())])


def chance(seed: int, rep: Column, row: Column) -> Column:
    """A number in (0, 1) for a row (its hash) and a replicate."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), rep.cast("int"), row), 12) + F.lit(0.5)) / F.lit(float(2**52))


def weights(row: Column, replicates: int, seed: int = 0) -> Column:
    """Weight of a row in the sample (1) and in each replicate."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: chance(seed, r, row))
    # Counted up from a probability that is worked out once; most are small.
    small = lambda u: F.when(u <= POISSON_CUTS[0], 0).when(u <= POISSON_CUTS[1], 1).when(u <= POISSON_CUTS[2], 2)
    return F.concat(F.array(F.lit(1)), F.transform(drawn, lambda u: small(u).otherwise(poisson_weight(u))))


@dataclass
class State:
    """sums: rows, sum, sum of squares, least, greatest of each replicate. v, w: values and their weights; h, hw: the same by hash."""

    sums: np.ndarray
    v: np.ndarray
    w: np.ndarray
    level: int
    h: np.ndarray
    hw: np.ndarray

    def packed(self) -> dict:
        return {"sums": self.sums.tobytes(), "v": self.v.tobytes(), "w": self.w.tobytes(), "level": self.level, "h": self.h.tobytes(), "hw": self.hw.tobytes()}

    @staticmethod
    def unpacked(d: dict) -> "State":
        sums = np.frombuffer(d["sums"]).reshape(5, -1)
        get = lambda k, t: np.frombuffer(d[k], t)
        return State(sums, get("v", float), get("w", np.int64).reshape(-1, sums.shape[1]), d["level"], get("h", np.uint64), get("hw", np.int64).reshape(-1, sums.shape[1]))


def _summed(keys: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    return keys[starts], np.add.reduceat(w[order], starts, axis=0) if len(starts) else w[:0]


def _binned(v: np.ndarray, w: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring values together in bins of at most 4 / limit of the rows (about ``limit`` of them), under the value in the middle of each."""
    if len(v) <= limit:
        return v, w
    before = np.cumsum(w[:, 0]) - w[:, 0]
    bins = before * (limit // 2) // w[:, 0].sum()
    alone = w[:, 0] * (limit // 2) >= w[:, 0].sum()  # a frequent value stays what it is
    edge = np.r_[True, (bins[1:] != bins[:-1]) | alone[1:] | alone[:-1]]
    starts = np.flatnonzero(edge)
    middle = (starts + np.r_[starts[1:], len(v)] - 1) // 2
    return v[middle], np.add.reduceat(w, starts, axis=0)


def _thinned(h: np.ndarray, w: np.ndarray, level: int, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    keep = h < np.uint64(2**64 - 1 >> level)
    h, w = h[keep], w[keep]
    while len(h) > limit:
        level += 1
        keep = h < np.uint64(2**64 - 1 >> level)
        h, w = h[keep], w[keep]
    return h, w, level


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of floating-point values (the finaliser of splitmix64)."""
    z = np.where(x == 0, 0.0, x).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def of_rows(x: np.ndarray, w: np.ndarray, ranks: bool, distinct: bool, limit: int = LIMIT) -> State:
    """The state of rows with values ``x`` (NaN: none) and weights ``w`` (rows, replicates + 1)."""
    known = ~np.isnan(x)
    x, w = x[known], w[known].astype(np.int64)
    there = w > 0
    low, high = (np.where(there, x[:, None], end).min(0, initial=np.inf) if end > 0 else np.where(there, x[:, None], end).max(0, initial=-np.inf) for end in (np.inf, -np.inf))
    sums = np.stack([w.sum(0).astype(float), x @ w, (x * x) @ w, low, high]) if len(x) else np.stack([*np.zeros((3, w.shape[1])), low, high])
    none = np.empty((0, w.shape[1]), np.int64)
    v, vw = _binned(*_summed(x, w), limit) if ranks else (np.empty(0), none)
    h, hw, level = _thinned(*_summed(_mixed(x), w), 0, limit) if distinct else (np.empty(0, np.uint64), none, 0)
    return State(sums, v, vw, level, h, hw)


def merged(a: State, b: State, limit: int = LIMIT) -> State:
    sums = np.concatenate([a.sums[:3] + b.sums[:3], np.minimum(a.sums[3:4], b.sums[3:4]), np.maximum(a.sums[4:], b.sums[4:])])
    v, w = _binned(*_summed(np.r_[a.v, b.v], np.r_[a.w, b.w]), limit)
    h, hw, level = _thinned(*_summed(np.r_[a.h, b.h], np.r_[a.hw, b.hw]), max(a.level, b.level), limit)
    return State(sums, v, w, level, h, hw)


def of_sums(sums: np.ndarray, op: str, share: float) -> np.ndarray:
    """An operator from rows, sum, sum of squares, least and greatest; NaN without rows."""
    n, total, squares, low, high = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        var = np.where(n > 1, np.maximum(0.0, (squares - total * total / n) / (n - 1)), np.where(n == 1, 0.0, np.nan))
        more = np.where(n > 1, n / (n - 1), 1.0)
        some = np.where(n > 0, 1.0, np.nan)
        exact = share >= 1 - 1e-9
        by = {"count": n / share, "sum": total / share * some, "avg": total / n, "min": low * some, "max": high * some, "varSamp": var * (1 if exact else more), "varPop": var / more if exact else var}
        return by[op] if op in by else np.sqrt(by[{"stdSamp": "varSamp", "stdPop": "varPop"}[op]])


def told(s: State, op: str, share: float) -> np.ndarray:
    """What an operator gives in the sample and in each replicate; NaN without rows. Counts and sums are scaled to the whole, variances as estimates are."""
    n = s.sums[0]
    if op in QUANTILES:
        if not len(s.v):
            return np.full(len(n), np.nan)
        at, run = (n - 1) * QUANTILES[op], np.cumsum(s.w, axis=0)
        lo, hi = (s.v[np.minimum((run <= end(at)).sum(0), len(s.v) - 1)] for end in (np.floor, np.ceil))
        return np.where(n > 0, lo * (1 - (at - np.floor(at))) + hi * (at - np.floor(at)), np.nan)
    if op == "unique":
        return (s.hw > 0).sum(0) * float(2**s.level)
    return of_sums(s.sums, op, share)


def states(rows: DataFrame, ids: list[str], columns: dict[str, tuple[bool, bool]], limit: int = LIMIT) -> DataFrame:
    """(ids, states): one row for each key (``ids``: longs, ints) and task, made in one pass over ``rows`` (ids, columns as doubles, w: their weights).

    ``columns`` says of each whether quantiles and whether distinct values are asked. No row is repeated for a replicate.
    """
    schema = pa.schema([*[(i, pa.int64()) for i in ids], ("states", pa.list_(STATE))])

    def out(held):
        keys = list(held)
        return pa.RecordBatch.from_arrays([*[pa.array([k[j] for k in keys], pa.int64()) for j in range(len(ids))], pa.array([[s.packed() for s in held[k]] for k in keys], pa.list_(STATE))], schema=schema)

    def run(batches):
        held: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            w = b.column("w").flatten().to_numpy().reshape(b.num_rows, -1)
            keys, group = np.unique(np.stack([b.column(i).to_numpy() for i in ids], 1), axis=0, return_inverse=True)
            order, ends = np.argsort(group.ravel(), kind="stable"), np.cumsum(np.bincount(group.ravel()))
            values = [b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]
            for k, at in zip(map(tuple, keys.tolist()), np.split(order, ends[:-1])):
                new = [of_rows(x[at], w[at], *asked, limit) for x, asked in zip(values, columns.values())]
                held[k] = [merged(a, n, limit) for a, n in zip(held[k], new)] if k in held else new
            if len(held) > 2000:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    ddl = ", ".join([f"{i} long" for i in ids] + [f"states array<{STATE_DDL}>"])
    return rows.select(*[F.col(i).cast("long") for i in ids], *[F.col(c).cast("double") for c in columns], "w").mapInArrow(run, ddl)


def sorted_sums(rows: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """``states`` where only sums, least and greatest values are asked, of rows that come by key: all keys of a batch are added up at once."""
    schema = pa.schema([*[(i, pa.int64()) for i in ids], ("states", pa.list_(STATE))])

    def added(x, w, starts):
        there = (w > 0) & ~np.isnan(x)[:, None]
        y, w = np.where(np.isnan(x), 0.0, x)[:, None], np.where(there, w, 0).astype(float)
        with np.errstate(invalid="ignore"):
            parts = [w, np.where(there, w * y, 0.0), np.where(there, w * y * y, 0.0)]
        low, high = (np.where(there, y, end) for end in (np.inf, -np.inf))
        return np.stack([*[np.add.reduceat(p, starts, axis=0) for p in parts], np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0)], 1)

    def packed(sums):
        none = b""
        return {"sums": sums.tobytes(), "v": none, "w": none, "level": 0, "h": none, "hw": none}

    def out(keys, sums):
        return pa.RecordBatch.from_arrays([*[pa.array(k, pa.int64()) for k in keys.T], pa.array([[packed(s[i]) for s in sums] for i in range(len(keys))], pa.list_(STATE))], schema=schema)

    def run(batches):
        for b in batches:  # a key that goes on in the next batch has two states
            if b.num_rows:
                w = b.column("w").flatten().to_numpy().reshape(b.num_rows, -1)
                keys = np.stack([b.column(i).to_numpy() for i in ids], 1)
                starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
                yield out(keys[starts], [added(b.column(c).to_numpy(zero_copy_only=False).astype(float), w, starts) for c in columns])

    ddl = ", ".join([f"{i} long" for i in ids] + [f"states array<{STATE_DDL}>"])
    return rows.select(*[F.col(i).cast("long") for i in ids], *[F.col(c).cast("double") for c in columns], "w").mapInArrow(run, ddl)


MERGED_DDL = f"req_id long, states array<{STATE_DDL}>, n array<double>, value array<double>, error array<double>, value_b array<double>, error_b array<double>, reps array<array<double>>"


def spread(reps: np.ndarray) -> float:
    """Deviation of the replicates that have a value; NaN of fewer than two."""
    known = reps[1:][~np.isnan(reps[1:])]
    return float(known.std(ddof=1)) if len(known) > 1 else float("nan")


def corrected(reps: np.ndarray, how: str | None) -> float:
    """The estimate, the mean of its replicates ("mean"), or twice the estimate less that mean ("bias")."""
    mean = float(np.nanmean(reps[1:])) if how and not np.isnan(reps[1:]).all() else float(reps[0])
    return {None: float(reps[0]), "mean": mean, "bias": 2 * float(reps[0]) - mean}[how]


def put_together(parts: DataFrame, asked: list[tuple[int, str]], limit: int = LIMIT, keep: bool = False, correction: str | None = None) -> DataFrame:
    """One row a request: its states merged, and of each of ``asked`` (column, operator) rows, value, error and, if ``keep``, replicates.

    ``parts`` has req_id (long), part, states, share and share_b; what is of part 2 is the last step, without which value_b and error_b are told
    (of share_b). Rows of a request come one after another in a sorted partition, so one request's state is held at a time.
    """
    lists = pa.list_(pa.float64())
    schema = pa.schema([("req_id", pa.int64()), ("states", pa.list_(STATE)), *[(c, lists) for c in ("n", "value", "error", "value_b", "error_b")], ("reps", pa.list_(lists))])

    def row(req_id, held, share, share_b):
        base = held.get(0)
        whole = held.get(2, base) if base is None or 2 not in held else [merged(a, b, limit) for a, b in zip(base, held[2])]
        now = [told(whole[c], op, share) for c, op in asked]
        was = [told((base or whole)[c], op, share_b) for c, op in asked]
        full = share >= 1 - 1e-9
        values = [corrected(x, None if full else correction) for x in now]
        columns = [[req_id], [[s.packed() for s in whole]], [[float(whole[c].sums[0][0]) for c, _ in asked]], [values], [[0.0 if full else spread(x) for x in now]], [[corrected(x, correction) for x in was]], [[spread(x) for x in was]], [[x[1:].tolist() for x in now] if keep else []]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        now, held, shares = None, {}, None
        for b in batches:
            for r in b.to_pylist():
                if r["req_id"] != now:
                    if now is not None:
                        yield row(now, held, *shares)
                    now, held = r["req_id"], {}
                shares, part = (r["share"], r["share_b"]), 2 if r["part"] == 2 else 0
                new = [State.unpacked(s) for s in r["states"]]
                held[part] = [merged(a, n, limit) for a, n in zip(held[part], new)] if part in held else new
        if now is not None:
            yield row(now, held, *shares)

    return parts.repartition("req_id").sortWithinPartitions("req_id").mapInArrow(run, MERGED_DDL)
