"""The allocation rules of ``allocate`` as folds over one request's array of queries, for use inside a round: no window, no shuffle.

A query is a struct (i, share, inf, weight, card): its number, the share read, influence, cost of a step and estimated rows (null if unknown).
Every rule gives the next shares as an array in the order of ``i``; equal priorities go to the smaller ``i``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkling.functions.hashing import hash32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(a: Column, value: Callable[[Column], Column], zero: Column) -> Column:
    return F.aggregate(a, zero, lambda s, x: s + value(x))


def _long(a: Column, value) -> Column:
    return _total(a, lambda x: value(x).cast("long"), F.lit(0).cast("long"))


def _double(a: Column, value) -> Column:
    return _total(a, lambda x: value(x).cast("double"), F.lit(0.0))


@dataclass(frozen=True)
class Round:
    """What a rule may look at: the queries, the steps to give out, the size of a step, and the prediction's variance and confidence."""

    queries: Column
    steps: Column
    gran: float
    pvar: Column
    conf: Column
    req_id: Column

    def valid(self, x: Column) -> Column:
        return F.round((1 - x["share"]) / self.gran).cast("long")

    def raised(self, add: Callable[[Column], Column]) -> Column:
        return F.transform(self.queries, lambda x: F.least(F.lit(1.0), F.round(x["share"] + add(x) * self.gran, 6)))

    def ordered(self, priority: Callable[[Column], Column]) -> Column:
        """(neg, i, valid) with the best query first."""
        return F.array_sort(F.transform(self.queries, lambda x: F.struct((-priority(x)).cast("double").alias("neg"), x["i"].cast("int").alias("i"), self.valid(x).alias("valid"))))

    def given(self, pairs: Column) -> Column:
        """Next shares from an array of (i, add)."""
        added = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["i"], p["add"])))
        return let(added, lambda by: self.raised(lambda x: F.coalesce(by[x["i"].cast("int")], F.lit(0).cast("long"))))


def _served(units: Column, steps: Column, take: Callable[[Column, Column], Column]) -> Column:
    """(left, add: array of (i, add)): ``take`` says what a query gets of the steps that are left, in order."""
    none = F.array().cast("array<struct<i: int, add: bigint>>")
    return F.aggregate(
        units, F.struct(steps.cast("long").alias("left"), none.alias("add")),
        lambda acc, x: F.struct((acc["left"] - take(acc["left"], x)).cast("long").alias("left"), F.concat(acc["add"], F.array(F.struct(x["i"].cast("int").alias("i"), take(acc["left"], x).cast("long").alias("add")))).alias("add")),
    )


def _left(x: Column) -> Column:
    return F.greatest(1 - x["share"], F.lit(1e-9))


def _gradient(r: Round, x: Column) -> Column:
    return F.greatest(x["inf"], F.lit(0.0)) * r.pvar / (x["weight"] * _left(x))


def round_robin(priority: Callable[[Round, Column], Column]):
    """One step at a time to each query in order of priority, until used up: full laps for all, what is left of a lap for the first ones."""

    def rule(r: Round) -> Column:
        def dealt(units: Column, laps: Column) -> Column:
            held = lambda x: F.least(x["valid"], laps)
            rest = r.steps - _long(units, held)
            served = _served(units, rest, lambda left, x: F.when((left > 0) & (x["valid"] > laps), 1).otherwise(0))
            return F.zip_with(units, served["add"], lambda x, a: F.struct(x["i"].alias("i"), (held(x) + a["add"]).cast("long").alias("add")))

        def laps(units: Column) -> Column:
            most = F.array_max(F.transform(units, lambda x: x["valid"]))
            full = F.filter(F.sequence(F.lit(0).cast("long"), most), lambda lap: _long(units, lambda x: F.least(x["valid"], lap)) <= r.steps)
            return (F.size(full) - 1).cast("long")

        return r.given(let(r.ordered(lambda x: priority(r, x)), lambda units: let(laps(units), lambda n: dealt(units, n))))

    return rule


def best_first(priority: Callable[[Round, Column], Column]):
    """All steps to the best query until it is full, then to the next."""

    def rule(r: Round) -> Column:
        return r.given(_served(r.ordered(lambda x: priority(r, x)), r.steps, lambda left, x: F.least(x["valid"], left))["add"])

    return rule


def step_gradient(r: Round) -> Column:
    """Shares by normalised gradient, taken in order of the share from the steps that are left; what remains goes best first."""
    opened, norm = _long(r.queries, lambda x: (r.valid(x) > 0).cast("long")), _double(r.queries, lambda x: F.when(r.valid(x) > 0, _gradient(r, x)).otherwise(0.0))

    def dealt(units: Column) -> Column:
        def again(first: Column) -> Column:
            spare = F.zip_with(units, first["add"], lambda x, a: F.struct(x["i"].alias("i"), (x["valid"] - a["add"]).alias("valid")))
            second = _served(spare, first["left"], lambda left, x: F.least(x["valid"], left))
            return F.zip_with(first["add"], second["add"], lambda a, b: F.struct(a["i"].alias("i"), (a["add"] + b["add"]).cast("long").alias("add")))

        return let(_served(units, r.steps, lambda left, x: F.least(x["valid"], F.floor(-x["neg"] * left))), again)

    def share(x: Column, known: Column) -> Column:
        return F.when(r.valid(x) <= 0, 0.0).otherwise(F.when(known["norm"] < 1e-9, 1 / known["opened"]).otherwise(_gradient(r, x) / known["norm"]))

    known = F.struct(opened.alias("opened"), norm.alias("norm"))
    return r.given(let(known, lambda k: let(r.ordered(lambda x: share(x, k)), dealt)))


def gradient(r: Round) -> Column:
    """Unnormalised shares, at most half of everything each; one step each where all are zero or nothing is known."""
    add = lambda x: F.least(r.valid(x), F.floor(r.steps * _gradient(r, x) / r.gran), F.lit(int(0.5 / r.gran)).cast("long"))
    flat = (F.array_max(F.transform(r.queries, add)) == 0) | (_double(r.queries, lambda x: _gradient(r, x)) < 1e-9)
    return r.raised(lambda x: F.when(flat, F.least(r.valid(x), F.lit(1).cast("long"))).otherwise(add(x)))


def uniform(r: Round) -> Column:
    return r.raised(lambda x: F.least(r.valid(x), r.steps.cast("long")))


def doubled(r: Round) -> Column:
    return F.transform(r.queries, lambda x: F.least(F.lit(1.0), 2 * x["share"]))


def adaptive(r: Round) -> Column:
    """Queries of few rows jump to all of it; then ceil(1 / conf) steps in all, one at a time to each query in order of influence."""
    jumped = F.transform(r.queries, lambda x: x.withField("share", F.when(x["card"] < 30, 1.0).otherwise(x["share"])))
    steps = F.ceil(1 / F.greatest(r.conf, F.lit(0.05))).cast("long")
    return round_robin(lambda r, x: x["inf"])(Round(jumped, steps, r.gran, r.pvar, r.conf, r.req_id))


def min_card(r: Round, then: Column, support: int = 30) -> Column:
    """Queries whose expected rows fall short jump to the share that has them (to a half first if that is far); if none does, ``then``."""
    need = lambda x: F.least(F.lit(float(support)) / F.greatest(x["card"], F.lit(1e-9)), F.lit(1.0))
    short = lambda x: x["card"].isNotNull() & (x["share"] < need(x))
    half = lambda x: (x["share"] <= 0.1) & (need(x) >= 0.5)
    up = lambda x: F.when(half(x), 0.5).otherwise(F.least(F.lit(1.0), F.round(F.ceil(need(x) / r.gran - 1e-9) * r.gran, 6)))
    jumps = F.transform(r.queries, lambda x: F.when(short(x), up(x)).otherwise(x["share"]))
    return F.when(F.exists(r.queries, short), jumps).otherwise(then)


POLICIES: dict[str, Callable[[Round], Column]] = {
    "greedy": round_robin(lambda r, x: x["inf"] / _left(x)),
    "greedy_plus": round_robin(lambda r, x: x["inf"] / (x["weight"] * _left(x))),
    "random": round_robin(lambda r, x: hash32("r", r.req_id, x["i"])),
    "blqcost": round_robin(lambda r, x: 1 / (x["weight"] * _left(x))),
    "optimizer": best_first(lambda r, x: F.greatest(x["inf"], F.lit(0.0)) / (x["weight"] * _left(x))),
    "stepgradient": step_gradient,
    "gradient": gradient,
    "uniform": uniform,
    "uniformexpinit": doubled,
    "adaptive": adaptive,
}
