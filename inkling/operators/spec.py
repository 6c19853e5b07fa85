"""Feature specifications: what a pipeline computes for a request, put together as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkling.operators import matching as J
from inkling.operators import windows as W
from inkling.operators.exact import ALIASES, aggregate

#: Aggregates of the whole past that running sums give.
RUNNING = ("count", "sum", "avg", "varPop", "stdPop")


@dataclass(frozen=True)
class FeatureSpec:
    """One query of a pipeline: facts, how they match a request, and the features made of the matching rows.

    ``kind``: "request" (expressions over the request itself), "group" (equal keys), "trailing" (equal keys, ``width`` before
    the request), "expanding" (equal keys, before the request), "lookup" (first stored row).
    ``features`` maps a name to (operator, column); an operator is the name of a textbook aggregate or any function from
    a column to an aggregate, a grouped-aggregate Pandas UDF included. ``condition`` filters the facts, ``post`` changes a
    finished feature, ``default`` takes the place of missing ones. ``row_key`` names the columns that tell facts apart (all, if none) where
    rows are resampled.
    """

    kind: str
    features: dict[str, tuple]
    facts: DataFrame | None = None
    keys: list[str] = field(default_factory=list)
    width: int = 0
    condition: Column | str | None = None
    post: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    default: float = 0.0
    row_key: list[str] = field(default_factory=list)

    def swapped(self, old: str, new: str) -> "FeatureSpec":
        """The variant with another operator in place of ``old``."""
        features = {n: (new if op == old else op, c) for n, (op, c) in self.features.items()}
        return replace(self, features=features)


def _aggregates(spec: FeatureSpec) -> list[Column]:
    return [(op(F.col(c)) if callable(op) else aggregate(op, F.col(c))).cast("double").alias(n) for n, (op, c) in spec.features.items()]


def _expanding(requests: DataFrame, facts: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Closed forms over running sums: facts of a key are never gathered."""
    columns = sorted({c for _, c in spec.features.values()})
    sums = {f"_{kind}_{c}": x for c in columns for kind, x in (("n", F.col(c).isNotNull().cast("long")), ("s", F.col(c).cast("double")), ("q", F.col(c).cast("double") * F.col(c)))}
    found = J.expanding(requests, facts, spec.keys, sums, values=columns)

    def value(op, c):
        n, s, q = (F.col(f"_{k}_{c}") for k in "nsq")
        var = F.greatest(F.lit(0.0), q / n - (s / n) * (s / n))
        return {"count": n, "sum": s, "avg": s / n, "varPop": var, "stdPop": F.sqrt(var)}[ALIASES.get(op, op)].cast("double")

    return found.select("req_id", *[F.when(F.col(f"_n_{c}") > 0, value(op, c)).alias(n) for n, (op, c) in spec.features.items()])


def _matched(requests: DataFrame, spec: FeatureSpec) -> DataFrame:
    facts = spec.facts if spec.condition is None else spec.facts.filter(spec.condition)
    if spec.kind == "expanding" and all(isinstance(op, str) and ALIASES.get(op, op) in RUNNING for op, _ in spec.features.values()):
        return _expanding(requests, facts, spec)
    if spec.kind in ("trailing", "expanding"):
        return W.trailing(requests.select("req_id", "req_ts", *spec.keys), facts, spec.keys, spec.width if spec.kind == "trailing" else None, spec.features)
    if spec.kind == "group":
        return requests.select("req_id", *spec.keys).join(facts.groupBy(*spec.keys).agg(*_aggregates(spec)), spec.keys).drop(*spec.keys)
    if spec.kind == "lookup":
        values = {n: c for n, (_, c) in spec.features.items()}
        store = facts.select(*spec.keys, *[F.col(c).alias(n) for n, c in values.items()])
        return J.lookup(requests.select("req_id", *spec.keys), store, spec.keys, list(values), next(iter(values))).drop(*spec.keys)
    raise ValueError(f"unknown kind of feature: {spec.kind}")


def _parts(spec: FeatureSpec) -> list[FeatureSpec]:
    """Pandas aggregates can't stand beside built-in ones in one aggregation: they get one of their own."""
    python = {n for n, (op, _) in spec.features.items() if hasattr(op, "evalType")}
    groups = [{n: f for n, f in spec.features.items() if (n in python) == own} for own in (False, True)]
    return [replace(spec, features=g, post={n: f for n, f in spec.post.items() if n in g}) for g in groups if g]


def assemble(requests: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    """(req_id, features): every request once, with the features of all specs.

    ``requests`` has req_id and, where specs need them, keys and an integer req_ts. Features of the request are expressions of its
    row; every other spec is one join on req_id, so adaptive execution picks how each is done.
    """
    own = [op(F.col(c)) if callable(op) else F.col(c) for s in specs if s.kind == "request" for op, c in s.features.values()]
    names = [n for s in specs if s.kind == "request" for n in s.features]
    out = requests.select("req_id", *[x.alias(n) for n, x in zip(names, own)])
    for spec in [part for s in specs for part in _parts(s)]:
        if spec.kind != "request":
            filled = {n: F.coalesce(F.col(n), F.lit(spec.default)) for n in spec.features}
            filled |= {n: f(filled[n]) for n, f in spec.post.items()}
            out = out.join(_matched(requests, spec), "req_id", "left").withColumns(filled)
    return out
