"""Plan search by dynamic programming against enumeration."""

from __future__ import annotations

import itertools

import numpy as np

from inkling.operators import planning as P


def test_frontier_equals_enumeration(spark):
    rng = np.random.default_rng(0)
    levels = {q: [(k, float(rng.integers(1, 9)) * k, float(round(rng.random() * 3 / k, 3))) for k in range(1, n + 1)] for q, n in (("a", 4), ("b", 3), ("c", 5), ("d", 2))}
    profile = spark.createDataFrame([(q, *x) for q, rows in levels.items() for x in rows], "qname string, level int, cost double, var double")
    all_plans = [(round(sum(x[1] for x in p), 9), round(sum(x[2] for x in p), 9)) for p in itertools.product(*levels.values())]
    best = {(c, v) for c, v in all_plans if not any(o[0] <= c and o[1] <= v and o != (c, v) for o in all_plans)}
    got = P.frontier(profile, list(levels)).collect()
    assert {(round(r.cost, 9), round(r.var, 9)) for r in got} == best and len(got) == len(best)
    for r in got:
        chosen = [next(x for x in levels[q] if x[0] == k) for q, k in zip(levels, r.plan)]
        assert abs(sum(x[1] for x in chosen) - r.cost) < 1e-9 and abs(sum(x[2] for x in chosen) - r.var) < 1e-9
    bound = sorted(v for _, v in best)[len(best) // 2]
    assert P.cheapest(P.frontier(profile, list(levels)), bound).first().cost == min(c for c, v in best if v <= bound)
    coarse = P.frontier(profile, list(levels), grid=5.0).collect()
    assert all(r.cost % 5 == 0 for r in coarse) and len(coarse) <= len(got) + 1
    assert P.cheapest(P.frontier(profile, list(levels)), -1.0).collect() == []
