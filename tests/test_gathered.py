"""Windows from slices of gathered facts: the same as by ranges of ranks, and chosen for narrow, full windows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkling.operators import windows as W

from .test_windows import FEATURES, data, plain, same  # noqa: F401


def test_slices_of_gathered_facts(data):  # noqa: F811
    facts, requests, f, r = data
    for width in (400, 1000):
        got = {x.req_id: x for x in W.gathered_features(r, f, ["key"], width, FEATURES).collect()}
        for i, k, lo, hi in requests:
            want = plain(facts, k, lo, hi)
            assert (i in got) == (want is not None) and (want is None or same(got[i], want))


def test_both_ways_without_pairs_agree(data, monkeypatch):  # noqa: F811
    _, _, f, r = data
    monkeypatch.setattr(W, "FEW", 0)
    told = []
    for most in (0, 10**9):
        monkeypatch.setattr(W, "GATHERED", most)
        monkeypatch.setattr(W, "DENSE", 0)
        told.append({x.req_id: {n: x[n] for n in FEATURES} for x in W.between(r, f, ["key"], 400, FEATURES).collect()})
    assert set(told[0]) == set(told[1]) and all(same(told[1][i], told[0][i]) for i in told[0])


def test_wide_or_thin_groups_go_by_ranks(spark):
    facts = spark.range(20_000).select(F.lit(1).alias("key"), F.col("id").alias("ts"))
    requests = spark.range(200).select(F.col("id").alias("req_id"), F.lit(1).alias("key"), (F.col("id") * 100).alias("_lo"), (F.col("id") * 100 + 1000).alias("_hi"))
    m = W.matches(requests, facts, ["key"], 1000)
    assert m.largest == 1000 and m["size"] == 20_200 and m.groups == 40 and m.made == 10 * 1000 * (20 + 19)
    assert W.gatherable(m) and not W.few_matches(m)
    many = facts.withColumn("key", F.col("ts").cast("int"))
    assert not W.gatherable(W.matches(requests.withColumn("key", F.col("req_id").cast("int")), many, ["key"], 1000))


def test_sums_of_resamples_by_request(spark):
    """One state for each request and batch, not one for each row, and the same as by the states of rows."""
    import numpy as np

    from inkling.operators import resample as B

    rng = np.random.default_rng(5)
    data = [(int(i), int(p), None if x > 1.5 else float(x), [1, *map(int, w)]) for i, p, x, w in zip(rng.integers(0, 300, 3000), rng.integers(1, 3, 3000), rng.normal(size=3000), rng.poisson(1, (3000, 6)))]
    rows = spark.createDataFrame(data, "req_id long, part int, x double, w array<tinyint>").repartition(3, "req_id").sortWithinPartitions("req_id", "part")
    got = B.sorted_sums(rows, ["req_id", "part"], ["x"]).collect()
    want = {(r.req_id, r.part): r.states for r in B.states(rows, ["req_id", "part"], {"x": (False, False)}).collect()}
    assert {(r.req_id, r.part) for r in got} == set(want) and len(got) == len(want) == len({(i, p) for i, p, *_ in data})
    for r in got:
        assert np.allclose(np.frombuffer(r.states[0].sums), np.frombuffer(want[r.req_id, r.part][0].sums))


def test_large_groups_are_gathered():
    """A key with 1.7 million facts in a bucket of a week: its windows are slices, and no tree over all facts is joined."""
    from pyspark.sql import Row

    assert W.gatherable(Row(made=6e11, size=36e6, groups=30.0, largest=1.7e6))


def test_what_slices_tell():
    """Against each slice by itself, with numbers that are not finite, and small ones beside a far greater one."""
    import numpy as np

    from inkling.operators import ordered as O

    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 9, 333):
        x = np.round(rng.normal(size=n), 1)
        if n > 8:
            x[[2, 5, 7]] = 1e12, np.nan, np.inf
        a = rng.integers(0, n + 1, 80)
        b = np.minimum(n, a + rng.integers(0, n + 1, 80))
        codes = np.unique(x, return_inverse=True)[1].astype(int)
        rows, total, squares, lo, hi = O.moments(x, a, b)
        assert np.array_equal(O.different(codes, a, b), [len(np.unique(x[i:j])) for i, j in zip(a, b)])
        for k in np.flatnonzero(b > a):
            y = x[a[k] : b[k]]
            with np.errstate(invalid="ignore"):
                want = [len(y), y.sum(), y.var() * len(y), np.fmin.reduce(y), y.max()]
            assert np.allclose([rows[k], total[k], squares[k], lo[k], hi[k]], want, rtol=1e-9, equal_nan=True)
            at = rng.integers(0, len(y), (1, 2))
            assert np.array_equal(np.sort(codes[a[k] : b[k]])[at], O.kth(codes, a[k : k + 1], b[k : k + 1], at))
