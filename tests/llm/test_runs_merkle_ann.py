"""Periodic runs, the Merkle manifest and nearest neighbours against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkling.llm import ann, merkle, periodic_runs, registry

DATA = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11
def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        same, i = [w[i] == w[i + q] for i in range(len(w) - q)] + [False], 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            s, n = i, j + q - i
            if j > i and n >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(s, s + n - p)) for p in range(1, q)):
                out.append((s, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(2000):
        n, letters = rng.randint(0, rng.choice([12, 60, 150])), rng.choice([1, 2, 3, 5, 30])
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n:
                s = rng.randrange(n)
                p = rng.randint(1, max(1, (n - s) // rng.randint(3, 6)))
                for i in range(s, min(n, s + p * rng.randint(3, 7))):
                    w[i] = w[s + (i - s) % p]
        assert [tuple(r) for r in periodic_runs.find_runs(np.array(w, np.int64)).tolist()] == brute_runs(w)


def test_runs_of_long_texts_take_little_time():
    """A text of one word, one of two random words and a Fibonacci word, of 100,000 words each."""
    fib, more = [0], [0, 1]
    while len(more) < 100_000:
        fib, more = more, more + fib
    assert periodic_runs.find_runs(np.zeros(100_000, np.int64)).tolist() == [[0, 100_000, 1]]
    assert len(periodic_runs.find_runs(np.random.default_rng(0).integers(0, 2, 100_000))) > 1000
    assert not len(periodic_runs.find_runs(np.array(more[:100_000])))  # its exponents stay below 3.7


def plain_op11(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    shown = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *shown, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), hashlib.sha256(kept).hexdigest())


def test_op11_against_brute_force(spark, tmp_path):
    """Odd rows and the documents of up to 400 words, through the registered query."""
    ids = [i for i in range(1000, 4000) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    odd = [(1, None), (2, ""), (3, " \n\t"), (None, "la la la la la la la x"), (5, "a b " * 40), (5, "a b " * 40), (6, "x" * 50_000), (7, "été  日本 " * 5), *[(i, "one two three four five six seven eight nine ten " * 3 + "end") for i in ids]]
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if len((r.text or "").split()) <= 400]
    rows = odd + real
    spark.createDataFrame([(i, t, "r", "x") for i, t in rows], "doc_id long, text string, runs string, h string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, tuple(r)[1:]) for r in periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, plain_op11(i, t))) for i, t in rows)
    assert sum(x[1][0] > 0 for x in got) > 20


def test_collapsed_texts_carry_other_columns(spark):
    df = spark.createDataFrame([(1, "go go go go go go on", "r", "c"), (2, None, "r", "c"), (3, "two  spaces stay", "r", "c"), (4, "", "r", "c")], "doc_id long, text string, runs string, collapsed string")
    out = periodic_runs.collapse_runs(df)
    assert out.columns == df.columns
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "go on", "r", "c"), (2, None, "r", "c"), (3, "two  spaces stay", "r", "c"), (4, "", "r", "c")]
    assert periodic_runs.collapse_runs(df.filter("doc_id > 9")).collect() == []
    runs = periodic_runs.with_runs(df.select("text", F.lit(1).alias("n")), "found").filter("text like 'go%'").first()
    assert [tuple(x) for x in runs.found] == [(0, 6, 1)]


# 12
def brute_manifest(rows):
    """doc row -> (leaf, subroot, root, proof, folded, verified), by whole trees."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    told = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            for a in range(0, len(nodes), 16):
                run = nodes[a : a + 16]
                for k in range(len(run)):
                    for x in own[a + k]:
                        paths[x].append(("".join(run[:k]), "".join(run[k + 1 :])))
            own = [sum(own[a : a + 16], []) for a in range(0, len(nodes), 16)]
            nodes = [sha("".join(nodes[a : a + 16])) for a in range(0, len(nodes), 16)]
        return nodes[0], paths

    groups = {}
    for r in rows:
        t = r if r[0] is None or r[4] is None or zlib.crc32(str(r[0]).encode()) % 5 else (*r[:4], r[4].translate(lower))
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), told(r), told(t), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(groups[s])]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, above):
        for (_, leaf, node, i), path in zip(sorted(groups[s]), trees[s][1]):
            for a, b in path + top:
                node = sha(a + node + b)
            out.append((i, leaf, trees[s][0], root, sha("".join(a + b for a, b in path + top)), node, node == root))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def leaves(spark, tmp_path_factory):
    """A source of more than one block, many small ones, odd rows; another order than that of the ids."""
    rng = random.Random(5)
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(4300)] + [(i, f"s{i % 40}", None, None, "ab" if i % 2 else "aB") for i in range(5000, 5700)]
    rows += [(None, "hot", None, None, None), (9000, None, "en", 0, ""), (9001, None, "en", 0, "É 日本 \U0001f600"), (9002, "", "en", 1, "A"), (9003, "é", "en", 1, "A"), (9003, "é", "en", 1, "A"), (9004, "one", "en", 1, "Z")]
    rng.shuffle(rows)
    path = str(tmp_path_factory.mktemp("leaves"))
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, node string").write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_op12_against_brute_force(spark, leaves):
    path, rows = leaves
    got = [tuple(r) for r in merkle.op12_merkle(spark, path).collect()]
    assert sorted(map(repr, got)) == brute_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 5


def test_op12_sql(spark, leaves):
    path, rows = leaves
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert sorted(map(repr, con.execute(registry.SQL_MERKLE).fetchall())) == brute_manifest(rows)


def test_manifest_of_nothing_and_of_one(spark, leaves):
    df = spark.createDataFrame([(1, "s", "a" * 64, "b")], "id long, source string, leaf string, other string")
    assert merkle.manifest(df.filter("id > 5")).collect() == []
    r = merkle.manifest(df).first()
    assert (r.leaf, r.subroot, r.root, r.left, r.right, r.other) == ("a" * 64, "a" * 64, "a" * 64, [], [], "b")


# 13
def exact(v, q, k=20):
    s = v @ v[q]
    s[q] = -np.inf
    return np.lexsort((np.arange(len(v)), -s))[: min(k, len(v) - 1)], s


@pytest.mark.parametrize("name", ["sf0.001", "sf0.1"])
def test_op13_recall_and_scores(spark, name):
    d = f"/root/testdata/{name}"
    v = np.array([r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()], float)
    got = {}
    for r in ann.op13_ann(spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(range(0, len(v), 20))
    hits = 0
    for q, rows in got.items():
        top, s = exact(v, q)
        assert [r["rank"] for r in rows] == list(range(1, 21)) and all(abs(r.score - s[r.vec_id]) < 1e-12 and r.vec_id != q for r in rows)
        assert [(r.score, -r.vec_id) for r in rows] == sorted(((r.score, -r.vec_id) for r in rows), reverse=True)
        hits += len({r.vec_id for r in rows} & set(top.tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_pigeonhole_probes_miss_no_code():
    rng = np.random.default_rng(2)
    for bits in (64, 50, 17, 5):
        codes = rng.integers(0, 2**bits, 3000, dtype=np.uint64) if bits < 64 else rng.integers(0, 2**64, 3000, dtype=np.uint64)
        codes[:200] = codes[0] ^ (np.uint64(1) << rng.integers(0, bits, 200).astype(np.uint64))
        tables = ann.Tables(codes, bits)
        for radius in (0, 1, 2, 3, 7, 12, 26, bits):
            for q in codes[:: 500]:
                assert tables.within(q, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ q) <= radius).tolist()


def test_nearest_with_odd_rows(spark):
    """Ties, copies, repeated ids, other norms, other lengths; nulls, zeros and what is not finite take no part."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 6)) * rng.uniform(0.1, 9, (300, 1))
    v[100:160] = v[100]
    rows = [(i, x.tolist(), "c") for i, x in enumerate(v)]
    odd = [(900, None, "c"), (901, [0.0] * 6, "c"), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], "c"), (903, [float("nan")] * 6, "c"), (904, [float("inf")] + [0.0] * 5, "c"), (905, [1.0], "c"), (906, [], "c"), (None, [99.0] * 6, "c"), (100, v[100].tolist(), "c")]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>, name string").repartition(5)
    got = {}
    for r in ann.nearest(df, df.filter("id % 20 = 0 or id > 899 or id is null")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert set(got) == set(range(0, 300, 20))
    hits = 0
    for q, mine in got.items():
        top, s = exact(v, q)
        hits += len({i for i, _ in mine} & set(top.tolist()))
        assert len(mine) == 20 and all(x == round(s[i], 9) for i, x in mine)
    assert hits >= 0.9 * 20 * len(got)
    assert [i for i, _ in got[100]][: 20] == exact(v, 100)[0].tolist()  # copies tie; the smaller ids are kept


def test_nearest_of_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, -1.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    got = [tuple(r) for r in ann.nearest(df, df.filter("id = 1")).orderBy("rank").collect()]
    assert got == [(1, 1, 3, 1.0), (1, 2, 2, 0.0)]
    assert ann.nearest(df.filter("id > 5"), df).collect() == [] and ann.nearest(df, df.filter("id > 5")).collect() == []
    assert ann.nearest(df.filter("id = 1"), df.filter("id = 1")).collect() == []
