"""Nearest neighbours by inner product with multi-index hashing.

Method: vectors get binary codes from a learned rotation: principal axes of a bounded sample, then the rotation that brings them nearest to
signs (iterative quantisation). A code is split into substrings and each substring is indexed. Codes within Hamming radius r of a query
agree with it in some substring up to r over the number of substrings (pigeonhole), so probing the buckets within that
distance retrieves all of them; the float vectors of what is retrieved give the scores. The radius is learned too: for a
bounded number of probes the true neighbours among all rows are found, and the radius covers a stated share of them. Queries
that meet fewer than k rows within the radius are asked again at the full radius, which is exact.

The index is in blocks of bounded bytes, each with its own substring tables, and the queries are in blocks too; a task meets blocks, so
no bucket and no group of copies is ever gathered from more than one block, and what is shuffled is blocks and the k best.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, materialize, shuffle_partitions, table

#: Different rows that the rotation is fitted on (about as many, chosen by hash), and probes that the radius is learned from (the first of them).
SAMPLE, PROBES = 8192, 128

#: Share of the probes' true neighbours that the radius covers; rounds of the rotation.
COVERED, ROUNDS = 0.97, 40

#: Longest code, and bits of a substring.
BITS, SUBSTRING = 64, 16

#: Bytes of vectors in a block of the index and in a block of queries; blocks of the index that one task buffers.
INDEX_BYTES, QUERY_BYTES, BUFFERED = 4 << 20, 256 << 10, 32


@contextmanager
def arrow_rows(spark, n: int):
    """Arrow batches of ``n`` rows: few where rows are blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def usable(rows: DataFrame) -> DataFrame:
    """(id, v) of the rows that take part: an id, and a vector without nulls, NaN or infinities that is not all zero."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine).select(F.col("id").cast("long"), F.col("v").cast("array<double>"))


@dataclass(frozen=True)
class Coder:
    """A learned rotation to signs. Rows get one more component that gives all the same norm, so that angle and inner product agree."""

    norm: float
    mean: np.ndarray
    rotation: np.ndarray

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def _packed(self, x: np.ndarray) -> np.ndarray:
        signs = np.zeros((len(x), 64), np.uint8)
        signs[:, : self.bits] = x @ self.rotation > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)

    def rows(self, v: np.ndarray) -> np.ndarray:
        return self._packed(lifted(v, self.norm) - self.mean)

    def queries(self, v: np.ndarray) -> np.ndarray:
        return self._packed(np.c_[v, np.zeros(len(v))])


def lifted(v: np.ndarray, norm: float) -> np.ndarray:
    return np.c_[v, np.sqrt(np.maximum(0.0, norm * norm - np.einsum("ij,ij->i", v, v)))]


def learned(sample: np.ndarray, norm: float) -> Coder:
    """Principal axes of the sample and the rotation that brings them nearest to signs."""
    x = lifted(sample, norm)
    mean = x.mean(0)
    bits = min(BITS, x.shape[1])
    _, axes = np.linalg.eigh(np.cov((x - mean).T, bias=True).reshape(x.shape[1], x.shape[1]))
    axes = axes[:, ::-1][:, :bits]
    v = (x - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = (left @ right).T
    return Coder(norm, mean, axes @ turn)


def splits(bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the substrings."""
    m = -(-bits // SUBSTRING)
    ends = [bits * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


class Tables:
    """The substring tables of one block of codes."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.splits, self.tables = codes, splits(bits), []
        for first, width in self.splits:
            keys = self.keys(codes, first, width)
            order = np.argsort(keys, kind="stable")
            distinct, starts = np.unique(keys[order], return_index=True)
            self.tables.append((distinct, np.r_[starts, len(keys)], order))

    @staticmethod
    def keys(codes: np.ndarray, first: int, width: int) -> np.ndarray:
        return ((codes >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.uint32)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Places of all codes within the radius: the first radius % m + 1 substrings are probed to radius // m, the others to one less."""
        m = len(self.splits)
        met = np.zeros(len(self.codes), bool)
        for j, ((first, width), (distinct, starts, order)) in enumerate(zip(self.splits, self.tables)):
            reach = radius // m - (j > radius % m)
            if reach < 0:
                continue
            hit = np.flatnonzero(np.bitwise_count(distinct ^ self.keys(np.array([code]), first, width)) <= reach)
            count = starts[hit + 1] - starts[hit]
            met[order[np.repeat(starts[hit] - np.cumsum(count) + count, count) + np.arange(count.sum())]] = True
        at = np.flatnonzero(met)
        return at[np.bitwise_count(self.codes[at] ^ code) <= radius]


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each added up in the same order, so that equal vectors tie."""
    return np.einsum("ij,j->i", vectors, query)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then smaller id; an id counts once, with its best score."""
    if len(ids) > 8 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - 4 * k)[len(score) - 4 * k])  # with all that tie at the edge
        if len(np.unique(ids[some])) >= k:
            return some[_best(ids[some], score[some], k)]
    return _best(ids, score, k)


def _best(ids, score, k):
    order = np.lexsort((ids, -score))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


BLOCK_DDL = "name string,n int,ids binary,vectors binary,codes binary"
BLOCK = arrow_schema(BLOCK_DDL)


def blocks(rows: DataFrame, coder: Coder, size: int, of_queries: bool = False) -> DataFrame:
    """Rows (id, v) as blocks of at most ``size`` bytes of vectors with their codes, in the partitions where they are."""
    width = len(coder.mean) - 1
    most = max(16, size // (8 * width))

    def pack(batches):
        part, k, ids, vectors = TaskContext.get().partitionId(), 0, [], []

        def block():
            nonlocal k, ids, vectors
            i, v = np.concatenate(ids), np.concatenate(vectors)
            k, ids, vectors = k + 1, [i[most:]], [v[most:]]
            i, v = i[:most], v[:most]
            code = coder.queries(v) if of_queries else coder.rows(v)
            return batch_of(BLOCK, [f"{part}-{k}"], [len(i)], [i.tobytes()], [v.tobytes()], [code.tobytes()])

        for b in batches:
            ids.append(b.column("id").to_numpy().astype(np.int64))
            vectors.append(b.column("v").flatten().to_numpy().reshape(-1, width))
            while sum(map(len, ids)) >= most:
                yield block()
        if sum(map(len, ids)):
            yield block()

    return rows.mapInArrow(pack, BLOCK_DDL)


def _unpacked(b: pa.RecordBatch, i: int, suffix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get = lambda name, kind: np.frombuffer(b.column(name + suffix)[i].as_py(), kind)
    ids = get("ids", np.int64)
    return ids, get("vectors", np.float64).reshape(len(ids), -1), get("codes", np.uint64)


FOUND_DDL = "query_id long,vec_id long,score double"
FOUND = arrow_schema(FOUND_DDL)


def _found(held: dict):
    rows = [(q, i, s) for q, (i, s) in held.items() if len(i)]
    return batch_of(FOUND, np.repeat([q for q, _, _ in rows], [len(i) for _, i, _ in rows]), np.concatenate([i for _, i, _ in rows]), np.concatenate([s for _, _, s in rows]))


def _merge(held: dict, query: int, ids: np.ndarray, score: np.ndarray, k: int) -> None:
    if query in held:
        ids, score = np.r_[held[query][0], ids], np.r_[held[query][1], score]
    at = best(ids, score, k)
    held[query] = ids[at], score[at]


def _search(bits: int, radius: int, k: int):
    def run(batches):
        held, name = {}, None
        for b in batches:
            for i in range(b.num_rows):
                ids, vectors, codes = _unpacked(b, i)
                if b.column("name_q")[i].as_py() != name:
                    if any(len(x) for x, _ in held.values()):
                        yield _found(held)
                    held, name = {}, b.column("name_q")[i].as_py()
                tables = Tables(codes, bits)
                for q, v, code in zip(*_unpacked(b, i, "_q")):
                    at = tables.within(code, radius)
                    at = at[ids[at] != q]
                    if len(at):
                        _merge(held, int(q), ids[at], scores(vectors[at], v), k)
        if held:
            yield _found(held)

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pairs(index: DataFrame, queries: DataFrame, buckets: int) -> DataFrame:
    """Every block of queries with every block of the index, by buckets of the index; a block of queries meets a bucket's blocks in a row."""
    left = queries.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), *[F.col(c).alias(f"{c}_q") for c in ("name", "ids", "vectors", "codes")])
    right = index.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int")).select("bucket", "ids", "vectors", "codes")
    return left.join(right.hint("merge"), "bucket")


def learned_radius(index: DataFrame, probes: list, coder: Coder, k: int) -> int:
    """The radius that covers ``COVERED`` of the probes' true neighbours among all rows. One number a distance comes to the driver."""
    ids = np.array([p.id for p in probes], np.int64)
    asked = np.array([p.v for p in probes], float).reshape(len(ids), -1)
    codes = coder.queries(asked)

    def exact(batches):
        held = {}
        for b in batches:
            for i in range(b.num_rows):
                own, vectors, code = _unpacked(b, i)
                for j, v in enumerate(asked):
                    other = np.flatnonzero(own != ids[j])
                    far = np.bitwise_count(code[other] ^ codes[j]).astype(np.int64)
                    # The distance rides along in the id's place; rows that tie may change places, which no share feels.
                    s = scores(vectors[other], v)
                    at = np.argsort(-s, kind="stable")[:k]
                    old = held.get(j, (np.empty(0, np.int64), np.empty(0)))
                    d, s = np.r_[old[0], far[at]], np.r_[old[1], s[at]]
                    at = np.argsort(-s, kind="stable")[:k]
                    held[j] = d[at], s[at]
        if any(len(d) for d, _ in held.values()):
            yield _found(held)

    near = index.mapInArrow(exact, FOUND_DDL)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    counts = near.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k).groupBy(F.col("vec_id").alias("far")).count().collect()
    total, run = sum(r["count"] for r in counts), 0
    for r in sorted(counts, key=lambda r: r.far):
        run += r["count"]
        if run >= COVERED * total:
            return int(r.far)
    return coder.bits


def nearest(base: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``base`` (id, v) with the largest inner product with each query (id, v), approximately.

    A query's own id is no candidate. Vectors that are null, all zero, or hold nulls, NaN or infinities take no part, nor do rows without
    an id or vectors of another length than most have. Ties go to the smaller id. Rows that share an id count as one, with the best of their
    scores; queries that share an id likewise. Fewer than k candidates: all. Empty tables give an empty one. Other columns are not read.
    """
    spark = base.sparkSession
    rows = usable(base)
    place = F.xxhash64("id", "v")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(place, 0.02).alias("different"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("ss"))
    most = sizes.orderBy(F.desc("n"), "d").first()  # one row
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == most.d)
    asked = usable(queries).filter(F.size("v") == most.d)
    # A share of the hash range, as a global limit would send every partition's best to the driver; equal rows count once.
    share = min(1.0, SAMPLE / max(1, most.different))
    chosen = rows.withColumn("h", place).filter(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40))).dropDuplicates(["h"])
    sample = sorted(chosen.collect(), key=lambda r: (r.h % 1_000_003, r.h, r.id))
    coder = learned(np.array([r.v for r in sample], float), float(np.sqrt(most.ss)))
    with arrow_rows(spark, 256):
        index = materialize(blocks(rows, coder, INDEX_BYTES))
        of_queries = materialize(blocks(asked, coder, QUERY_BYTES, of_queries=True))
    with arrow_rows(spark, 2):
        radius = learned_radius(index, sample[:PROBES], coder, k)
        n = index.count()
        buckets = max(1, -(-n // BUFFERED), min(n, shuffle_partitions(spark)))
        found = materialize(_top(_pairs(index, of_queries, buckets).mapInArrow(_search(coder.bits, radius, k), FOUND_DDL), k))
        # What met too few rows within the radius is asked again at the full one.
        enough = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id"))
        with arrow_rows(spark, 256):
            short = materialize(blocks(asked.join(enough, "id", "left_anti"), coder, QUERY_BYTES, of_queries=True))
        if short.isEmpty():
            return found
        again = materialize(_top(_pairs(index, short, buckets).mapInArrow(_search(coder.bits, coder.bits, k), FOUND_DDL), k))
    return found.join(enough.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(again)


def op13_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of ``embeddings`` for each row whose vec_id is divisible by 20; see ``nearest`` for odd rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest(rows, rows.filter("id % 20 = 0"))
