"""SimHash near-duplicates by Golay-code fuzzy hashing.

Three errors over the three segments (23, 23 and 18 bits) of a fingerprint leave some two segments with at
most one error each. A segment's index is the codeword of the perfect (23, 12) Golay code that it decodes to;
its six near indices are those that it or a one-bit change of it decodes to. If u and v differ in at most one
bit of a segment, each one's index is among the other's near indices. For each pair of segments (i, j) one side
of the join is keyed by (index of i, near index of j), the other by (near index of i, index of j): six keys a side.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, materialize, row_id, shuffle_partitions, table, texts, unused, words

SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))

#: Generator polynomial of the binary Golay code (a fixed value).
GOLAY = 0b101011100011


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 23 unit words, and the lightest error for each of the 2,048 remainders."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    unit = np.array([remainder(1 << i) for i in range(23)], np.int64)
    error = np.zeros(2048, np.int64)
    bits = range(23)
    for a in bits:
        error[unit[a]] = 1 << a
        for b in bits[:a]:
            error[unit[a] ^ unit[b]] = 1 << a | 1 << b
            for c in bits[:b]:
                error[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c
    return unit, error


def decode(segment: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within three bits of each 23-bit word."""
    unit, error = golay()
    syndrome = np.zeros_like(segment)
    for i in range(23):
        syndrome ^= np.where(segment >> i & 1, unit[i], 0)
    return (segment ^ error[syndrome]) >> 11


def near_indices(segment: np.ndarray) -> np.ndarray:
    """The indices of a word and of its 23 one-bit changes: (n, 24), with repeats."""
    return np.stack([decode(segment)] + [decode(segment ^ (1 << i)) for i in range(23)], axis=1)


def fuzzy_keys(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each fingerprint the distinct keys of either side of the join; a key holds the pair and two indices."""
    parts = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [near_indices(p) for p in parts]
    left, right = [], []
    for k, (i, j) in enumerate(PAIRS):
        tag = k << 24
        left.append(tag | near[i][:, :1] << 12 | near[j])
        right.append(tag | near[i] << 12 | near[j][:, :1])
    both = []
    for side in (left, right):
        a = np.sort(np.concatenate(side, axis=1), axis=1)
        first = np.c_[np.ones(len(a), bool), a[:, 1:] != a[:, :-1]]
        both.append([row[m] for row, m in zip(a, first)])
    return both[0], both[1]


def fingerprint(text: str, width: int = 3) -> int:
    """64 bits: set if set in over half of the shingles' XXH64 values (seed 42); no words: zero."""
    w = words(text)
    if not w:
        return 0
    w = b" ".join(w).lower()  # bytes.lower() changes A-Z alone
    ends = np.flatnonzero(np.frombuffer(w, np.uint8) == 32)
    starts, ends = np.r_[0, ends + 1], np.r_[ends, len(w)]
    n = max(1, len(starts) - width + 1)
    ends = ends[min(width, len(ends)) - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(_id, _tkey, doc_id, fp) of every row; fp is the signed long of the 64 bits, _tkey a hash of the text. Null text: zero."""

    out = arrow_schema("doc_id long,_tkey long,fp long")

    def hashed(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in texts(b)], np.uint64).view(np.int64)
            yield batch_of(out, b.column("doc_id"), b.column("_tkey"), fp)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_tkey"), "text").mapInArrow(hashed, "doc_id long, _tkey long, fp long").withColumn("_id", row_id())


def links(prints: DataFrame, bits: int = 3, dense: int = 2048) -> DataFrame:
    """(a, b), a < b: every two different fingerprints at ``bits`` (at most three) or fewer bits, as needed for components.

    ``prints`` has distinct ``fp``. Fingerprints of buckets with more than ``dense`` members on either side, where pairs would grow with the
    square, meet at words instead: u reaches all words within one bit, v all within two (fewer for fewer bits), so a word reached by some u at
    one bit joins everything that reaches it. That is linear in members and loses no link.
    """

    keys = arrow_schema("fp long,side int,key int")

    def keyed(batches):
        for b in batches:
            fp = b.column("fp").to_numpy()
            for side, lists in enumerate(fuzzy_keys(fp.view(np.uint64))):
                n = [len(x) for x in lists]
                if sum(n):
                    yield batch_of(keys, np.repeat(fp, n), np.full(sum(n), side, np.int32), np.concatenate(lists).astype(np.int32))

    if bits < 1:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    # Fingerprints are few in bytes and lie in few files, keys are many: they are made in as many tasks as a shuffle has, once.
    all_keys = materialize(prints.select("fp").repartition(shuffle_partitions(prints.sparkSession)).mapInArrow(keyed, "fp long, side int, key int"))
    left, right = (all_keys.filter(F.col("side") == s).select("key", F.col("fp").alias(x)) for s, x in ((0, "a"), (1, "b")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    sizes = all_keys.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m"))
    crowded = materialize(sizes.filter(F.greatest("n", "m") > dense).select("key"))
    if crowded.isEmpty():
        return left.join(right, "key").filter(near & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    left = left.join(crowded, "key", "left_anti")
    pairs = left.join(right, "key").filter(near & (F.col("a") < F.col("b"))).select("a", "b")
    members = materialize(all_keys.join(crowded, "key", "left_semi").select("fp").distinct())
    return pairs.union(ball_links(members, bits)).distinct()


def ball_links(members: DataFrame, bits: int = 3) -> DataFrame:
    """Links that join the components of distances up to ``bits`` (1 to 3) among ``members``, by words within half of it and the other half."""
    flips = [np.array(x, np.uint64).view(np.int64) for x in ([0], [1 << i for i in range(64)], [1 << i | 1 << j for i in range(64) for j in range(i)])]
    one, two = bits // 2, bits - bits // 2
    all_flips, inner = np.concatenate(flips[: two + 1]), sum(map(len, flips[: one + 1]))
    ball = arrow_schema("word long,fp long,near int")

    def reach(batches):
        for b in batches:
            for fp in b.column("fp").to_numpy():
                yield batch_of(ball, all_flips ^ fp, np.full(len(all_flips), fp), (np.arange(len(all_flips)) < inner).astype(np.int32))

    words_ = members.select("fp").mapInArrow(reach, "word long, fp long, near int")
    hubs = words_.groupBy("word").agg(F.min("fp").alias("a"), F.max("near").alias("near"), F.count(F.lit(1)).alias("n")).filter((F.col("near") == 1) & (F.col("n") > 1))
    return words_.join(hubs.select("word", "a"), "word").filter(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node reachable. Large-star and small-star rounds."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        lowest = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter(F.col("v") > F.col("u")).join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct())
        lowest = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum((F.col("v") < F.col("u")).cast("int"))).first()
        if state == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        before = state


def near_duplicates(docs: DataFrame, bits: int = 3, width: int = 3, dense: int = 2048) -> DataFrame:
    """One row per document: doc_id, _id, _tkey, fp, component_id (the smallest doc_id reachable over links, itself included), root (the
    component's own name, as ids may repeat).

    Copies share a fingerprint and are represented by it, so only distinct fingerprints are joined. Null ids sort first
    and are returned as null; texts without words have fingerprint zero and link like any other. A table without rows
    gives one without rows.
    """
    rows = materialize(with_fingerprints(docs, width))
    prints = materialize(rows.groupBy("fp").agg(F.min("_id").alias("least")))
    # Only components of several fingerprints are in here.
    roots = materialize(components(links(prints, bits, dense)))
    grouped = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = materialize(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    named = materialize(grouped.join(ids, "root").select("fp", "component_id", "root"))
    known = F.when(F.col("component_id") != -(2**63), F.col("component_id")).alias("component_id")
    return rows.join(named, "fp").select("doc_id", "_id", "_tkey", "fp", known, "root")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates: of each component one row stays, that of the smallest doc_id, then of the smallest hash of the text.

    A component is known by its fingerprints, so rows of two components that share an id are judged apart. Rows equal in id and text
    leave one (that of the smallest hash of the other columns, or one of equal ones); null ids come first and leave one as well.
    """
    found = materialize(near_duplicates(docs).select("_id", "_tkey", "root"))
    first = found.groupBy("root").agg(F.min(F.struct("_id", "_tkey")).alias("_r")).select("_r.*")
    i, t, row = unused(docs, "_id", "_tkey", "_row")
    rows = found.groupBy("_id", "_tkey").agg(F.count(F.lit(1)).alias("_n"))
    keep = materialize(first.join(rows, ["_id", "_tkey"]).toDF(i, t, "_n"))
    named = docs.withColumns({i: row_id(), t: F.xxhash64("text")})
    out = named.join(keep.select(i, t), [i, t], "left_semi").select(*docs.columns)
    repeated = keep.filter("_n > 1").select(i, t)
    if repeated.isEmpty():  # ids are unique as a rule
        return out
    whole = F.struct(*[F.col(c) for c in docs.columns])
    order = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    one = named.join(repeated, [i, t], "left_semi").groupBy(i, t).agg(F.min_by(whole, order).alias(row)).select(f"{row}.*")
    return named.join(keep.filter("_n = 1").select(i, t), [i, t], "left_semi").select(*docs.columns).unionByName(one)
