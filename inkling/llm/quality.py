"""Quality rules: base rules and a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into a fixed number of buckets. One pass over all documents counts buckets in the raw
corpus and in its trusted part; each task adds up arrays of fixed size, so what is gathered is bounded by buckets, not rows.
A second pass scores every document by its mean log ratio of the two smoothed multinomials and keeps it at or above a fixed
threshold: the same document and counts always give the same verdict.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, BoundedCache, arrow_schema, batch_of, row_id, table, words

BUCKETS = 1 << 16
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: A document is kept if its mean log ratio is at least this.
THRESHOLD = -0.1

#: Up to this many trusted ids (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(found: list[bytes], cache: BoundedCache) -> np.ndarray:
    fresh = {w for w in found if w not in cache}
    cache.room_for(len(fresh))
    digest = xxhash.xxh64_intdigest
    if cache:
        cache.update((w, digest(w)) for w in fresh)
        return np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    own = {w: digest(w) for w in found}
    cache.update(own)
    return np.fromiter(map(own.__getitem__, found), np.uint64, len(found))


def buckets(h: np.ndarray) -> np.ndarray:
    """Buckets of the unigrams and bigrams."""
    two = (h[:-1] * np.uint64(31) + h[1:]) * MIX
    return np.concatenate([h * MIX, two]) >> np.uint64(48)


def repeat_words(found: list[bytes], h: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text."""
    n = len(found) - width + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            key = key * np.uint64(0x100000001B3) + h[j : j + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    at = np.unique(np.concatenate([order[:-1][same], order[1:][same]]))
    windows = [tuple(found[i : i + width]) for i in at.tolist()]  # equal hashes are compared in full
    often = Counter(windows)
    covered = np.zeros(len(found) + 1, np.int64)
    for i, w in zip(at.tolist(), windows):
        if often[w] > 1:
            covered[i] += 1
            covered[i + width] -= 1
    return int((np.cumsum(covered) > 0).sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(ASCII_SPACE):
            seen.add(line)
    return n


COUNTS = arrow_schema("bucket int,raw long,target long")


def bucket_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, raw, target) over all documents; target counts the rows whose doc_id is in ``trusted``."""

    def count(batches):
        cache, total = BoundedCache(), np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for text, is_target in zip(b.column("text").to_pylist(), b.column("target").to_pylist()):
                if text and (found := words(text)):
                    n = np.bincount(buckets(word_hashes(found, cache)).astype(np.int64), minlength=BUCKETS)
                    total[0] += n
                    if is_target:
                        total[1] += n
        used = np.flatnonzero(total[0])
        yield batch_of(COUNTS, used.astype(np.int32), total[0][used], total[1][used])

    ids = trusted.select(row_id().alias("_id")).filter(F.col("doc_id").isNotNull()).distinct().withColumn("target", F.lit(True))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    marked = docs.select(row_id().alias("_id"), "text").join(ids, "_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counted = marked.mapInArrow(count, "bucket int, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Smoothed log ratio of each bucket; without trusted text all are zero."""
    n = np.zeros((2, BUCKETS))
    for r in counts.collect():  # at most BUCKETS rows
        n[:, r.bucket] = r.raw, r.target
    if not n[1].sum():
        return np.zeros(BUCKETS)
    # The raw multinomial is shrunk to the size of the target, so that rare buckets are not favoured for being rare.
    raw = n[0] * (n[1].sum() / n[0].sum())
    return np.log((n[1] + 1) / (raw + 1)) - np.log((n[1].sum() + BUCKETS) / (raw.sum() + BUCKETS))


OUT = arrow_schema("doc_id long,n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,base_failed boolean,kept boolean,llr double")
OUT_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def score_documents(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS doubles

    def score(batches):
        ratio, cache = shared.value, BoundedCache()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                text = text or ""
                found = words(text)
                h = word_hashes(found, cache)
                llr = float(ratio[buckets(h).astype(np.int64)].mean()) if found else 0.0
                repeats = repeat_words(found, h)
                chars = len(text) - sum(map(text.count, ASCII_SPACE))
                failed = len(found) < 20 or 100 * repeats > 30 * len(found)
                rows.append((doc_id, len(found), chars, sum(map(text.count, SYMBOLS)), dup_lines(text), repeats, failed, not failed and llr >= threshold, llr))
            if rows:
                yield batch_of(OUT, *map(list, zip(*rows)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, OUT_DDL)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the base counts, base_failed, kept and llr.

    ``labels`` (doc_id, quality) names the trusted documents by quality 1. Null text has no words and fails the base rules.
    Labels of unknown or null documents are ignored; repeated rows are scored each. Without labels only base rules decide.
    """
    ratios = log_ratios(bucket_counts(docs, labels.filter(F.col("quality") == 1)))
    return score_documents(docs, ratios, threshold)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
