"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Passages within a fifth of an item's words (edit distance on words) are searched in every document. An item of n words with d
edits allowed has more than d anchor words, its rarest ones, so a passage keeps one of them, and item-sized windows are laid
around the anchors of a document alone. From either side of an anchor the CGK random walk embeds the window, so that few edits
become few differing symbols; repeated samples of its symbols are keys, windows and items meet where a key is equal (the only
source of candidates), and what meets is verified exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, materialize, table, texts

WORD = re.compile(r"\w+")

#: Share of an item's words that may be edited; repetitions, symbols of each sample, and the steps that samples are drawn from.
EDIT_SHARE, REPETITIONS, SAMPLED, STEPS = 0.2, 24, 2, 8

#: Items matched in one pass over the documents; more items take further passes.
BLOCK_ITEMS = 50_000

#: Windows embedded at once.
BLOCK_WINDOWS = 1 << 15


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def allowed(n: int) -> int:
    """Edits allowed in an item of ``n`` words."""
    return int(EDIT_SHARE * n)


def walk_steps(n: int) -> int:
    """Steps of the walks around an anchor of an item of ``n`` words: either side of some anchor has as many words."""
    return min(STEPS, 1 << (((n - 1) // 2).bit_length() - 1)) if n > 2 else 0


def walks(steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers of the walk's bits (step, repetition) and the sampled steps (repetition, sample)."""
    rng = np.random.default_rng(steps)
    return rng.integers(0, 2**63, (steps, REPETITIONS), dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, max(1, steps), (REPETITIONS, SAMPLED))


def sketch(symbols: np.ndarray, anchors: np.ndarray, steps: int, side: int) -> np.ndarray:
    """Keys (anchors, repetitions) of the walks that leave places ``anchors`` of ``symbols`` to the right (side 1) or left (-1).

    At each step a walk stands on a word, and moves on if a random bit of (repetition, step, word) is set. A key mixes the
    repetition, the side, the anchor and the words at the sampled steps.
    """
    factor, sampled = walks(steps)
    key = np.repeat(symbols[anchors][:, None], REPETITIONS, 1) + np.arange(REPETITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(side > 0)
    at = np.repeat(anchors[:, None] + side, REPETITIONS, 1)
    for t in range(steps):
        symbol = symbols[at]
        times = (sampled == t).sum(1)
        for k in range(SAMPLED):
            pick = np.flatnonzero(times > k)
            key[:, pick] = (key[:, pick] ^ symbol[:, pick]) * np.uint64(0x9E3779B97F4A7C15)
        at += side * (symbol * factor[t] >> np.uint64(63)).astype(np.int64)
    return key ^ key >> np.uint64(29)


def edits(item: list[str], region: list[str], limit: int) -> int | None:
    """Fewest word edits between ``item`` and any stretch of ``region``; none beyond ``limit``."""
    row = [0] * (len(region) + 1)
    for i, w in enumerate(item, 1):
        old, row = row, [i] + [0] * len(region)
        for j, x in enumerate(region, 1):
            row[j] = min(old[j - 1] + (w != x), old[j] + 1, row[j - 1] + 1)
        if min(row) > limit:
            return None
    return min(row)


class Items:
    """Searchable form of a block of items: word numbers, anchors, and a table of keys for each length of walk."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        self.words = [tokens(t) for _, t in rows]
        self.bags = [Counter(ws) for ws in self.words]
        common = Counter(w for bag in self.bags for w in bag)
        self.number = {w: k for k, w in enumerate(sorted(common), 1)}
        rng = np.random.default_rng(0)
        #: Symbols of the words, and of words of no item: those only must differ from item words, so they go by place.
        self.symbol = np.array([0] + [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) | 1 for w in self.number], np.uint64)
        self.strangers = rng.integers(1, 2**63, 1 << 12, dtype=np.uint64) * np.uint64(2)
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        groups = [(steps, side) for steps in sorted({walk_steps(len(ws)) for ws in self.words if ws}) for side in ((1, -1) if steps else (1,))]
        self.anchored = {g: np.zeros(len(self.number) + 1, bool) for g in groups}
        for k, ws in enumerate(self.words):
            rare = set(sorted(self.bags[k], key=lambda w: (common[w], w))[: allowed(len(ws)) + 1])
            steps = walk_steps(len(ws))
            for j, w in enumerate(ws):
                if w in rare:
                    for side, room in ((1, len(ws) - 1 - j), (-1, j)):
                        if room >= steps and (side > 0 or steps):
                            found.setdefault((steps, side), []).append((k, j))
                            self.anchored[steps, side][self.number[w]] = True
        self.tables = {g: self.table(*g, where) for g, where in found.items()}

    def table(self, steps: int, side: int, where: list[tuple[int, int]]):
        """Sorted keys with item and offset of each, and a bit for every hash of a key."""
        symbols, start, end = [np.zeros(STEPS + 1, np.uint64)], {}, STEPS + 1
        for k in sorted({k for k, _ in where}):
            start[k] = end
            symbols.append(self.symbol[[self.number[w] for w in self.words[k]]])
            symbols.append(np.zeros(STEPS + 1, np.uint64))
            end += len(self.words[k]) + STEPS + 1
        places = np.array([start[k] + j for k, j in where], np.int64)
        keys = sketch(np.concatenate(symbols), places, steps, side).ravel()
        item, offset = (np.repeat([x[c] for x in where], REPETITIONS) for c in (0, 1))
        order = np.argsort(keys, kind="stable")
        bits = np.zeros(1 << max(16, int(np.ceil(np.log2(8 * len(keys))))), bool)
        bits[keys & np.uint64(len(bits) - 1)] = True
        return keys[order], item[order], offset[order], bits

    def candidates(self, numbers: np.ndarray) -> tuple[np.ndarray, int]:
        """Rows of item, anchor and start of its window among ``numbers`` (0: no item's word, -1: between documents), and how many windows were embedded."""
        symbols = np.r_[np.zeros(STEPS + 1, np.uint64), np.where(numbers > 0, self.symbol[np.maximum(numbers, 0)], self.strangers[np.arange(len(numbers)) & 4095]), np.zeros(STEPS + 1, np.uint64)]
        symbols[STEPS + 1 : STEPS + 1 + len(numbers)][numbers < 0] = 0
        found, windows = [np.zeros((0, 3), np.int64)], 0
        for group, (keys, item, offset, bits) in self.tables.items():
            every = np.flatnonzero(self.anchored[group][np.maximum(numbers, 0)])
            windows += len(every)
            for part in np.split(every, range(BLOCK_WINDOWS, len(every), BLOCK_WINDOWS)):
                key = sketch(symbols, part + STEPS + 1, *group)
                row, rep = np.nonzero(bits[key & np.uint64(len(bits) - 1)])
                hit = key[row, rep]
                lo, hi = np.searchsorted(keys, hit, "left"), np.searchsorted(keys, hit, "right")
                n = hi - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                anchor = np.repeat(part[row], n)
                found.append(np.stack([item[at], anchor, anchor - offset[at]], 1))
        return np.concatenate(found), windows

    def matches(self, values: list[str]) -> list[list[tuple[int, int]]]:
        """For each text (item, edits) of the items with a passage in it."""
        found, numbers, begins = [], [], []
        gap = np.full(STEPS + 1, -1, np.int64)
        for text in values:
            ws = tokens(text)
            begins.append(len(found))
            found += ws
            found += [""] * len(gap)
            numbers += [np.fromiter(map(self.number.get, ws, repeat(0)), np.int64, len(ws)), gap]
        out: list[dict[int, int]] = [{} for _ in values]
        if not values:
            return []
        begins = np.array(begins)
        near, _ = self.candidates(np.concatenate(numbers))
        near[:, 1] = np.searchsorted(begins, near[:, 1], "right") - 1  # the anchor's document
        for k, doc, s in np.unique(near, axis=0).tolist():
            n, d = len(self.words[k]), allowed(len(self.words[k]))
            low, high = int(begins[doc]), int(begins[doc + 1] if doc + 1 < len(begins) else len(found)) - len(gap)
            region = found[max(low, s - d) : min(high, s + n + d)]
            limit = out[doc].get(k, d + 1) - 1
            if limit < 0 or (self.bags[k] & Counter(region)).total() < n - limit:
                continue
            e = edits(self.words[k], region, limit)
            if e is not None:
                out[doc][k] = e
        return [sorted(x.items()) for x in out]


LEAKS = arrow_schema("doc_id long,item_id long,n_words int,edits int")


def item_blocks(benchmark: DataFrame):
    """Broadcasts of the items with an id and a text, in blocks of about BLOCK_ITEMS by hash of their id."""
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").distinct()
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # about BLOCK_ITEMS items
        yield benchmark.sparkSession.sparkContext.broadcast(Items([(r.item_id, r.text) for r in rows]))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, edits): documents that hold a passage within EDIT_SHARE of an item's words.

    Words are lower-cased runs of letters, digits and underscores. Items under five words must occur unchanged; items without
    words, null texts and null item ids match nothing. Repeated rows give one row. Each block of items is a pass over the documents.
    """
    found = None
    for shared in item_blocks(benchmark):

        def search(batches, shared=shared):
            block = shared.value
            for b in batches:
                out = [(i, block.ids[k], len(block.words[k]), e) for i, found in zip(b.column("doc_id").to_pylist(), block.matches(texts(b))) for k, e in found]
                if out:
                    yield batch_of(LEAKS, *map(list, zip(*out)))

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, "doc_id long, item_id long, n_words int, edits int")
        found = part if found is None else found.union(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.min("edits").alias("edits"))


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark passage (see ``leaks``).

    Every row is judged by its own text, so clean rows stay whatever rows share their id, null ids included. Nothing is
    shuffled; what one block of items leaves is written before the next block is taken.
    """
    for k, shared in enumerate(item_blocks(benchmark)):
        if k:
            docs = materialize(docs)

        def clean(batches, shared=shared):
            for b in batches:
                yield b.filter(pa.array([not x for x in shared.value.matches(texts(b))], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
