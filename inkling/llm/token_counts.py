"""Token counts of a sentencepiece BPE model by rank-synchronous merging of ragged numpy arrays.

A text is cut where no piece of the vocabulary can reach across, distinct pre-tokens of a batch become
one flat symbol array with sequence numbers, and every round merges the lowest-rank pair of each
sequence at once until no pair is left. Symbols without a piece count as their UTF-8 bytes.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, arrow_schema, batch_of, table, texts

SPACE = "▁"
NO_RANK = np.int64(2**62)


class PieceTable:
    """Ranks of mergeable symbol pairs, as sorted arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        ids = {model.id_to_piece(i): i for i in usable}
        self.size = model.vocab_size()
        chars = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
        self.chars = np.array([c for c, _ in chars], np.int64)
        self.char_ids = np.array([i for _, i in chars], np.int64)
        pairs = []
        for piece, i in ids.items():
            if re.search(rf"[^{SPACE}]{SPACE}", piece) or "\n" in piece:
                raise ValueError("a piece reaches across a cut")
            rank = -model.get_score(i)
            pairs += [(ids[piece[:k]] * self.size + ids[piece[k:]], rank, i) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        self.fill_slots(np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.float64).astype(np.int64), np.array([p[2] for p in pairs], np.int64))

    BITS = 21

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def fill_slots(self, key: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        """An open hash table in arrays; ``probes`` is the longest way from a key's slot to its place."""
        size, self.probes = 1 << self.BITS, 0
        self.keys, self.ranks, self.merged = np.full(size, -1, np.int64), np.full(size, NO_RANK, np.int64), np.zeros(size, np.int64)
        at = self.slot(key)
        while len(key):
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == -1)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.ranks[at[put]], self.merged[at[put]] = key[put], rank[put], merged[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, rank, merged, at = key[rest], rank[rest], merged[rest], (at[rest] + 1) % size

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_RANK: none) and merged id of pairs; negative ids never merge."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -2)
        at = self.slot(key)
        there = self.keys[at]
        lost = np.flatnonzero((there != key) & (there != -1))
        for _ in range(self.probes - 1):
            if not len(lost):
                break
            at[lost] = (at[lost] + 1) % len(self.keys)
            there = self.keys[at[lost]]
            lost = lost[(there != key[lost]) & (there != -1)]
        ok = self.keys[at] == key
        return np.where(ok, self.ranks[at], NO_RANK), self.merged[at]

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        out = np.zeros(len(pretokens), np.int64)
        lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        points = np.frombuffer("".join(pretokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        known = self.chars[at] == points
        sym = np.where(known, self.char_ids[at], -1)
        # An unknown character stays apart and counts as its bytes; it weighs one symbol already.
        seq = np.repeat(np.arange(len(pretokens)), lengths)
        extra = np.where(known, 0, (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))
        np.add.at(out, seq, extra)
        while len(sym):
            sym, seq, done = self.merge_round(sym, seq)
            if len(done):
                out += np.bincount(done, minlength=len(out))
        return out

    def merge_round(self, sym: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One merge in each sequence (or all equal ones where that comes to the same); also the symbols of finished sequences."""
        if len(sym) < 2:
            return sym[:0], seq[:0], seq
        rank, merged = self.pair(sym[:-1], sym[1:])
        rank = np.where(seq[:-1] == seq[1:], rank, NO_RANK)
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        best = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)
        size = np.diff(np.r_[starts, len(seq)])
        best_of = np.repeat(best, size)
        hit = (rank == best_of[:-1]) & (rank < NO_RANK)
        # Overlapping hits: every other one of a run, from its left end.
        where = np.flatnonzero(hit)
        if len(where):
            run = np.cumsum(np.r_[True, (np.diff(where) != 1) | (seq[where[1:]] != seq[where[:-1]])])
            first = np.r_[True, run[1:] != run[:-1]]
            place = np.arange(len(where)) - np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))
            where = where[place % 2 == 0]
            where = self.safe(sym, seq, where, merged[where], best_of[where])
            sym = sym.copy()
            sym[where] = merged[where]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
        else:
            keep = np.ones(len(sym), bool)
        active = np.repeat(best < NO_RANK, size)
        return sym[keep & active], seq[keep & active], seq[keep & ~active]

    def safe(self, sym, seq, where, new, best):
        """Keep all hits of a sequence only if no pair that a merge makes ranks at or below the present one; else the leftmost."""
        several = np.r_[seq[where[1:]] == seq[where[:-1]], False] | np.r_[False, seq[where[1:]] == seq[where[:-1]]]
        if not several.any():
            return where
        n = len(sym)
        risky = np.zeros(len(where), bool)
        left, right = np.maximum(where - 1, 0), np.minimum(where + 2, n - 1)
        has_left, has_right = (where > 0) & (seq[left] == seq[where]), (where + 2 < n) & (seq[right] == seq[where])
        risky |= has_left & (self.pair(sym[left], new)[0] <= best)
        risky |= has_right & (self.pair(new, sym[right])[0] <= best)
        touching = np.r_[False, where[1:] == where[:-1] + 2] & np.r_[False, seq[where[1:]] == seq[where[:-1]]]
        before = np.r_[0, new[:-1]]
        risky |= touching & (self.pair(before, new)[0] <= best)
        # The merged symbol beside the next hit's own left symbol is covered by sym[right]; beside the previous hit's right one by sym[left].
        bad = np.unique(seq[where[risky]])
        lead = np.r_[True, seq[where[1:]] != seq[where[:-1]]]
        return where[lead | ~np.isin(seq[where], bad)]


@lru_cache(maxsize=4)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


CUT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def count_texts(values: list[str], model: PieceTable, cache: BoundedCache) -> list[int]:
    """Tokens of each text. Pre-tokens of up to 64 characters are remembered."""
    cut = [CUT.findall(SPACE + x.replace(" ", SPACE)) if x else [] for x in values]
    fresh = {p for doc in cut for p in doc if p not in cache}
    cache.room_for(len(fresh))
    fresh = list(fresh if cache else {p for doc in cut for p in doc})
    found = dict(zip(fresh, model.count(fresh).tolist())) if fresh else {}
    cache.update(found)
    total = [sum(map(cache.__getitem__, doc)) + x.count("\n") for doc, x in zip(cut, values)]
    for p in found:
        if len(p) > 64:
            del cache[p]
    return total


OUT = arrow_schema("doc_id long,n_bytes long,n_tokens long,over_limit boolean")


def token_counts(docs: DataFrame, limit: int, model: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. A map over documents, without a shuffle.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted each. Other columns are ignored.
    """

    def count(batches):
        pieces, cache = piece_table(public_tokenizers.path(model)), BoundedCache()
        for b in batches:
            values = texts(b)
            n = np.array(count_texts(values, pieces, cache), np.int64)
            size = [len(x.encode("utf-8", "surrogatepass")) for x in values]
            yield batch_of(OUT, b.column("doc_id").cast(pa.int64()), size, n, n > limit)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), 4096)
