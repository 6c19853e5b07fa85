"""Runs of repeating words inside a document, by a dictionary of basic factors.

Method: the stretches of 1, 2, 4, ... words get names, the name of a stretch being that of the pair of its halves. Occurrences of
a name that follow each other within twice its length form arithmetic progressions; three terms propose their difference as a
period. A proposal is extended as far as words one period apart agree, and proposals of one run are met once.

Why nothing is missed: let q be the smallest period of a run of 4q words or more and L the least power of two with L >= q. Inside the
run a stretch of L >= q words recurs after q words and not earlier, q <= 2L, and three of them fit as 2q + L <= 4q. So names with fewer
than three occurrences can be forgotten at every length, which leaves next to nothing of ordinary text after a few lengths. As the
next occurrence is taken, a difference is never a multiple of a smaller period.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, table, texts, unused, words


def numbers(tokens: list[bytes]) -> np.ndarray:
    """Dense numbers of the words, equal for equal words."""
    known = {x: i for i, x in enumerate(dict.fromkeys(tokens))}
    return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))


def _frequent(names: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names, dense again, and positions of those that occur three times at least."""
    _, dense, counts = np.unique(names, return_inverse=True, return_counts=True)
    keep = counts[dense] >= 3
    return dense[keep], positions[keep]


def _proposals(names: np.ndarray, positions: np.ndarray, length: int) -> np.ndarray:
    """(period, position): heads of progressions of three successive occurrences within twice the length, one of neighbouring heads."""
    order = np.argsort(names, kind="stable")
    at, name = positions[order], names[order]
    gap = np.diff(at)
    near = (name[1:] == name[:-1]) & (gap <= 2 * length)
    three = near[1:] & near[:-1] & (gap[1:] == gap[:-1])
    found = np.stack([gap[:-1][three], at[:-2][three]], 1)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    if len(found) > 1:
        step = np.diff(found, axis=0)
        found = found[np.r_[True, (step[:, 0] != 0) | (step[:, 1] != 1)]]
    return found


def _agreeing(left: np.ndarray, right: np.ndarray) -> int:
    """How many leading elements of two arrays of one length agree."""
    at, width = 0, 64
    while at < len(left):
        differ = left[at : at + width] != right[at : at + width]
        if differ.any():
            return at + int(differ.argmax())
        at, width = at + width, width * 2
    return len(left)


def _extended(w: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch [start, end) around ``at`` in which words one period apart agree."""
    ahead = _agreeing(w[at : len(w) - period], w[at + period :])
    back = _agreeing(w[:at][::-1], w[period : at + period][::-1])
    return at - back, at + ahead + period


def find_runs(w: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """(start, length, period) of every run, by start and period: a stretch with smallest period ``period`` that no neighbouring word
    extends, of ``least`` words and ``times`` (4 or more) periods at least. ``w`` has the words' numbers; no words, no runs."""
    if times < 4:
        raise ValueError("runs of fewer than four periods need more occurrences than are kept")
    found, last, length = set(), {}, 1
    names, positions = _frequent(w, np.arange(len(w)))
    while len(names) and 2 * length <= len(w):
        for period, at in _proposals(names, positions, length).tolist():
            start, end = last.get(period, (0, 0))
            if not (start <= at and at + 2 * period + length <= end):
                last[period] = start, end = _extended(w, at, period)
            if end - start >= max(least, times * period):
                found.add((start, end - start, period))
        pair = np.searchsorted(positions, positions + length)
        both = pair < len(positions)
        both[both] = positions[pair[both]] == positions[both] + length
        names, positions = _frequent(names[both] * (int(names.max()) + 1) + names[pair[both]], positions[both])
        length *= 2
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Flags of the words that stay: of every run the first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest length in periods; of equal ones that of the smallest start, then period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:  # runs come by start and period, so the first of equal ones stays
            best = (start, length, period)
    return best


RUNS_DDL = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def with_runs(docs: DataFrame, runs: str = "runs", collapsed: str | None = None) -> DataFrame:
    """``docs`` with the runs of each whole text (start, length, period in words, by start then period) and, where named, the text in which
    every run is cut to its first period, words joined by one space.

    Null texts have no runs and stay null; empty ones stay empty. Rows are independent: ties and repeated rows get the same result
    each. Texts of any length are taken whole, in memory in proportion to their words. Nothing is shuffled; ``docs`` may have columns
    of any other name; an empty table gives an empty one.
    """
    fields = [f"`{runs}` {RUNS_DDL}"] + ([f"`{collapsed}` string"] if collapsed else [])
    out = docs.select("*", *[F.lit(None).cast(f.split("` ")[1]).alias(f[1:].split("` ")[0]) for f in fields]).schema

    def apply(batches):
        for b in batches:
            lists, cut = [], []
            for text in b.column("text").to_pylist():
                tokens = words(text or "")
                found = find_runs(numbers(tokens))
                lists.append([dict(zip(("start", "length", "period"), r)) for r in found.tolist()])
                if collapsed:
                    cut.append(None if text is None else text if not len(found) else b" ".join(t for t, k in zip(tokens, kept_words(len(tokens), found)) if k).decode())
            columns = [*b.columns, pa.array(lists, _RUNS)] + ([pa.array(cut, pa.string())] if collapsed else [])
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, runs, *([collapsed] if collapsed else [])])

    return docs.mapInArrow(apply, out)


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` in which every text with runs keeps their first periods alone; texts without runs stay as they are, and so do all other columns."""
    runs, text = unused(docs, "runs", "collapsed")
    return with_runs(docs, runs, text).withColumn("text", F.col(text)).select(*docs.columns)


def planted(tokens: list[bytes], h: int | None) -> list[bytes]:
    """The words in which the contract's query plants a repetition, for a tenth of the ids by their CRC-32."""
    n = len(tokens)
    if h is None or h % 10 or not n:
        return tokens
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = tokens[a : a + p]
    return tokens[:a] + (piece * -(-(n - a) // p))[: n - a]


DIGEST_DDL = "doc_id long,n_runs long,start long,length long,period long,exponent_milli long,runs_sha256 string,collapsed_sha256 string"
DIGEST = arrow_schema(DIGEST_DDL)


def _digest(batches):
    for b in batches:
        if not b.num_rows:
            continue
        rows = []
        for text, h in zip(texts(b), b.column("h").to_pylist()):
            tokens = planted(words(text), h)
            runs = find_runs(numbers(tokens))
            best = strongest(runs)
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
            kept = tokens if best is None else [t for t, k in zip(tokens, kept_words(len(tokens), runs)) if k]
            numbers_ = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
            rows.append((len(runs), *numbers_, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield batch_of(DIGEST, b.column("doc_id"), *zip(*rows))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every whole document, a repetition planted in a tenth of them by CRC-32 of the id.

    Null and empty texts have no words: no run, nulls, and the digests of nothing. A null doc_id gets no planted repetition. Repeated rows
    are judged each; of runs that are equally strong that of the smallest start, then period, is shown. Long texts are taken whole.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    return docs.mapInArrow(_digest, DIGEST_DDL)
