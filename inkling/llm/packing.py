"""Packing into sequences by a configuration linear program over the length histogram.

The driver sees only the histogram: at most ``capacity`` counts. The covering program (each variable a configuration, how many
sequences are filled that way) is solved by multiplicative weights: duals fall as their length gets covered, a knapsack by
dynamic programming prices configurations on the duals, and fractions add up over the rounds. Whole parts are taken, the
residual is solved again and at last goes to decreasing best fit; every pricing gives a lower bound. The plan, ranges of ranks
for each length, is bounded by configurations; every piece finds its place from its rank among pieces of its length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, materialize, table, texts

PIECES = arrow_schema("doc_id long,piece int,start long,length long,ids_crc32 long,part int,rank long")
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"

#: Pieces of text and characters that a worker remembers at most before it starts afresh.
KNOWN_WORDS, KNOWN_CHARS = 500_000, 32_000_000

#: Chunks of ASCII and Latin-1 letters: lower-casing changes one letter to one, and nothing composes.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")

#: The tokenizer's pre-tokens in such lower-cased chunks; each is encoded by itself, whatever stands around it.
PRE_TOKEN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class Ids:
    """Numbers of strings and, by number, runs of ids in one array."""

    def __init__(self):
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.known = self.used = 0
        self.first, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    def numbers(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))

    def fresh(self) -> list[str]:
        """Strings that have a number but no ids yet, in order."""
        return list(islice(reversed(self.number), len(self.number) - self.known))[::-1]

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of the fresh strings, one after another."""
        a, b = self.known, self.known + len(sizes)
        while b > len(self.first):
            self.first, self.size = np.r_[self.first, np.zeros_like(self.first)], np.r_[self.size, np.zeros_like(self.size)]
        while self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[a:b], self.first[a:b] = sizes, self.used + np.cumsum(sizes) - sizes
        self.known, self.used = b, self.used + len(ids)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the numbered strings one after another, and the end of each string's."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        at = np.arange(int(size.sum())) + np.repeat(self.first[numbers] - ends + size, size)
        return self.ids[at], ends


class Encoder:
    """Ids of texts.

    The tokenizer cuts at white space, so chunks between ASCII white space encode on their own, and so do the pre-tokens of
    plain ones. Every distinct chunk and pre-token is looked at once; texts are gathered from the numbers of their chunks.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.chunks, self.parts = tokenizer, None, None
        vocabulary = tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        for old in (self.chunks, self.parts):
            if old:
                old.number.default_factory = None  # it refers to its dict, which would else stay until a full collection
        self.chunks, self.parts, self.chars = Ids(), Ids(), 0

    def learn(self) -> None:
        """Find the ids of the fresh chunks."""
        parts, odd, ends = [], [], []
        for chunk in self.chunks.fresh():
            self.chars += len(chunk)
            if PLAIN.fullmatch(chunk) and "<|" not in chunk:
                parts += PRE_TOKEN.findall(chunk.lower())
            else:  # other characters, or perhaps a special string: as it is
                parts.append(chunk)
                odd.append(chunk)
            ends.append(len(parts))
        numbers, odd = self.parts.numbers(parts), set(odd)
        fresh = self.parts.fresh()
        own = [x for x in fresh if x in odd]
        joined = " ".join([x for x in fresh if x not in odd]) if own else " ".join(fresh)
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        sizes = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)  # a pre-token ends with its one closing piece
        if own:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
            alone = np.array([x in odd for x in fresh])
            every = np.zeros(len(fresh), np.int64)
            every[~alone], every[alone] = sizes, list(map(len, found))
            merged, of_alone = np.zeros(int(every.sum()), np.uint32), np.repeat(alone, every)
            merged[~of_alone], merged[of_alone] = ids, [i for x in found for i in x]
            ids, sizes = merged, every
        self.parts.add(ids, sizes)
        ids, after = self.parts.gather(numbers)
        self.chunks.add(ids, np.diff(np.r_[0, after][np.array([0, *ends])]))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the end of each text's; null is empty."""
        if max(self.chunks.known, self.parts.known) > KNOWN_WORDS or self.chars > KNOWN_CHARS:
            self.forget()
        cut = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        coded = cut.flatten().dictionary_encode()
        numbers = self.chunks.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        if self.chunks.known < len(self.chunks.number):
            self.learn()
        ids, after = self.chunks.gather(numbers)
        return ids, np.r_[0, after][np.cumsum(pc.list_value_length(cut).to_numpy())]


@lru_cache(maxsize=1)
def encoder(tokenizer: str) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    from tokenizers import Tokenizer

    return Encoder(Tokenizer.from_file(public_tokenizers.path(tokenizer)))


def pieces(docs: DataFrame, capacity: int, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Each document's ids and a closing 0, cut at ``capacity``; with the task it came from and its rank there among its length."""

    def cut(batches):
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows, at = [], 0
            ids, ends = encode(b.column("text"))
            for doc_id, end in zip(b.column("doc_id").to_pylist(), ends.tolist()):
                closed = np.append(ids[at:end], 0).astype("<u4")
                at = end
                for k, start in enumerate(range(0, len(closed), capacity)):
                    own = closed[start : start + capacity]
                    rows.append((doc_id, k, start, len(own), zlib.crc32(own), part, seen[len(own)]))
                    seen[len(own)] += 1
            if rows:
                yield batch_of(PIECES, *map(list, zip(*rows)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES_DDL)


def knapsack(by_length: np.ndarray, capacity: int) -> np.ndarray:
    """The best value for each room up to ``capacity``; ``by_length`` has the value of a piece of each length."""
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max(best[c - 1], (by_length[1 : c + 1] + best[c - 1 :: -1][:c]).max())
    return best


def filling(best: np.ndarray, by_length: np.ndarray, room: int, first: int, pieces_left: np.ndarray) -> tuple[dict[int, int], float]:
    """Counts by length of a near best filling that holds ``first`` and uses no length beyond ``pieces_left``, and its value."""
    config, worth = {first: 1}, by_length[first]
    room -= first
    while room > 0:
        gain = by_length[1 : room + 1] + best[room - 1 :: -1][:room]
        size = int(gain.argmax()) + 1
        if config.get(size, 0) + 1 > pieces_left[size] and (size in config or pieces_left[size] <= 1e-9):
            gain = np.where(pieces_left[1 : room + 1] > 1e-9, gain, 0.0)
            for used, n in config.items():
                if used <= room and n + 1 > pieces_left[used]:
                    gain[used - 1] = 0.0
            size = int(gain.argmax()) + 1
            if gain[size - 1] <= 0.0:
                break
        if by_length[size] <= 0.0:
            break
        config[size] = config.get(size, 0) + 1
        worth += by_length[size]
        room -= size
    return config, worth


def program(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, sharpness: float, near: float, limit: int, until: float = 1.0) -> tuple[dict[tuple, float], float]:
    """A fractional solution of the covering program, by configuration, and the best dual bound met on the way.

    Minimise the sum of x over configurations such that every length is covered ``demand`` times. Duals start at the
    lengths' shares of the capacity and fall by exp(-sharpness * share covered), so that lagging lengths gain. Each
    round prices by a knapsack: of the best configurations that hold a given length, those within ``near`` of the best of all
    get fractions, most lagging first, until a round's share of the volume is spent; no length gets more than a round's share
    of its demand or three pieces. Where nothing is near enough, more waste is allowed. The
    solution ends when all is covered, the share ``until`` of the volume is, or after ``limit`` rounds. Duals over the knapsack's
    optimum are feasible, so their worth is a lower bound.
    """
    place = {int(x): i for i, x in enumerate(lengths)}
    x: dict[tuple, float] = defaultdict(float)
    left, bound, slack = demand.astype(float), 0.0, near
    by_length, pieces_left = np.zeros(capacity + 1), np.zeros(capacity + 1)
    share = np.maximum(demand / rounds, 3.0)
    whole = float(lengths @ demand)
    volume = max(1.0, whole / capacity / rounds)
    for _ in range(limit):
        open_ = left > 1e-9
        if not open_.any() or left @ lengths < (1 - until) * whole:
            break
        dual = np.where(open_, lengths / capacity * np.exp(-sharpness * (1 - left / demand)), 0.0)
        by_length[lengths] = dual
        best = knapsack(by_length, capacity)
        bound = max(bound, float(dual @ demand) / best[capacity])
        total, budget = dual + best[capacity - lengths], volume
        good = np.flatnonzero(open_ & (total >= (1 - slack) * best[capacity]))
        pieces_left[lengths] = np.minimum(share, left)
        spent = 0
        for first in good[np.argsort(-left[good] / demand[good], kind="stable")].tolist():
            while budget > 1e-9 and pieces_left[lengths[first]] > 1e-9:
                config, worth = filling(best, by_length, capacity, int(lengths[first]), pieces_left)
                if worth < (1 - slack) * best[capacity]:
                    break
                times = min([budget] + [pieces_left[size] / n for size, n in config.items()])
                if times <= 1e-9:
                    break
                times = times if times < 1 else float(int(times))
                for size, n in config.items():
                    pieces_left[size] -= n * times
                    left[place[size]] = max(0.0, left[place[size]] - n * times)
                x[tuple(sorted(config.items()))] += times
                budget -= times
                spent += times
        slack = near if spent else 4 * slack
        if slack > 1:
            break
    return x, bound


#: Runs of the program: rounds, sharpness, nearness, most pricings of each solution, and the share of the volume that it takes before
#: the rest, an even mix, goes to best fit. Where the first leaves a gap to the bound, the second follows.
RUNS = ((40, 1.0, 0.001, (150, 40), 1.0), (40, 0.2, 0.0005, (120,), 0.6))


def rounded(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, sharpness: float, near: float, limits: tuple[int, ...], until: float) -> tuple[list, float]:
    """A plan from the program, and the bound of its first solution.

    Whole parts are taken, then one more of each in the order of what was cut off, where it wastes little and the demand has
    all its pieces; the residual is solved anew, and its rest goes to best fit.
    """
    left, plan, bound = demand.astype(np.int64), [], 0.0
    where = {int(size): i for i, size in enumerate(lengths)}
    for phase, limit in enumerate(limits):
        here = np.flatnonzero(left)
        before = int(left.sum())
        if not before:
            break
        x, lower = program(lengths[here], left[here], capacity, rounds, sharpness, near, limit, until)
        bound = bound if phase else lower
        fractions = [({where[size]: k for size, k in config}, n) for config, n in x.items()]
        full = (1 - near) * capacity
        up = sorted((c for c in fractions if sum(int(lengths[i]) * k for i, k in c[0].items()) >= full), key=lambda c: -(c[1] % 1))
        for config, n in [(c, int(n + 1e-9)) for c, n in fractions] + [(c, 1) for c, _ in up]:
            n = min([n] + [int(left[i]) // k for i, k in config.items()])
            if n:
                plan.append((config, n))
                for i, k in config.items():
                    left[i] -= k * n
        if left.sum() == before:
            break
    return plan + best_fit(lengths, left, capacity), bound


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, runs=RUNS) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Configurations (place -> count) with how often each is used, covering ``demand`` exactly, and a lower bound on their number.

    The best of the runs' plans and, where those are worse, of best fit alone; runs end when a plan is within a sequence or a two-thousandth of the bound.
    """
    worth = lambda plan: sum(n for _, n in plan)
    plan, bound = best_fit(lengths, demand.astype(np.int64), capacity), 0.0
    for run in runs:
        found, lower = rounded(lengths, demand, capacity, *run)
        plan, bound = min(found, plan, key=worth), max(bound, lower)
        if worth(plan) <= max(np.ceil(bound - 1e-6) + 1, bound * 1.0005):
            break
    return plan, bound


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Decreasing best fit over the histogram; equal sequences are packed together, so work follows lengths rather than rows."""
    open_: list[tuple[int, int]] = []  # (room, group), sorted
    groups: list[list] = []  # [configuration, number of sequences]
    for i in np.argsort(-lengths):
        n, size = int(left[i]), int(lengths[i])
        while n:
            at = bisect.bisect_left(open_, (size, -1))
            if at == len(open_):
                each = capacity // size
                full, rest = divmod(n, each)
                for count, times in ((each, full), (rest, 1 if rest else 0)):
                    if times:
                        groups.append([{i: count}, times])
                        bisect.insort(open_, (capacity - size * count, len(groups) - 1))
                n = 0
                continue
            room, g = open_.pop(at)
            config, times = groups[g]
            each = min(room // size, n)
            use = min(times, n // each)
            if use < times:
                groups[g][1] = times - use
                bisect.insort(open_, (room, g))
                groups.append([dict(config), use])
                g = len(groups) - 1
            groups[g][0][i] = groups[g][0].get(i, 0) + each
            bisect.insort(open_, (room - size * each, g))
            n -= each * use
    return [(c, t) for c, t in groups]


def layout(lengths: np.ndarray, plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks, number of sequences, first sequence and offset of its ranges."""
    rows: dict[int, list] = {int(x): [] for x in lengths}
    used = {int(x): 0 for x in lengths}
    sequence = 0
    for config, times in plan:
        offset = 0
        for i, n in sorted(config.items()):
            size = int(lengths[i])
            for _ in range(n):
                rows[size].append((used[size], times, sequence, offset))
                used[size] += times
                offset += size
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in rows.items() if v}


PLACED = arrow_schema("doc_id long,piece int,start long,length long,ids_crc32 long,sequence_id long,offset long")


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, the closing 0. Pieces of ``capacity`` fill a sequence each. Repeated rows are packed
    each. An empty table gives an empty table.
    """
    cut = materialize(pieces(docs, capacity, tokenizer))
    counts = materialize(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = sorted((r.length, r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect())  # at most capacity rows
    lengths, demand = (np.array([r[k] for r in histogram], np.int64) for k in (0, 1))
    places = layout(lengths, solve(lengths, demand, capacity)[0]) if histogram else {}
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    shared = docs.sparkSession.sparkContext.broadcast(places)  # bounded by configurations times capacity

    def place(batches):
        plan = shared.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                first, times, base, at = plan[int(size)]
                k = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine], offset[mine] = base[k] + (rank[mine] - first[k]) % times[k], at[k]
            yield batch_of(PLACED, *(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), sequence, offset)

    # A row for each task and length: never broadcast.
    ranked = cut.join(before.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
