"""Merkle manifest of a table: a root over sources, and for every row a proof that it belongs to it.

Method: incremental witnesses. Leaves of a source are appended in order to open runs of 16. When the last sibling of a run comes, its
digests extend the witnesses of all leaves below at once: a witness is kept for the open subtree and not for each leaf, so
an extension is one text of the run. Leaves are dealt to aligned blocks of 16**3; each block is such a stream, wherever it runs, and
its root is appended to the stream of the block above, until a source has one node, and the nodes of the sources likewise. The
witness of a block's root then extends those of the block's leaves.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, batch_of, materialize, row_id, shuffle_partitions, table

#: Nodes in a run, and the levels that one block covers.
FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS

LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes: int) -> int:
    """Levels above ``nodes`` nodes until one remains."""
    levels = 0
    while FAN**levels < nodes:
        levels += 1
    return levels


class Frontier:
    """A stream of appended digests: at each level the open run, and the closed ones, whose texts are the extensions of the witnesses below."""

    def __init__(self):
        self.open: list[list[str]] = [[]]
        self.closed: list[list[str]] = [[]]

    def append(self, node: str, level: int = 0) -> None:
        self.open[level].append(node)
        if len(self.open[level]) == FAN:
            self._close(level)

    def _close(self, level: int) -> None:
        if level + 1 == len(self.open):
            self.open.append([])
            self.closed.append([])
        text = "".join(self.open[level])
        self.closed[level].append(text)
        self.open[level] = []
        self.append(digest(text), level + 1)

    def finish(self, levels: int) -> str:
        """Close what is open below ``levels``; the one node left."""
        for level in range(levels):
            if self.open[level]:
                self._close(level)
        return self.open[levels][0]

    def witness(self, i: int, levels: int) -> tuple[list[str], list[str]]:
        """What stands left and right of the path from leaf ``i``, level by level."""
        left, right = [], []
        for level in range(levels):
            run, child = divmod(i // FAN**level, FAN)
            text = self.closed[level][run]
            left.append(text[: 64 * child])
            right.append(text[64 * (child + 1) :])
        return left, right


def folded(node: str, left: list[str], right: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for a, b in zip(left, right):
        node = digest(a + node + b)
    return node


def leaf(columns: dict[str, Column]) -> Column:
    """Digest of a row: every value as its bytes in UTF-8, their number before it; "-" for null."""
    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[told(columns[c]) for c in LEAF_COLUMNS]), 256)


def _numbered(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``nodes`` with _i, the rank from 0 within the group, and _total, the nodes of the group; hot groups spread over ranges.

    Null is a group of its own. Each range counts its groups; the counts before a range are carried into it.
    """
    nodes = materialize(nodes)  # range partitioning reads its input twice
    rows = nodes.repartitionByRange(shuffle_partitions(nodes.sparkSession), group, *order).withColumn("_part", F.spark_partition_id())
    rows = materialize(rows)
    by = Window.partitionBy(group)
    carried = rows.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_part").alias("_cp"), F.col(group).alias("_cg"), F.coalesce(F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(by).alias("_total")
    )
    within = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order)) - 1
    met = rows.withColumn("_i", within).join(carried, (F.col("_part") == F.col("_cp")) & F.col(group).eqNullSafe(F.col("_cg")))
    return met.withColumn("_i", (F.col("_i") + F.col("_before")).cast("long")).drop("_part", "_cp", "_cg", "_before")


STREAMED = "_group string, _block long, _total long, node string, parts array<struct<i: bigint, id: bigint, node: string, other: string>>, closed array<array<string>>"
_PART = pa.struct([("i", pa.int64()), ("id", pa.int64()), ("node", pa.string()), ("other", pa.string())])
_STREAMED = pa.schema([("_group", pa.string()), ("_block", pa.int64()), ("_total", pa.int64()), ("node", pa.string()), ("parts", pa.list_(_PART)), ("closed", pa.list_(pa.list_(pa.string())))])


def _levels(total: int) -> int:
    return min(LEVELS, levels_of(total))


def _append(batches):
    """A row for each block: its root and the extensions of its nodes' witnesses."""
    for b in batches:
        roots, closed = [], []
        for parts, total in zip(b.column("parts").to_pylist(), b.column("_total").to_pylist()):
            stream = Frontier()
            for p in parts:
                stream.append(p["node"])
            roots.append(stream.finish(_levels(total)))
            closed.append(stream.closed[: _levels(total)])
        yield batch_of(_STREAMED, b.column("_group"), b.column("_block"), b.column("_total"), roots, b.column("parts").cast(pa.list_(_PART)), closed)


def _streamed(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes (_group, _i, _total, id, node, other), each appended in order by one task; written once."""
    part = F.struct(F.col("_i").alias("i"), "id", "node", "other")
    blocks = nodes.groupBy("_group", F.floor(F.col("_i") / BLOCK).alias("_block"), "_total").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return materialize(blocks.select("_group", "_block", "_total", "parts").mapInArrow(_append, STREAMED))


def _tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Streams of each height and the last nodes (_group, node): one for each group. One number a height comes to the driver."""
    heights = []
    while True:
        heights.append(_streamed(nodes))
        roots = heights[-1].withColumn("_total", F.ceil(F.col("_total") / BLOCK))
        if heights[-1].agg(F.max("_total")).first()[0] in (None, *range(BLOCK + 1)):
            return heights, roots.select("_group", "node")
        none = F.lit(None)
        nodes = roots.select("_group", F.col("_block").alias("_i"), "_total", none.cast("long").alias("id"), "node", none.cast("string").alias("other"))


EXTENDED = "_group string, i long, id long, node string, other string, `left` array<string>, `right` array<string>"
_EXTENDED = pa.schema([("_group", pa.string()), ("i", pa.int64()), ("id", pa.int64()), ("node", pa.string()), ("other", pa.string()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])


def _extend(batches):
    """A row for each node of a block, its witness being that within the block and then that of the block's root."""
    for b in batches:
        for x in b.to_pylist():
            stream, levels = Frontier(), _levels(x["_total"])
            stream.closed = x["closed"]
            both = [stream.witness(p["i"] % BLOCK, levels) for p in x["parts"]]
            above = x["left"] or [], x["right"] or []
            for at in range(0, len(both), 256):
                some, parts = both[at : at + 256], x["parts"][at : at + 256]
                yield batch_of(_EXTENDED, [x["_group"]] * len(some), *[[p[k] for p in parts] for k in ("i", "id", "node", "other")], [w + above[0] for w, _ in some], [w + above[1] for _, w in some])


def _witnessed(heights: list[DataFrame], above: DataFrame) -> DataFrame:
    """Witnesses of the lowest nodes, from those (_group, left, right) of the groups' last nodes down through the heights."""
    met = above.select(F.col("_group").alias("_ag"), F.lit(0).cast("long").alias("_ab"), "left", "right")
    for blocks in reversed(heights):
        joined = blocks.join(met, F.col("_group").eqNullSafe(F.col("_ag")) & (F.col("_block") == F.col("_ab")), "left").drop("_ag", "_ab")
        below = joined.mapInArrow(_extend, EXTENDED)
        met = below.select(F.col("_group").alias("_ag"), F.col("i").alias("_ab"), "left", "right")
    return below


def manifest(leaves: DataFrame) -> DataFrame:
    """(source, id, leaf, other, subroot, root, left, right): witnesses of all rows of ``leaves`` (source string, id long, leaf string, other string).

    Leaves of a source ascend by id, then leaf, then ``other`` (any text that is carried): equal rows are leaves each, null ids come
    first. Sources ascend by their bytes, null first. left and right are the siblings' digests, joined, level by level up to the
    root (see ``folded``). An empty table gives an empty one. A block's 4,096 digests are the most that one row or task step holds.
    """
    slim = leaves.select(F.col("source").alias("_group"), row_id("id").alias("id"), F.col("leaf").alias("node"), "other")
    nodes = _numbered(slim, "_group", ["id", "node", "other"])
    heights, last = _tree(nodes)
    last = materialize(last)
    one = last.select(F.lit("").alias("_one"), F.coalesce(F.concat(F.lit("s"), "_group"), F.lit("")).alias("name"), "node")
    ranked = _numbered(one, "_one", ["name"]).select(F.col("_one").alias("_group"), "_i", "_total", F.lit(None).cast("long").alias("id"), "node", F.col("name").alias("other"))
    tops, root = _tree(ranked)
    none = F.array().cast("array<string>")
    sources = _witnessed(tops, root.select("_group", none.alias("left"), none.alias("right")))
    sources = materialize(sources.crossJoin(F.broadcast(root.select(F.col("node").alias("root")))))  # the root is one row
    group = F.when(F.col("other") != "", F.substring("other", 2, 2**31 - 1))
    below = _witnessed(heights, sources.select(group.alias("_group"), "left", "right"))
    named = sources.select(group.alias("_sg"), F.col("node").alias("subroot"), "root")
    met = below.join(named, F.col("_group").eqNullSafe(F.col("_sg"))).drop("_sg")
    real = F.when(F.col("id") != NULL_ID, F.col("id"))
    return met.select(F.col("_group").alias("source"), real.alias("id"), F.col("node").alias("leaf"), "other", "subroot", "root", "left", "right")


DIGEST_DDL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_DIGEST = pa.schema([("doc_id", pa.int64()), *[(n, pa.string()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])


def _verify(batches):
    for b in batches:
        lefts, rights = b.column("left").to_pylist(), b.column("right").to_pylist()
        proofs = [digest("".join([s for pair in zip(x, y) for s in pair])) for x, y in zip(lefts, rights)]
        roots = b.column("root").to_pylist()
        again = [folded(node, x, y) for node, x, y in zip(b.column("other").to_pylist(), lefts, rights)]
        yield batch_of(_DIGEST, b.column("id"), b.column("leaf"), b.column("subroot"), roots, proofs, again, [x == y for x, y in zip(roots, again)])


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents, each row's proof checked against its leaf, tampered with in a fifth of the rows by CRC-32 of the id.

    Tampering lower-cases A-Z in the text, so rows without a capital still verify; a null id is never tampered with. Texts are hashed
    whole where they are read and not shuffled. Null values have a mark of their own, so that null and empty text differ.
    """
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    columns = {c: F.col(c) for c in LEAF_COLUMNS}
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    leaves = docs.select("source", F.col("doc_id").alias("id"), leaf(columns).alias("leaf"), F.when(touched, leaf(columns | {"text": lower})).alias("_t"))
    leaves = leaves.select("source", "id", "leaf", F.coalesce("_t", "leaf").alias("other"))
    return manifest(leaves).mapInArrow(_verify, DIGEST_DDL)
