"""Line dedup across documents by range-partitioned hashes.

Method: line hashes are range-partitioned on (hash, document, position) and sorted; each partition streams
its rows once and keeps the first document of every hash. A hash that runs over a partition's end is the only
one whose first document may lie elsewhere: those few heads meet in a small aggregate. A very frequent line
thus spreads over as many partitions as it fills. The result is a compressed keep bitmap per document.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, arrow_schema, batch_of, materialize, row_id, shuffle_partitions, table, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What a streamed row says: drop this line; drop it if an earlier partition holds the hash; the partition's last hash starts here.
DROP, PENDING, TAIL = 0, 1, 2


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), UPPER, LOWER)


def keyed(docs: DataFrame) -> DataFrame:
    """(_id, _tkey, text) of every row: repeated ids with other texts stay apart, equal rows share their verdicts. Null ids come first."""
    return docs.select(row_id().alias("_id"), F.xxhash64("text").alias("_tkey"), "text")


STREAM = arrow_schema("kind int,h1 long,h2 long,_id long,_tkey long,pos int")
STREAM_DDL = "kind int, h1 long, h2 long, _id long, _tkey long, pos int"


def _stream(batches):
    """Rows of one sorted partition, a batch at a time; only the current hash and its first document are carried."""
    last = head = first = None
    for b in batches:
        h1, h2, doc, tkey, pos = (b.column(c).to_numpy() for c in ("h1", "h2", "_id", "_tkey", "pos"))
        if not len(h1):
            continue
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        group = np.cumsum(new) - 1
        heads = doc[new]
        if last == (h1[0], h2[0]):
            heads = heads.copy()
            heads[0] = head
        if first is None:
            first = (h1[0], h2[0])
        in_first = (h1 == first[0]) & (h2 == first[1])
        dropped = doc != heads[group]
        out = dropped | in_first
        yield batch_of(STREAM, np.where(dropped, DROP, PENDING)[out].astype(np.int32), h1[out], h2[out], doc[out], tkey[out], pos[out])
        last, head = (h1[-1], h2[-1]), heads[group[-1]]
    if last is not None:
        yield batch_of(STREAM, [TAIL], [last[0]], [last[1]], [head], [0], [0])


BITMAP = arrow_schema("_id long,_tkey long,bitmap binary")


def _pack(batches):
    for b in batches:
        maps = []
        for positions in b.column("positions").to_pylist():
            bits = np.ones((max(positions) // 8 + 1) * 8, bool)
            bits[positions] = False
            maps.append(zlib.compress(np.packbits(bits).tobytes()))
        yield batch_of(BITMAP, b.column("_id"), b.column("_tkey"), pa.array(maps, pa.binary()))


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Keep flags of the lines; lines past the end of a bitmap are kept."""
    keep = np.ones(n_lines, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        keep[: len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(_id, _tkey, bitmap) of every document that loses a line: zlib-packed bits, 1 for keep.

    Lines whose key (see ``line_key``) has at least ``min_chars`` code points and occurs in several documents
    stay in the smallest id only. Null text counts as one empty line. Rows with one doc_id count as one document.
    """
    parts = shuffle_partitions(docs.sparkSession)
    lines = (
        keyed(docs)
        .select("_id", "_tkey", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .filter(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "_id", "_tkey", "pos")
    )
    order = ["h1", "h2", "_id", "_tkey", "pos"]
    lines = materialize(lines)  # range partitioning reads its input twice, once to find the ranges
    streamed = materialize(lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_stream, STREAM_DDL))
    # At most two hashes for each partition.
    heads = streamed.filter(F.col("kind") != DROP).groupBy("h1", "h2").agg(F.min("_id").alias("head"))
    late = streamed.filter(F.col("kind") == PENDING).join(F.broadcast(heads), ["h1", "h2"]).filter(F.col("_id") > F.col("head"))
    drops = streamed.filter(F.col("kind") == DROP).select("_id", "_tkey", "pos").union(late.select("_id", "_tkey", "pos"))
    return drops.groupBy("_id", "_tkey").agg(F.collect_set("pos").alias("positions")).mapInArrow(_pack, "_id long, _tkey long, bitmap binary")


def with_bitmaps(docs: DataFrame, min_chars: int = 10, bitmap: str = "bitmap") -> DataFrame:
    """``docs`` with a column named ``bitmap``, null where every line stays. The text is shuffled once; no other column is touched."""
    i, t = unused(docs, "_id", "_tkey")
    maps = keep_bitmaps(docs, min_chars).toDF(i, t, bitmap)
    return docs.withColumns({i: row_id(), t: F.xxhash64("text")}).join(maps, [i, t], "left").drop(i, t)


def kept_text(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
    """Lines, dropped lines and the text that stays."""
    lines = (text or "").split("\n")
    if not bitmap:
        return len(lines), 0, text or ""
    keep = unpack(bitmap, len(lines))
    return len(lines), int((~keep).sum()), "\n".join(x for x, k in zip(lines, keep) if k)


DIGEST = arrow_schema("doc_id long,n_lines long,n_dropped long,kept_sha256 string")


def _digest(batches):
    for b in batches:
        kept = [kept_text(t, m) for t, m in zip(b.column("text").to_pylist(), b.column("bitmap").to_pylist())]
        sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for _, _, x in kept]
        yield batch_of(DIGEST, b.column("doc_id"), [n for n, _, _ in kept], [d for _, d, _ in kept], sha)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return with_bitmaps(docs).select("doc_id", "text", "bitmap").mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


KEPT = arrow_schema("text string,n_chars long")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with the text (and n_chars) that stays. Null texts stay null; other columns, of whatever names, are carried."""
    schema, (bitmap,) = docs.schema, unused(docs, "bitmap")
    marked = with_bitmaps(docs, min_chars, bitmap)

    def apply(batches):
        for b in batches:
            old = b.column("text").to_pylist()
            new = [t if m is None else kept_text(t, m)[2] for t, m in zip(old, b.column(bitmap).to_pylist())]
            b = b.drop_columns([bitmap])
            b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
            if "n_chars" in b.schema.names:
                b = b.set_column(b.schema.get_field_index("n_chars"), "n_chars", pa.array([None if x is None else len(x) for x in new], pa.int64()))
            yield b

    return marked.select(*docs.columns, bitmap).mapInArrow(apply, schema)
