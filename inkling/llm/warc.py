"""Dictionary-compressed WARC archives.

A Zstandard dictionary is built from a bounded sample of the records; each archive embeds it in a leading skippable
frame and holds every record as a frame of its own, so a reader can start at any record. Tasks write and read archives in
the folder that the cluster shares, one stream per task, a record at a time.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, materialize, shared_dir, table

#: Fixed values of the WARC-Zstandard convention: magic number of the dictionary's skippable frame.
DICTIONARY_FRAME = 0x184D2A5D

#: The dictionary: its size, and the sample it is trained on (records, bytes of each).
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 65536, 1000, 16384

#: Records in one archive at most, and the smallest payload that is worth a revisit.
ARCHIVE_RECORDS, MIN_REVISIT = 20_000, 100


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the first bytes of about SAMPLE_RECORDS records, chosen by hash; empty if there is too little to learn from."""
    filled = pages.filter(F.col("html").isNotNull())
    share = int((1 << 40) * min(1.0, SAMPLE_RECORDS / max(1, filled.count())))
    sample = filled.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40)) < share).select(F.substring("html", 1, SAMPLE_BYTES).alias("html"))

    def train(batches):
        records: list[bytes] = []
        for b in batches:  # repeated ids and urls may share a hash; the sample stays bounded all the same
            records += [x.encode("utf-8", "surrogatepass") for x in b.column("html").to_pylist() if x and len(records) < 2 * SAMPLE_RECORDS]
        records.sort()
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
        except zstandard.ZstdError:
            made = b""
        yield batch_of(arrow_schema("d binary"), pa.array([made], pa.binary()))

    rows = sample.repartition(1).mapInArrow(train, "d binary").collect()  # one dictionary
    return bytes(rows[0].d) if rows else b""


def verdicts(pages: DataFrame) -> DataFrame:
    """``pages`` with payload_bytes, payload_digest, first_id and first_url (the response that equal payloads refer to; null: itself).

    Only digests found twice are joined, from a written table, so that a frequent digest is split by adaptive execution; payloads
    too small for a revisit get keys of their own, so that an empty page that is found everywhere makes no hot key.
    """
    html = F.coalesce("html", F.lit(""))
    marked = pages.select(F.col("page_id").cast("long"), "url", "html", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"))
    heads = materialize(
        marked.filter(F.col("payload_bytes") >= MIN_REVISIT)
        .groupBy("payload_digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("page_id").alias("n"))
        .filter(F.col("n") > 1)
        .select(F.col("payload_digest").alias("key"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    key = F.when(F.col("payload_bytes") >= MIN_REVISIT, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    return marked.withColumn("key", key).join(heads, "key", "left")


def record_id(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def record_bytes(page_id, url, html, size, digest, first_id, first_url) -> bytes:
    """One WARC/1.1 record: a revisit has the HTTP header alone, a response the payload too."""
    revisit = None not in (first_id, page_id) and first_id != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + (html or "").encode("utf-8", "surrogatepass")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Page-ID: {'' if page_id is None else page_id}"]
    head += [f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(first_id)}", f"WARC-Refers-To-Page-ID: {first_id}", f"WARC-Refers-To-Target-URI: {(first_url or '').replace(chr(13), '').replace(chr(10), '')}"]
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


MANIFEST = arrow_schema("path string,records long")


def write_archives(records: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write archives; the manifest lists those of the attempts that counted."""

    def write(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(base, recursive=True)
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        frame = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
        out, path, n = None, None, 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path, n = f"{base}/{uuid.uuid4().hex}.warc.zst", 0
                    out = fs.open_output_stream(path)
                    if dictionary:
                        packed = zstandard.ZstdCompressor(level=3).compress(dictionary)
                        out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
                    out.write(frame.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % str(uuid.uuid4()).encode()))
                out.write(frame.compress(record_bytes(*row)))
                n += 1
                if n == ARCHIVE_RECORDS:
                    out.close()
                    yield batch_of(MANIFEST, [path], [n])
                    out = None
        if out is not None:
            out.close()
            yield batch_of(MANIFEST, [path], [n])

    wanted = records.select("page_id", "url", "html", "payload_bytes", "payload_digest", "first_id", "first_url")
    return materialize(wanted.mapInArrow(write, "path string, records long"))


def frames(stream, block: int = 1 << 20):
    """The records of an archive, one at a time; memory holds a block and a record."""
    dictionary, data = None, stream.read(block)
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        while len(data) < 8 + size:
            data += stream.read(block)
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        data = data[8 + size :]
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        if not data and not (data := stream.read(block)):
            return
        one, parts = reader.decompressobj(), []
        while True:
            parts.append(one.decompress(data))
            data = one.unused_data
            if one.eof:
                break
            if not (data := stream.read(block)):
                raise ValueError("an archive ends inside a record")
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of a record."""

    def fields(block: bytes) -> dict[str, str]:
        return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in block.decode("utf-8", "surrogatepass").split("\r\n")[1:])

    head, _, block = record.partition(b"\r\n\r\n")
    head = fields(head)
    http, _, payload = block[: int(head["Content-Length"])].partition(b"\r\n\r\n")
    return head, fields(http), payload


RECORDS = arrow_schema("page_id long,payload_bytes long,payload_digest string,record_type string,refers_to long,whole boolean")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record; payloads of responses are measured and hashed anew, ``whole`` says that they agree with the header."""

    def read(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, base = pyarrow.fs.FileSystem.from_uri(f"{b.column('scheme')[0].as_py()}{path}")
                rows = []
                with fs.open_input_stream(base) as stream:
                    for record in frames(stream):
                        head, http, payload = parse(record)
                        kind = head["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        stated = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        size, digest = (len(payload), hashlib.sha256(payload).hexdigest()) if kind == "response" else (int(http["Content-Length"]), stated)
                        number = lambda x: int(x) if x else None
                        rows.append((number(head["WARC-Page-ID"]), size, digest, kind, number(head.get("WARC-Refers-To-Page-ID")), digest == stated))
                        if len(rows) == 4096:
                            yield batch_of(RECORDS, *map(list, zip(*rows)))
                            rows = []
                if rows:
                    yield batch_of(RECORDS, *map(list, zip(*rows)))

    return manifest.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, whole boolean")


def archive(pages: DataFrame) -> DataFrame:
    """Write every page as a record and read the archives back.

    Null html is an empty payload. Of equal payloads of MIN_REVISIT bytes or more the smallest page_id is the response; rows
    that repeat that page_id and rows without one are responses too. An empty table has no archive. Other columns are ignored.
    """
    folder = f"{shared_dir(pages.sparkSession)}/archives"
    manifest = write_archives(verdicts(pages), folder, train_dictionary(pages))
    scheme = folder.split("://")[0] + "://" if "://" in folder and not folder.startswith("file:") else "file://"
    n = max(1, manifest.count())
    return read_archives(manifest.withColumn("scheme", F.lit(scheme)).repartition(n, "path"))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
