"""WARC archives: a PySpark data source that writes and reads them, and duplicate payloads as revisit records.

``spark.read.format("warc").load(folder)`` plans one partition for each archive file (or for each stretch of a file
between two offsets of its ``.idx`` side file, when the file is larger than ``split_bytes``).  Equality, IN, null and
prefix predicates on record columns are taken over by the source (``spark.sql.python.filterPushdown.enabled``) and
tested on a record's headers before its payload is touched.  Each record is a gzip member of its own whose extra
field ``sl`` holds the member's compressed length: to pass over a record the reader inflates its headers alone.  A
schema without the ``payload`` column, given with ``.schema(...)``, leaves all payloads undecoded.  Members without
``sl`` (from other writers) and plain ``.warc`` files are read as well.

Writing goes through the folder's own file system (pyarrow), one stream for each task, a new file after
``roll_bytes``; names carry the attempt, and only files named by committed tasks stay.  Both ways rows go by in Arrow
batches, the reader's bounded by ``BATCH_BYTES`` of payload.

Payload digests are upper-case base32 SHA-1 values, bare in the column and after ``sha1:`` in the header.  Target URIs are
written, and come back, with what is no printable ASCII percent-encoded.  ``archive`` turns a page table into records: of the rows
with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id is the response and the others
are revisits that name it; smaller payloads are all responses.  Rows that repeat the smallest page_id with the same
payload are equal records and all responses; a null page_id counts as larger than any; null html is an empty payload.
Record ids are made of page_id and digest, and of a row number as well for rows that repeat both but for one of them:
every record has its own id, the same in all attempts, and a revisit names its response by it (``WARC-Refers-To``).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bounded_batches, fresh_path, open_fs, scratch, text_slices

SCHEMA = "record_type string, record_id string, target_uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_to long, refers_to_id string, content_type string, content_length long, payload binary"
#: Record column: header field, parser.
HEADERS = {
    "record_type": ("WARC-Type", str),
    "record_id": ("WARC-Record-ID", str),
    "target_uri": ("WARC-Target-URI", str),
    "date": ("WARC-Date", str),
    "page_id": ("X-Page-ID", int),
    "payload_bytes": ("X-Payload-Length", int),
    "payload_digest": ("WARC-Payload-Digest", str),
    "refers_to": ("X-Refers-To-Page", int),
    "refers_to_id": ("WARC-Refers-To", str),
    "content_type": ("Content-Type", str),
    "content_length": ("Content-Length", int),
}
ROLL_BYTES, SPLIT_BYTES, INDEX_EVERY = 256 << 20, 64 << 20, 4 << 20
#: A batch that the reader gives: records and payload bytes, at most (one larger record is alone).
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
CONTENT_TYPE = "text/html; charset=utf-8"
EPOCH = "1970-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records ---------------------------------------------------------------------------------------------------


def build_record(row: dict) -> bytes:
    """One WARC/1.1 record, uncompressed.  A revisit has no payload; its length and digest are those of the original."""
    payload = b"" if row["record_type"] == "revisit" else row.get("payload") or b""
    lines = ["WARC/1.1"]
    for column, (field, _) in HEADERS.items():
        value = len(payload) if column == "content_length" else row.get(column)
        if value is not None:
            text = quote(value, safe=SAFE) if column == "target_uri" else f"sha1:{value}" if column == "payload_digest" else value
            lines.append(f"{field}: {text}")
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


#: Printable ASCII stands for itself in a URI header; anything that could break a line is percent-encoded.
SAFE = "".join(map(chr, range(33, 127)))


def compress(record: bytes) -> bytes:
    """A gzip member with the skip length of the member in its extra field."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = struct.pack("<2sHII", b"sl", 8, total & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict:
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    row = {}
    for column, (field, kind) in HEADERS.items():
        value = fields.get(field.lower())
        row[column] = None if value is None else kind(value)
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    return row


class _Input:
    """A forward reader over a stretch of a file; what has been passed over is let go when more is read."""

    def __init__(self, source, start: int, end: int):
        self.source, self.at, self.end, self.buffer, self.place, self.inflated = source, start, end, b"", 0, 0

    @property
    def ready(self) -> int:
        """Bytes at hand."""
        return len(self.buffer) - self.place

    def fill(self, size: int) -> int:
        """Have that many bytes at hand, or all that are left; how many there are."""
        while self.ready < size and (more := self.source.read_at(max(1 << 20, size - self.ready), self.at + self.ready)):
            self.buffer = self.buffer[self.place :] + more
            self.place = 0
        return self.ready

    def peek(self, first: int, last: int) -> bytes:
        """The bytes from ``first`` to before ``last``, counted from the reader's place."""
        self.fill(last)
        return self.buffer[self.place + first : self.place + min(last, self.ready)]

    def pass_over(self, size: int) -> None:
        self.at += size
        self.place += size
        if self.place >= len(self.buffer):
            self.buffer, self.place = b"", 0


def _gzip_record(source: _Input, keep, want_payload: bool) -> tuple[dict | None, bytes | None]:
    """Headers of the record at the reader's place, None if ``keep`` refuses them, and its payload if wanted."""
    head = source.peek(0, 12)
    flags, at, skip = head[3], 10, 0
    if flags & 4:
        size = struct.unpack_from("<H", head, 10)[0]
        extra, at = source.peek(12, 12 + size), 12 + size
        if extra[:2] == b"sl":
            skip = struct.unpack_from("<I", extra, 4)[0]
    for flag in (8, 16):
        if flags & flag:
            at += source.peek(at, at + 4096).index(b"\0") + 1
    at += 2 if flags & 2 else 0
    inflate, out, step = zlib.decompressobj(-15), b"", 4096
    end = min(skip, at + 2 * step) if skip else max(at + step, source.ready)
    data = source.peek(at, end)
    end = at + len(data)

    def more() -> bytes:
        """The next stretch of the member."""
        nonlocal end
        found = source.peek(end, min(skip, end + (1 << 20)) if skip else max(end + step, source.fill(end + step)))
        end += len(found)
        if not found:
            raise ValueError("a record is cut short")
        return found

    while b"\r\n\r\n" not in out and not inflate.eof:
        out += inflate.decompress(data or more(), step)
        data = inflate.unconsumed_tail
    split = out.index(b"\r\n\r\n") + 4
    row = parse_headers(out[: split - 4])
    source.inflated += len(out)
    kept = keep(row)
    if skip and not (kept and want_payload):
        source.pass_over(skip)
        return (row if kept else None), None
    parts = [out]
    while not inflate.eof:
        parts.append(inflate.decompress(data or more()))
        data = inflate.unconsumed_tail
        source.inflated += len(parts[-1])
    # the checksum and length follow what was inflated; unused data begins with them
    used = skip or end - len(inflate.unused_data) + 8
    source.fill(used)
    source.pass_over(used)
    return (row if kept else None), (b"".join(parts)[split : split + (row["content_length"] or 0)] if want_payload else None)


def _plain_record(source: _Input, keep, want_payload: bool) -> tuple[dict | None, bytes | None]:
    size = 4096
    while (cut := source.peek(0, size).find(b"\r\n\r\n")) < 0:
        if source.ready < size:
            raise ValueError("a record is cut short")
        size *= 2
    row = parse_headers(source.peek(0, cut))
    length, kept, payload = row["content_length"] or 0, keep(row), None
    if kept and want_payload:
        payload = source.peek(cut + 4, cut + 4 + length)
    source.pass_over(cut + 4 + length + 4)
    return (row if kept else None), payload


def read_records(source, start: int, end: int, keep=lambda row: True, want_payload: bool = True) -> Iterator[dict]:
    """The records that begin in [start, end) of an open file and whose headers pass ``keep``."""
    held = _Input(source, start, end)
    while held.at < end and (head := held.peek(0, 2)):
        row, payload = (_gzip_record if head == b"\x1f\x8b" else _plain_record)(held, keep, want_payload)
        if row:
            row["payload"] = payload
            yield row


# --- the data source -------------------------------------------------------------------------------------------


@dataclass
class Stretch(InputPartition):
    uri: str
    start: int
    end: int


def _list(uri: str) -> list[tuple[str, int]]:
    """Archive files of a folder (or the one file) with their sizes, in order of name."""
    fs, path = open_fs(uri)
    info = fs.get_file_info(path)
    infos = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
    base = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    return sorted((base + i.path, i.size) for i in infos if i.base_name.endswith((".warc", ".warc.gz")))


class WarcReader(DataSourceReader):
    def __init__(self, uri: str, schema: StructType, split_bytes: int):
        self.uri, self.columns, self.arrow, self.split_bytes, self.tests = uri, schema.names, to_arrow_schema(schema), split_bytes, []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column not in HEADERS or not isinstance(f, (EqualTo, In, IsNotNull, IsNull, StringStartsWith)):
                yield f
                continue
            self.tests.append((type(f).__name__, column, getattr(f, "value", None)))

    def partitions(self):
        out = []
        for uri, size in _list(self.uri):
            cuts = [0]
            if size > self.split_bytes:
                fs, path = open_fs(uri)
                if fs.get_file_info(path + ".idx").type == pafs.FileType.File:
                    with fs.open_input_stream(path + ".idx") as source:
                        for at in map(int, source.read().split()):
                            if at - cuts[-1] >= self.split_bytes:
                                cuts.append(at)
            out += [Stretch(uri, a, b) for a, b in zip(cuts, [*cuts[1:], size])]
        return out or [Stretch("", 0, 0)]

    def _keep(self, row: dict) -> bool:
        for kind, column, value in self.tests:
            have = row[column]
            if kind == "IsNull":
                good = have is None
            elif have is None:
                good = False
            elif kind == "EqualTo":
                good = have == value
            elif kind == "In":
                good = have in value
            else:
                good = kind == "IsNotNull" or have.startswith(value)
            if not good:
                return False
        return True

    def read(self, partition: Stretch):
        if not partition.uri:
            return
        fs, path = open_fs(partition.uri)
        with fs.open_input_file(path) as source:
            held, size = [], 0
            for row in read_records(source, partition.start, partition.end, self._keep, "payload" in self.columns):
                held.append(row)
                size += len(row["payload"] or b"")
                if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield self._batch(held)
                    held, size = [], 0
            if held:
                yield self._batch(held)

    def _batch(self, held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in held], f.type) for f in self.arrow], schema=self.arrow)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, schema: StructType, overwrite: bool, roll_bytes: int):
        self.uri, self.roll_bytes = uri, roll_bytes
        fs, path = open_fs(uri)
        if overwrite and fs.get_file_info(path).type == pafs.FileType.Directory:
            fs.delete_dir_contents(path)
        fs.create_dir(path, recursive=True)

    def write(self, iterator):
        fs, folder = open_fs(self.uri)
        files, out, at, offsets = [], None, 0, []

        def close():
            out.close()
            with fs.open_output_stream(f"{folder}/{files[-1]}.idx") as index:
                index.write("\n".join(map(str, offsets)).encode())

        # a few records at a time are Python objects
        for row in (row for batch in text_slices(iterator, "payload", 100) for row in batch.to_pylist()):
            if out is None:
                files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                out, at, offsets = fs.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0, [0]
            member = compress(build_record(row))
            if at - offsets[-1] >= INDEX_EVERY:
                offsets.append(at)
            out.write(member)
            at += len(member)
            if at >= self.roll_bytes:
                close()
                out = None
        if out is not None:
            close()
        return Written(files)

    def commit(self, messages):
        """Files of attempts that were not committed go."""
        fs, folder = open_fs(self.uri)
        named = {f for m in messages if m for f in m.files}
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            if info.base_name.startswith("part-") and info.base_name.removesuffix(".idx") not in named:
                fs.delete_file(info.path)

    def abort(self, messages):
        fs, folder = open_fs(self.uri)
        for name in {f for m in messages if m for f in m.files}:
            for path in (f"{folder}/{name}", f"{folder}/{name}.idx"):
                if fs.get_file_info(path).type == pafs.FileType.File:
                    fs.delete_file(path)


class WarcDataSource(DataSource):
    """Options: path (a folder or file URI), split_bytes, roll_bytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema, int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], schema, overwrite, int(self.options.get("roll_bytes", ROLL_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- pages -----------------------------------------------------------------------------------------------------


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "payload"):
        payload = [p or b"" for p in batch.column("payload").to_pylist()]
        digest = pa.array([sha1_base32(p) for p in payload], pa.string())
        size = pa.array([len(p) for p in payload], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, size, digest], names=[*batch.schema.names, "payload_bytes", "payload_digest"])


def _record_id(page_id: Column, key: Column, copy: Column) -> Column:
    digest = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("none")), key, copy))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``: null, but for the second and further rows with a page_id and payload, which are told apart.

    Only rows whose page_id occurs again are written and numbered, and as a rule there are none.
    """
    again = scratch(rows.groupBy(F.col("page_id").alias("__p")).count().where("count > 1").select("__p"), "repeated-pages")
    if not again.limit(1).count():
        return rows.withColumn("copy", F.lit(None).cast("long"))
    same = F.col("page_id").eqNullSafe(F.col("__p"))
    held = scratch(rows.join(again, same, "left_semi").withColumn("row", F.monotonically_increasing_id()), "repeated-rows").withColumn("key", F.sha1("payload"))
    first = held.groupBy(F.col("page_id").alias("__p"), F.col("key").alias("__k")).agg(F.min("row").alias("lead"))
    held = held.join(first, same & (F.col("key") == F.col("__k"))).withColumn("copy", F.when(F.col("row") != F.col("lead"), F.col("row")))
    return rows.join(again, same, "left_anti").withColumn("copy", F.lit(None).cast("long")).unionByName(held.select(*rows.columns, "copy"))


def archive(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = EPOCH) -> None:
    """Write a record for each row of page_id, url, html.

    The pages are read for the page_ids and digests that occur more than once (map-side aggregates), and once to be
    written.  Payloads cross the network only if the repeated digests are too many to send to every task; hot digests
    are then split by the engine's skew join.
    """
    register(pages.sparkSession)
    rows = bounded_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keys = rows.select("page_id", F.octet_length("payload").alias("size"), F.sha1("payload").alias("key"))
    repeated = keys.where(F.col("size") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    # written, so that the join has two exchanges of its own and the engine can split the rows of a hot digest
    repeated = scratch(repeated, "repeated-payloads").withColumnRenamed("key", "__key")
    marked = _with_copies(rows).withColumn("key", F.sha1("payload")).mapInArrow(_digests, "page_id long, target_uri string, payload binary, copy long, key string, payload_bytes long, payload_digest string")
    known = marked.join(repeated, F.col("key") == F.col("__key"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = known.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        _record_id(F.col("page_id"), F.col("key"), F.col("copy").cast("string")).alias("record_id"),
        "target_uri",
        F.lit(date).alias("date"),
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, F.col("first")).alias("refers_to"),
        F.when(revisit, _record_id(F.col("first"), F.col("key"), F.lit(None).cast("string"))).alias("refers_to_id"),
        F.when(~revisit, F.lit(CONTENT_TYPE)).alias("content_type"),
        F.lit(None).cast("long").alias("content_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").save(folder)


def read(spark: SparkSession, folder: str, columns: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).load(folder)


DIGEST = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def checked(responses: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of responses, recomputed from the payloads."""

    def run(batches):
        for batch in text_slices(batches, "payload"):
            sizes, digests = batch.column("payload_bytes").to_pylist(), batch.column("payload_digest").to_pylist()
            for i, payload in enumerate(batch.column("payload").to_pylist()):
                if sha1_base32(payload) != digests[i] or len(payload) != sizes[i]:
                    raise ValueError(f"the payload of record {batch.column('page_id')[i]} doesn't match its headers")
            yield batch.select(DIGEST)

    return responses.select(*DIGEST, "payload").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive all pages, read the archives back and return the digest of each record.

    Responses are read with their payloads, and the other records by their headers alone: the record type is tested by
    the source.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    archive(pages, folder, min_bytes)
    headers = "record_type string, page_id long, payload_bytes long, payload_digest string, refers_to long"
    responses = checked(read(spark, folder, headers + ", payload binary").where("record_type = 'response'"))
    return responses.unionByName(read(spark, folder, headers).where("record_type = 'revisit'").select(*DIGEST))
