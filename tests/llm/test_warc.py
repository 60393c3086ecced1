import base64
import gzip
import hashlib
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planloom.llm import warc

ROWS = [(5, "http://a/x y\r\nz", "<p>one</p>"), (3, None, "<p>one</p>"), (9, "http://b/é", "é" * 50_000), (4, "u", None), (2, "u", ""), (None, "n", "<p>one</p>"), (7, "u", "x" * 200_000), (7, "u", "x" * 200_000), (8, "v", "x" * 200_000), (1, "s", "tiny\r\n\r\nWARC/1.1\r\n")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(min_bytes):
    out = []
    for p, _, h in ROWS:
        same = [q for q, _, g in ROWS if (g or "") == (h or "") and q is not None]
        size = len((h or "").encode())
        first = min(same) if same and size >= min_bytes else p
        out.append((p, size, digest(h), "response" if p == first else "revisit", None if p == first else first))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 100])
def test_round_trip(spark, min_bytes):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, payload_digest string").repartition(3)
    assert sorted(map(tuple, warc.round_trip(pages, min_bytes).collect()), key=str) == expected(min_bytes)


def test_record_ids_are_unique_and_named_by_revisits(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    rows = [*ROWS, *[(7, "u", "x" * 200_000)] * 3, *[(None, "n", "<p>one</p>")] * 2, (1, "other", "another")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    warc.archive(pages, folder)
    got = warc.read(spark, folder).collect()
    ids = {r.record_id: r for r in got}
    assert len(ids) == len(got) == len(rows) and all(i.startswith("<urn:uuid:") and len(i) == 47 for i in ids)
    for r in got:
        named = ids.get(r.refers_to_id)
        assert (r.record_type == "revisit") == (named is not None)
        assert named is None or (named.record_type, named.page_id, named.payload_digest) == ("response", r.refers_to, r.payload_digest)
        assert (r.content_type is None) == (r.record_type == "revisit")
    path = next((tmp_path / "w").glob("*.warc.gz"))
    assert b"\r\nWARC-Payload-Digest: sha1:" in gzip.decompress(path.read_bytes())


def test_pushdown_projection_and_splits(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i % 50} " * 3000) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    warc.archive(pages, folder)
    all_rows = warc.read(spark, folder)
    assert all_rows.count() == 300
    revisits = warc.read(spark, folder, "page_id long, refers_to long").where("refers_to is not null")
    assert {(r.page_id, r.refers_to) for r in revisits.collect()} == {(i, i % 50) for i in range(50, 300)}
    some = all_rows.where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://h/1") & F.col("page_id").isin(1, 10, 20, 100))
    assert sorted((r.page_id, len(r.payload)) for r in some.collect()) == [(1, 7 * 3000), (10, 8 * 3000)]
    split = spark.read.format("warc").option("split_bytes", 1).load(folder)
    assert sorted(r.page_id for r in split.select("page_id").collect()) == list(range(300))


def test_headers_are_parsed_before_payloads():
    rows = [{"record_type": "response", "page_id": i, "payload": b"abcdefgh" * 200_000} for i in range(20)]
    data = b"".join(warc.compress(warc.build_record(r)) for r in rows)
    held = warc._Input(pa.BufferReader(data), 0, len(data))
    got = []
    while held.at < len(data):
        got.append(warc._gzip_record(held, lambda r: r["page_id"] == 7, True))
    assert [r["page_id"] for r, _ in got if r] == [7] and got[7][1] == rows[7]["payload"]
    assert held.inflated < 2 * 1_600_000  # of 32 MB


def test_foreign_archives():
    rows = [{"record_type": "response", "page_id": i, "payload": bytes([65 + i]) * (i * 300_000)} for i in range(5)]
    plain = b"".join(map(warc.build_record, rows))
    members = b"".join(gzip.compress(warc.build_record(r)) for r in rows)
    named = io.BytesIO()
    with gzip.GzipFile("a name", "wb", fileobj=named) as out:
        out.write(warc.build_record(rows[3]))
    for data, want in ((plain, rows), (members, rows), (named.getvalue(), rows[3:4])):
        got = list(warc.read_records(pa.BufferReader(data), 0, len(data)))
        assert [(r["page_id"], r["payload"]) for r in got] == [(r["page_id"], r["payload"]) for r in want]
        assert [r["payload"] for r in warc.read_records(pa.BufferReader(data), 0, len(data), want_payload=False)] == [None] * len(want)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
