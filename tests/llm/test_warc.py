import base64
import glob
import gzip
import hashlib
import io

import pytest

from factloom.llm import warc
from factloom.llm.common import new_path

PAGES = "page_id long, url string, html string, record_type string"


def expected(rows):
    payloads = [(r[0], (r[2] or "").encode()) for r in rows]
    out = []
    for page, data in payloads:
        keeper = max((p for p, d in payloads if d == data and p is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        same = keeper is None or page == keeper
        out.append((page, len(data), digest, "response" if same else "revisit", None if same else keeper))
    return sorted(out, key=str)


def trip(spark, rows, **options):
    folder = new_path(spark, "warc")
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES), folder)
    return folder, warc.read_archives(manifest, **options)


def test_round_trip_with_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 10)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 900)
    long = "é\r\n\r\nWARC/1.1\r\n" * 20
    rows = [
        (1, "http://a/ b\r\n", "same", "x"), (2, None, "same", "x"), (3, "u", None, "x"), (4, "u", "", "x"), (5, "u", long, "x"),
        (5, "u", long, "x"), (-6, "u", long, "x"), (7, "u", "0123456789", "x"), (8, "u", "0123456789a", "x"), (9, "u", long + "!", "x"), (None, "u", "same", "x"), (None, "u", "alone", "x"),
    ]
    _, table = trip(spark, rows)
    found = table.orderBy("record_id", "chunk_no").collect()
    last = [r for r in found if r["last"]]
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in last), key=str) == expected(rows)
    parts = [r for r in found if r["page_id"] == 8]
    assert [bytes(r["data"]) for r in parts] == [b"0123456789", b"a"] and [r["payload_bytes"] for r in parts] == [10, 11]
    assert max(len(r["data"] or b"") for r in found) <= 10
    assert b"".join(bytes(r["data"]) for r in found if r["page_id"] == 9) == (long + "!").encode()


def test_archives_are_readable_gzip_and_damage_is_found(spark):
    folder, table = trip(spark, [(1, "http://a/", "hello", "x"), (2, "http://b/", "hello", "x")])
    assert table.where("last").count() == 2
    data = b"".join(gzip.open(p).read() for p in glob.glob(folder.removeprefix("file://") + "/*.gz"))
    assert data.count(b"WARC/1.1\r\n") == 2 and b"WARC-Type: revisit" in data and data.count(b"hello") == 1
    one = gzip.compress(data.replace(b"hello", b"jello"))
    with pytest.raises(ValueError, match="digest"):
        list(warc.record_chunks(io.BytesIO(one), True))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.record_chunks(io.BytesIO(gzip.compress(data[:-3])), True))


def test_empty_and_oversized(spark):
    assert trip(spark, [])[1].count() == 0
    big = "x" * (3 * warc.CHUNK + 5)
    found = trip(spark, [(1, "u", big, "x")], with_data=False)[1].orderBy("chunk_no").collect()
    assert [r["payload_bytes"] for r in found] == [warc.CHUNK, 2 * warc.CHUNK, 3 * warc.CHUNK, len(big)]
    assert found[-1]["payload_digest"] == base64.b32encode(hashlib.sha1(big.encode()).digest()).decode()


def test_join_of_rows_beyond_the_broadcast_agrees(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    rows = [(i, "u", f"page {i % 7}", "x") for i in range(40)] + [(99, "u", None, "x"), (98, "u", "", "x")]
    found = trip(spark, rows, with_data=False)[1].where("last").collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str) == expected(rows)


def test_each_archive_is_read_by_a_task(spark):
    rows = spark.range(40).selectExpr("id as page_id", "'u' as url", "'page ' || id as html").repartition(6)
    manifest = warc.write_archives(rows, new_path(spark, "warc"))
    assert manifest.count() == 6 and warc.read_archives(manifest).rdd.getNumPartitions() == 6


def test_memory_of_an_oversized_record(tmp_path):
    import os
    import tracemalloc

    import pyarrow as pa

    chunks, size = 800, 800 * warc.CHUNK
    noise = [os.urandom(warc.CHUNK) for _ in range(4)]
    digest = hashlib.sha1(b"".join(noise) * (chunks // 4)).hexdigest()

    def batches():
        for i in range(chunks):
            row = {"page_id": 1, "url": "u", "sha1": digest, "size": size, "record_type": "response", "refers_to": None, "chunk_no": i, "data": noise[i % 4]}
            yield pa.RecordBatch.from_pylist([row])

    tracemalloc.start()
    done = list(warc._writer(f"file://{tmp_path}")(batches()))[0]
    with open(done.column("path")[0].as_py().removeprefix("file://"), "rb") as stream:
        last = None
        for last in warc.record_chunks(stream, True):
            pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 200_000_000 and last[7] == size and last[8] == warc.base32(bytes.fromhex(digest))
    assert most < 20 * warc.CHUNK


def test_clashing_columns(spark):
    rows = [(1, "u", "same", "a", 9, "k"), (2, "u", "same", "b", 9, "k")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string, size long, keeper string")
    manifest = warc.write_archives(frame, new_path(spark, "warc"))
    assert {r["page_id"]: r["refers_to"] for r in warc.read_archives(manifest).where("last").collect()} == {1: 2, 2: None}
