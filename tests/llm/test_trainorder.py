import zlib

import numpy as np
import pytest

from factloom.llm import trainorder
from factloom.llm.common import new_path


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection_that_depends_on_the_key(size):
    images = trainorder.permuted(np.arange(size), size)
    assert sorted(images.tolist()) == list(range(size))
    assert [int(trainorder.permuted(np.array([i]), size)[0]) for i in range(min(size, 50))] == images[:50].tolist()
    if size > 100:
        assert not np.array_equal(images, trainorder.permuted(np.arange(size), size, key=1))
        assert abs(np.corrcoef(np.arange(size), images)[0, 1]) < 0.2


def stored(spark, rows, files=3):
    path = new_path(spark, "docs")
    spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def test_shards_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(trainorder, "LENGTH", 8)
    monkeypatch.setattr(trainorder, "SHARD", 16)
    rows = [(i, "é" * (i * 7 % 40), "clash") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (102, "same", "x"), (102, "same", "x")]
    docs = stored(spark, rows)
    located = sorted(trainorder._located(docs).collect(), key=lambda r: (r["file"], r["row"]))
    cut = []
    for r in located:
        data = r["text"].encode() + b"\xff"
        cut += [(r["doc_id"], p // 8, data[p : p + 8]) for p in range(0, len(data), 8)]
    slots = trainorder.permuted(np.arange(len(cut)), len(cut)).tolist()
    want = {s: (*c[:2], len(c[2]), zlib.crc32(c[2])) for s, c in zip(slots, cut, strict=True)}
    index = trainorder.materialise(docs, new_path(spark, "shards"))
    found = trainorder.read_back(index).collect()
    assert {r["slot"]: (r["doc_id"], r["seq_no"], r["n_tokens"], r["crc32"]) for r in found} == want and len(found) == len(want)
    assert all(r["shard"] == r["slot"] // 16 for r in found)
    # reading can begin at any place of a shard
    path = next(r["path"] for r in found if r["slot"] == 3)
    assert [zlib.crc32(x) for x in trainorder.read_slots(path, 3, 4)] == [want[s][3] for s in range(3, 7)]
    # another split of the same files gives the same order
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    again = trainorder.materialise(docs, new_path(spark, "shards")).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r["slot"], r["doc_id"], r["seq_no"]) for r in again} == {(r["slot"], r["doc_id"], r["seq_no"]) for r in found}


def test_empty_table_and_long_text(spark):
    assert trainorder.materialise(stored(spark, [], 1), new_path(spark, "shards")).count() == 0
    found = trainorder.read_back(trainorder.materialise(stored(spark, [(1, "x" * 2_000_000, "")], 1), new_path(spark, "shards")))
    assert found.count() == -(-2_000_001 // trainorder.LENGTH)


@pytest.mark.parametrize("width", [2, 4])
def test_ids_of_several_bytes_against_plain_python(spark, monkeypatch, width):
    monkeypatch.setattr(trainorder, "LENGTH", 8)
    monkeypatch.setattr(trainorder, "SHARD", 16)
    monkeypatch.setattr(trainorder, "BUCKET", 2)
    kind = f"<u{width}"
    most = 256**width - 3
    rows = [(i, bytearray(np.array([most, 0, 254, 255, 65279][: i % 6] * (i % 7), kind).tobytes()), "clash") for i in range(60)]
    rows += [(100, None, "x"), (None, bytearray(b""), "x"), (102, bytearray(b"\1" * width), "x"), (102, bytearray(b"\1" * width), "x")]
    path = new_path(spark, "docs")
    spark.createDataFrame(rows, "doc_id long, ids binary, file string").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    located = sorted(trainorder._located(docs, "ids").collect(), key=lambda r: (r["file"], r["row"]))
    cut = []
    for r in located:
        data = bytes(r["text"]) + b"\xff" * width
        cut += [(r["doc_id"], p // (8 * width), data[p : p + 8 * width]) for p in range(0, len(data), 8 * width)]
    slots = trainorder.permuted(np.arange(len(cut)), len(cut)).tolist()
    want = {s: (*c[:2], len(c[2]) // width, zlib.crc32(c[2])) for s, c in zip(slots, cut, strict=True)}
    index = trainorder.materialise(docs, new_path(spark, "shards"), ids="ids", width=width)
    found = trainorder.read_back(index).collect()
    assert {r["slot"]: (r["doc_id"], r["seq_no"], r["n_tokens"], r["crc32"]) for r in found} == want and len(found) == len(want)
    assert {r["width"] for r in found} == {width}


@pytest.mark.parametrize(("width", "ids"), [(2, b"\xff\xff"), (2, b"\xfe\xff"), (2, b"\1"), (3, b"")])
def test_ids_that_do_not_fit_are_an_error(spark, width, ids):
    path = new_path(spark, "docs")
    spark.createDataFrame([(1, bytearray(ids))], "doc_id long, ids binary").write.parquet(path)
    with pytest.raises(Exception, match="ids"):
        trainorder.materialise(spark.read.parquet(path), new_path(spark, "shards"), ids="ids", width=width).count()


def test_query_on_ids_holds_every_token_once(spark):
    from factloom.llm import spm
    from factloom.llm.queries import MODEL_PATH, training_order_of_ids

    folder = "/root/testdata/sf0.001"
    coder = spm.Transducer(spm.read_model(MODEL_PATH))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        data = coder.encode(r["text"] or "").astype("<u2").tobytes() + b"\xff\xff"
        step = 2 * trainorder.LENGTH
        want |= {(r["doc_id"], p // step): zlib.crc32(data[p : p + step]) for p in range(0, len(data), step)}
    found = training_order_of_ids(spark, folder).collect()
    assert {(r["doc_id"], r["seq_no"]): r["crc32"] for r in found} == want and len(found) == len(want)
    assert sorted(r["slot"] for r in found) == list(range(len(found)))
