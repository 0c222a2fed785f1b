"""Training order: every sequence gets a slot by a keyed permutation, and shards
of fixed stride hold the sequences in the order of their slots.

A document's tokens are ids of 1, 2 or 4 bytes (little-endian) and an end mark; they
are cut into sequences of ``LENGTH`` tokens, the last one padded. The two marks are
the greatest numbers of the width, which no id may have. Without a column of ids the
UTF-8 bytes of the text are the ids, one byte each: UTF-8 never uses the marks.

1. A light pass counts the sequences of each stretch of rows that a task reads. Their
   running sum, in the order of file and row, is a small table in buckets by file; a
   task looks up the first number of what it reads there, so nothing that grows with
   the input is collected or shipped. Every sequence has a number from 0 on.
2. A keyed Feistel network over the next even number of bits, repeated while it
   leaves the range (cycle-walking), permutes these numbers: the slots.
3. Sequences move once, packed and compressed, to the range of slots that is
   their shard, dealt by its number; each shard is sorted and written in one stream.
   A sequence's place is arithmetic, so a reader can begin at any slot and read on.

Shards are written under fresh names and listed in an index table with the width of
a token, so the files of lost or repeated tasks are never read. Numbers depend on the
table's files alone, not on how they are split; if they change between the passes, it
fails. Documents are read with their place in a file, so they must come from files
(a table read from Parquet or the like, with at most filters and projections on it).

Defined cases: null text or ids are empty; an empty text is one sequence, of the end
mark only; a null id of a document is kept as null; repeated rows are separate
documents; texts of any length are cut whole; an empty table gives no shards; ids that
equal a mark, or bytes that are no whole number of ids, are an error. Columns other
than doc_id and that of the text or ids are not read, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import groups_of, new_path, pieces, written

LENGTH, SHARD = 512, 16_384
#: Stretches in a bucket of the table of first numbers.
BUCKET = 2_000
KEY, ROUNDS = 20240229, 6
LONGS = pa.list_(pa.int64())
COLUMNS = ("slot", "doc_id", "seq_no", "n_tokens")


def permuted(numbers: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """The images of numbers below ``size``: a bijection of that range for each key."""
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.SeedSequence(key).generate_state(ROUNDS, np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return left << half | right

    found = once(numbers.astype(np.uint64))
    while len(outside := np.flatnonzero(found >= size)):
        found[outside] = once(found[outside])
    return found.astype(np.int64)


def marks(width: int) -> tuple[bytes, bytes]:
    """The end mark and the padding of tokens of so many bytes."""
    if width not in (1, 2, 4):
        raise ValueError("token ids have 1, 2 or 4 bytes")
    most = 256**width - 1
    return most.to_bytes(width, "little"), (most - 1).to_bytes(width, "little")


def _located(docs: DataFrame, ids: str | None = None) -> DataFrame:
    """doc_id, text (or the bytes of ids), and the row's place."""
    content = F.coalesce(F.col("text").cast("string"), F.lit("")) if ids is None else F.coalesce(F.col(ids), F.lit(b""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        content.alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, row, n) to one row for each stretch of consecutive rows: its first row and sum of n."""
    found: list[list] = []
    following = None
    for batch in batches:
        for file, row, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, row) != following:
                found.append([file, row, 0])
            found[-1][2] += n
            following = file, row + 1
    yield pa.RecordBatch.from_arrays(
        [pa.array([f[0] for f in found], pa.string()), *(pa.array([f[i] for f in found], pa.int64()) for i in (1, 2))], names=["file", "row", "n"]
    )


def narrowed(docs: DataFrame, ids: str) -> DataFrame:
    """Ids of four bytes as ids of two; an id that does not fit is an error."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for value in batch.column(ids):
                wide = None if value.as_py() is None else np.frombuffer(value.as_py(), "<u4")
                if wide is not None and len(wide) and int(wide.max()) >= 0xFFFE:
                    raise ValueError("an id needs more than two bytes")
                out.append(None if wide is None else wide.astype("<u2").tobytes())
            columns = [pa.array(out, pa.binary()) if n == ids else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(narrow, docs.schema)


FIRSTS = pa.schema([("file", pa.string()), ("row", pa.int64()), ("first", pa.int64())])


def number_stretches(located: DataFrame, width: int) -> tuple[str, int, int]:
    """The folder of first sequence numbers (file, row, first) of all stretches, the number
    of its buckets, and the number of all sequences."""
    spark = located.sparkSession
    n = F.ceil((F.octet_length("text") + width) / (LENGTH * width)).cast("long")
    rows = written(located.select("file", "row", n.alias("n")).mapInArrow(_stretches, "file string, row long, n long"), "stretches")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = -(-count // BUCKET) or 1
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bucket = F.pmod(F.crc32(F.col("file").cast("binary")), F.lit(buckets)).alias("bucket")
    folder = new_path(spark, "firsts")
    rows.select("file", "row", before.alias("first"), bucket).repartition("bucket").write.partitionBy("bucket").parquet(folder)
    return folder, buckets, total


def first_numbers(folder: str, buckets: int, file: str) -> dict[int, int]:
    """Row to first sequence number of the stretches of a file."""
    system, place = fs.FileSystem.from_uri(folder)
    bucket = f"{place}/bucket={zlib.crc32(file.encode()) % buckets}"
    found = dataset.dataset(bucket, FIRSTS, format="parquet", filesystem=system).to_table(filter=dataset.field("file") == file)
    return dict(zip(found.column("row").to_pylist(), found.column("first").to_pylist(), strict=True))


def _cutter(firsts: tuple[str, int], total: int, key: int, width: int, length: int, shard_size: int):
    end, pad = marks(width)
    kind, least_mark, stride = np.dtype(f"<u{width}"), int.from_bytes(pad, "little"), length * width

    def tokens(content: str | bytes) -> bytes:
        if isinstance(content, str):
            return content.encode("utf-8", "replace") + end
        if len(content) % width or (len(content) and int(np.frombuffer(content, kind).max()) >= least_mark):
            raise ValueError(f"not ids of {width} bytes below {least_mark}")
        return content + end

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following, number, known, starts = None, 0, None, {}
        for batch in pieces(batches):
            numbers, ids, places, parts = [], [], [], []
            for doc, content, file, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, row) != following:
                    if file != known:
                        known, starts = file, first_numbers(*firsts, file)
                    number = starts[row]
                following = file, row + 1
                data = tokens(content)
                for place in range(0, len(data), stride):
                    numbers.append(number)
                    ids.append(doc)
                    places.append(place // stride)
                    parts.append(data[place : place + stride])
                    number += 1
            slots = permuted(np.array(numbers, np.int64), total, key)
            order = np.argsort(slots, kind="stable").tolist()
            shards = slots[order] // shard_size
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(order)] if order else []
            chosen = [order[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(slots[p[0]]) // shard_size for p in chosen], pa.int64()),
                    pa.array([slots[p] for p in chosen], LONGS),
                    *(pa.array([[x[i] for i in p] for p in chosen], LONGS) for x in (ids, places)),
                    pa.array([[len(parts[i]) // width for i in p] for p in chosen], LONGS),
                    pa.array([zlib.compress(b"".join([parts[i] for i in p]), 1) for p in chosen], pa.binary()),
                ],
                names=["shard", "slot", "doc_id", "seq_no", "n_tokens", "tokens"],
            )

    return cut


def _writer(folder: str, total: int, width: int, length: int, shard_size: int):
    pad = marks(width)[1]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        for table in groups_of(batches, ["shard"], rows=1):
            shards = table.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                yield one_shard(system, place, int(shards[lo]), table.slice(lo, hi - lo).combine_chunks())

    def one_shard(system: fs.FileSystem, place: str, shard: int, table: pa.Table) -> pa.RecordBatch:
        slots, _, places, sizes = (table.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False) for k in COLUMNS)
        begin = shard * shard_size
        order = np.argsort(slots, kind="stable")
        if not np.array_equal(slots[order], np.arange(begin, min(begin + shard_size, total))):
            raise ValueError(f"shard {shard} is not whole")
        data = b"".join([zlib.decompress(x) for x in table.column("tokens").to_pylist()])
        bytes_, ends = sizes * width, np.cumsum(sizes) * width
        name = f"shard-{shard:08d}-{uuid.uuid4().hex}.bin"
        with system.open_output_stream(f"{place}/{name}", compression=None) as out:
            for i in order.tolist():
                out.write(data[ends[i] - bytes_[i] : ends[i]] + pad * (length - int(sizes[i])))
        n = len(order)
        docs = table.column("doc_id").combine_chunks().flatten().take(pa.array(order))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, shard)), pa.array(slots[order]), docs, pa.array(places[order]), pa.array(sizes[order]), pa.array([f"{folder}/{name}"] * n), pa.array(np.full(n, width, np.int32))],
            names=["shard", "slot", "doc_id", "seq_no", "n_tokens", "path", "width"],
        )

    return write


PACKED = "shard long, slot array<long>, doc_id array<long>, seq_no array<long>, n_tokens array<long>, tokens binary"
INDEX = "shard long, slot long, doc_id long, seq_no long, n_tokens long, path string, width int"


def materialise(docs: DataFrame, folder: str, key: int = KEY, ids: str | None = None, width: int = 1) -> DataFrame:
    """Write the shards of a table of files below ``folder``; returns their index, one row
    for each sequence. ``ids`` names a binary column of ids of ``width`` bytes; without it
    the text's bytes are the ids."""
    located = _located(docs, ids)
    *firsts, total = number_stretches(located, width)
    cut = located.mapInArrow(_cutter(tuple(firsts), total, key, width, LENGTH, SHARD), PACKED)
    shards = max(1, -(-total // SHARD))
    parts = min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 8)
    # neighbouring shards share a partition, so the index lies in the order of slots
    part = F.floor(F.col("shard") / F.lit(-(-shards // parts))).cast("int")
    moved = cut.repartitionById(parts, part).sortWithinPartitions("shard")
    return written(moved.mapInArrow(_writer(folder, total, width, LENGTH, SHARD), INDEX), "order")


def read_slots(path: str, first: int, count: int, width: int = 1, length: int | None = None) -> Iterator[bytes]:
    """Sequences of a shard from its ``first`` place on, without their padding."""
    stride, pad = (length or LENGTH) * width, int.from_bytes(marks(width)[1], "little")
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_file(place) as file:
        file.seek(first * stride)
        for _ in range(count):
            piece = file.read(stride)
            if len(piece) < stride:
                return
            real = np.flatnonzero(np.frombuffer(piece, f"<u{width}") != pad)
            yield piece[: (int(real[-1]) + 1) * width]


def _checksums(length: int, shard_size: int):
    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, following, stream = None, None, iter(())
        for batch in batches:
            sums = []
            for own, slot, n, width in zip(*(batch.column(k).to_pylist() for k in ("path", "slot", "n_tokens", "width")), strict=True):
                if (own, slot) != (path, following):
                    path, stream = own, read_slots(own, slot % shard_size, shard_size, width, length)
                following = slot + 1
                piece = next(stream, None)
                if piece is None or len(piece) != n * width:
                    raise ValueError(f"slot {slot} of {path} does not hold its sequence")
                sums.append(zlib.crc32(piece))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "crc32"])

    return checksums


def read_back(index: DataFrame) -> DataFrame:
    """The index with the CRC-32 of each sequence. The index lies in the order of slots,
    so each task reads on in the shards that its part of it names."""
    return index.mapInArrow(_checksums(LENGTH, SHARD), f"{INDEX}, crc32 long")
