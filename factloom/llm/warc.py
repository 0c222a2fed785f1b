"""WARC archives written from and read back to a chunked record table.

A payload is cut where it is read and travels as rows (record identifier, chunk
number, at most ``CHUNK`` bytes), written and read in order, while a running
SHA-1 is carried along. Each task writes archives of its own, one gzip member
for each record; the names of the finished ones form the manifest, so what a
lost or repeated task left behind is never read. Only keys are exchanged to find
equal payloads (id, digest, size); groups of two pages or more go back to the scan
by a broadcast, up to ``BROADCAST_GROUPS`` of them, by a join of the rows beyond.
Each archive is read by a task of its own, up to ``MOST_READERS`` tasks.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the
largest page_id is a response and the others are revisits that refer to it;
shorter ones are all responses. A revisit keeps the HTTP head, hence the length,
and the digest of its payload.

Defined cases: a null payload is empty; a null url is the record's identifier;
rows that repeat a page_id and its payload have the same type (responses if the
id is the largest) and the same identifier; a null page_id is smaller than any other, and if all of
equal payload are null, each is a response; an empty table gives no archives.
Columns other than page_id, url and html are not read, whatever their names. A
payload is one value of the table (below 2 GB); neither writing nor reading holds
more of it in Python than a chunk or a batch of chunks.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import pieces, written
from factloom.storage import written_counted

CHUNK = 262_144
#: Bytes from which equal payloads are revisits, bytes after which a new archive begins, and gzip level.
LEAST, ARCHIVE_BYTES, LEVEL = 0, 1_000_000_000, 4
#: Groups of equal payloads that are broadcast (some 60 bytes each), and tasks that read archives.
BROADCAST_GROUPS, MOST_READERS = 500_000, 20_000
#: The tables have no crawl time.
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"
#: Identifiers hold the page_id in their lower half; the upper half tells whether there is one.
_WITH_ID, _WITHOUT_ID = 0xFAC7_1000_0000_4000, 0xFAC7_2000_0000_4000


def record_id(page_id: int | None) -> str:
    if page_id is None:
        return f"<urn:uuid:{uuid.UUID(int=_WITHOUT_ID << 64 | uuid.uuid4().int & (2**64 - 1))}>"
    return f"<urn:uuid:{uuid.UUID(int=_WITH_ID << 64 | page_id & (2**64 - 1))}>"


def page_id_of(identifier: str) -> int | None:
    number = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    low = number & (2**64 - 1)
    return None if number >> 64 != _WITH_ID else low - 2**64 if low >= 2**63 else low


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def classified(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, sha1 (hex), size, record_type and refers_to of each page."""
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    # written before the join: a payload that many pages share can then be split among tasks
    groups = rows.groupBy("sha1", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("pages"))
    groups, n = written_counted(groups.where((F.col("pages") > 1) & (F.col("size") >= LEAST)).drop("pages"), "payloads")
    refers = F.when(F.col("keeper") != F.coalesce("page_id", F.col("keeper") - 1), F.col("keeper"))
    return (
        rows.join(F.broadcast(groups) if n <= BROADCAST_GROUPS else groups, ["sha1", "size"], "left")
        .withColumn("refers_to", refers)
        .withColumn("record_type", F.when(F.col("refers_to").isNull(), RESPONSE).otherwise(REVISIT))
    )


def chunked(rows: DataFrame) -> DataFrame:
    """Records as rows of (…, chunk_no, data); those of a record follow each other."""
    last = F.when(F.col("record_type") == RESPONSE, F.greatest(F.ceil(F.col("size") / CHUNK) - 1, F.lit(0))).otherwise(0)
    numbers = F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("chunk_no")
    rows = rows.select("page_id", "url", "sha1", "size", "record_type", "refers_to", numbers, "payload")
    data = F.when(F.col("record_type") == RESPONSE, F.substring("payload", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK))).otherwise(F.lit(b""))
    return rows.withColumn("data", data).drop("payload")


def heads(row: dict) -> tuple[bytes, bytes]:
    """WARC head and HTTP head of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    identifier = record_id(row["page_id"])
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in row["url"] or identifier[1:-1])
    length = len(http) + (row["size"] if row["record_type"] == RESPONSE else 0)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {identifier}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(row['sha1']))}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {length}",
    ]
    if row["record_type"] == REVISIT:
        lines += [f"WARC-Refers-To: {record_id(row['refers_to'])}", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


MANIFEST = "path string, records long, bytes long"


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(folder)
        done: list[tuple[str, int, int]] = []
        out = packer = None
        name, records, size, rest = "", 0, 0, 0

        def put(data: bytes) -> None:
            nonlocal size
            size += len(data)
            out.write(data)

        def end_record() -> None:
            put(packer.compress(b"\r\n\r\n") + packer.flush())

        for batch in pieces(batches):
            columns = [c for c in batch.schema.names if c != "data"]
            for row, data in zip(batch.select(columns).to_pylist(), batch.column("data"), strict=True):
                if row["chunk_no"] == 0:
                    if out is not None and size >= ARCHIVE_BYTES:
                        out.close()
                        done.append((name, records, size))
                        out = None
                    if out is None:
                        system.create_dir(place, recursive=True)
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = system.open_output_stream(f"{place}/{name}", compression=None)
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    head, http = heads(row)
                    put(packer.compress(head + http))
                    records += 1
                    rest = row["size"] if row["record_type"] == RESPONSE else 0
                put(packer.compress(memoryview(data.as_buffer())))
                rest -= len(data.as_buffer())
                if rest == 0:
                    end_record()
        if out is not None:
            out.close()
            done.append((name, records, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{n}" for n, _, _ in done], pa.string()), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))],
            names=["path", "records", "bytes"],
        )

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each page below ``folder``; returns the manifest of archives."""
    rows = chunked(classified(pages)).select("page_id", "url", "sha1", "size", "record_type", "refers_to", "chunk_no", "data")
    return written(rows.mapInArrow(_writer(folder), MANIFEST), "manifest")


class Members:
    """Bytes of the gzip members of a stream, read piece by piece."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.plain = stream, b"", bytearray()
        self.unpacker = zlib.decompressobj(31)

    def fill(self, least: int) -> bool:
        """Have at least so many bytes ready, if the stream has them."""
        while len(self.plain) < least:
            if self.unpacker.eof:
                self.raw, self.unpacker = self.unpacker.unused_data or self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    return False
            self.plain += self.unpacker.decompress(self.raw, CHUNK)
            self.raw = b"" if self.unpacker.eof else self.unpacker.unconsumed_tail
        return True

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError("archive ends inside a record")
        data = bytes(self.plain[:n])
        del self.plain[:n]
        return data

    def head(self) -> tuple[str, dict[str, str]] | None:
        """First line and fields up to an empty line."""
        at = 0
        while (end := self.plain.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(self.plain)
            if not self.fill(at + 1):
                if self.plain:
                    raise ValueError("archive ends inside a head")
                return None
        first, *lines = self.take(end + 4)[:-4].decode("utf-8", "replace").split("\r\n")
        return first, {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}


RECORD_CHUNKS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("last", T.BooleanType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("data", T.BinaryType()),
    ]
)
_ARROW = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]


def record_chunks(stream, with_data: bool) -> Iterator[tuple]:
    """Rows of RECORD_CHUNKS. Length and digest are those of the payload so far;
    in the last row of a record they are whole, and checked against its head."""
    members = Members(stream)
    while (found := members.head()) is not None:
        _, warc = found
        _, http = members.head()
        identifier, kind = warc["warc-record-id"], warc["warc-type"]
        stated = warc["warc-payload-digest"].removeprefix("sha1:")
        refers = page_id_of(warc["warc-refers-to"]) if kind == REVISIT else None
        size = int(http["content-length"])
        base = (page_id_of(identifier), identifier, kind, refers, warc["warc-target-uri"])
        if kind == REVISIT:
            yield (*base, 0, True, size, stated, None)
        else:
            digest, read, number = hashlib.sha1(), 0, 0
            while True:
                data = members.take(min(CHUNK, size - read))
                digest.update(data)
                read += len(data)
                so_far = base32(digest.digest())
                if read == size and so_far != stated:
                    raise ValueError(f"payload of {identifier} has another digest than its head")
                yield (*base, number, read == size, read, so_far, data if with_data else None)
                number += 1
                if read == size:
                    break
        if members.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {identifier} does not end as stated")


def read_archives(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of the manifest's archives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_stream(place, compression=None) as stream:
                    for row in record_chunks(stream, with_data):
                        rows.append(row)
                        held += len(row[-1] or b"") + 500
                        if held >= 4_000_000:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(_ARROW)], names=[f.name for f in RECORD_CHUNKS]
        )

    readers = min(MOST_READERS, max(1, manifest.count()))
    return manifest.select("path").repartitionByRange(readers, "path").mapInArrow(read, RECORD_CHUNKS)
