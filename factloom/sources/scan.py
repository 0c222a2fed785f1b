"""Source files of any encoding, read by Spark's binary source."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Folders that hold no sources.
EXCLUDED = ["target", "build", "out", "bin", "node_modules", ".git", ".svn", ".hg", ".idea", ".vscode", ".gradle", ".settings", "dist"]
LOW_CONFIDENCE = 0.5
FILES = T.StructType(
    [
        T.StructField("relpath", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("encoding", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
# Byte order marks, the longer first.
_MARKS = [(b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")]


def detect_encoding(data: bytes) -> tuple[str, float]:
    """Encoding and confidence: byte order mark, strict UTF-8, a statistical guess (Chinese
    ones read as GB18030, which contains them), else GB18030 with little confidence."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return name, 1.0
    try:
        data.decode("utf-8")
        return "utf-8", 1.0
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return "gb18030", 0.3
    best = from_bytes(data).best()
    if best is None:
        return "gb18030", 0.3
    name = best.encoding.lower().replace("_", "-")
    confidence = max(0.3, min(0.95, round(1.0 - best.chaos, 2)))
    try:
        data.decode("gb18030")
        chinese = True
    except UnicodeDecodeError:
        chinese = False
    if chinese or name in ("gb2312", "gbk", "cp936", "hz", "big5", "big5hkscs"):
        return "gb18030", confidence
    return name, confidence


def read_text(data: bytes) -> tuple[str | None, str, float, str | None]:
    """(text, encoding, confidence, error); what can't be decoded is replaced."""
    name, confidence = detect_encoding(data)
    try:
        return data.decode(name), name, confidence, None
    except (UnicodeDecodeError, LookupError) as error:
        return data.decode("gb18030", "replace"), "gb18030", 0.2, str(error)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [read_text(x or b"") for x in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("relpath"),
                batch.column("size"),
                pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.float64()),
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[3] for r in rows], pa.string()),
            ],
            names=FILES.names,
        )


def binary_files(spark: SparkSession, root: str, glob: str, excluded: list[str] | None = None) -> DataFrame:
    """(relpath, size, content) of the files below a root, without excluded folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/"))
    path = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    rel = F.substring(path, len(base) + 2, 1_000_000)
    folders = F.slice(F.split(rel, "/"), 1, F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))
    skip = F.arrays_overlap(folders, F.array(*(F.lit(x) for x in (excluded or EXCLUDED))))
    return found.where(~skip).select(rel.alias("relpath"), F.col("length").alias("size"), "content")


def scan(spark: SparkSession, root: str, glob: str = "*.java", excluded: list[str] | None = None) -> DataFrame:
    """Source files with their texts; a file that fails has an error, not a missing row."""
    return decoded(binary_files(spark, root, glob, excluded))


def decoded(files: DataFrame) -> DataFrame:
    """Files (relpath, size, content) with their texts."""
    return files.select("relpath", "size", "content").mapInArrow(_decode, FILES)


def skipped(root: str, excluded: list[str] | None = None) -> dict[str, list[str]]:
    """Folders and links that a scan of a local root leaves out."""
    out: dict[str, list[str]] = {"folders": [], "links": []}
    for folder, names, files in os.walk(root):
        for name in list(names):
            rel = os.path.relpath(os.path.join(folder, name), root)
            if os.path.islink(os.path.join(folder, name)):
                out["links"].append(rel)
                names.remove(name)
            elif name in (excluded or EXCLUDED):
                out["folders"].append(rel)
                names.remove(name)
        out["links"] += [os.path.relpath(os.path.join(folder, f), root) for f in files if os.path.islink(os.path.join(folder, f))]
    return {k: sorted(v) for k, v in out.items()}


def coverage_report(files: DataFrame) -> DataFrame:
    """Totals, encodings and files of low confidence, as (metric, value, n)."""
    low = F.col("confidence") < LOW_CONFIDENCE
    by_encoding = files.groupBy("encoding").agg(F.count("*").alias("n")).select(F.lit("encoding").alias("metric"), F.col("encoding").alias("value"), "n")
    totals = files.agg(
        F.count("*").alias("files"), F.count("text").alias("decoded"), F.count("error").alias("errors"), F.count(F.when(low, 1)).alias("low_confidence")
    )
    names = ["files", "decoded", "errors", "low_confidence"]
    pairs = totals.select(F.explode(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(x).alias("n")) for x in names))).alias("x"))
    return by_encoding.union(pairs.select("x.metric", F.lit(None).cast("string"), "x.n"))
