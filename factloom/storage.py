"""Where tables that cut a lineage are kept."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Folders made by ``new_path`` since the innermost open ``scratch`` began.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's
    ``spark.checkpoint.dir``. Where that is unset, a temporary folder if all of Spark
    runs in this process, else an error: executors would each write to a disk of their own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/factloom/{label}-{uuid.uuid4().hex}"
    for paths in _open:
        paths.append(path)
    return path


#: Rows of a file of a written table whose number of rows is bounded beforehand.
FILE_ROWS = 100_000


def _few(df: DataFrame, rows: int | None) -> DataFrame:
    return df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back; survives the loss of executors. ``rows``
    bounds the table's rows where that is known: a small table then is a few files, however
    many partitions its exchanges have, and a large one has files in proportion."""
    path = new_path(df.sparkSession, label)
    _few(df, rows).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_counted(df: DataFrame, label: str, rows: int | None = None) -> tuple[DataFrame, int]:
    """``written``, and the number of rows, counted while they are written."""
    seen = Observation()
    out = written(_few(df, rows).observe(seen, F.count(F.lit(1)).alias("n")), label)
    return out, seen.get["n"]


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made."""
    for folder in _folders(df):
        if "/factloom/" in folder:
            _delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those that the frames put
    into the list read; nothing lazy that needs the others may leave the block."""
    kept: list[DataFrame] = []
    _open.append([])
    try:
        yield kept
    finally:
        made = _open.pop()
        needed = {f.rsplit("/", 1)[-1] for df in kept for f in _folders(df)}
        for path in made:
            if path.rsplit("/", 1)[-1] not in needed:
                _delete(spark, path)
