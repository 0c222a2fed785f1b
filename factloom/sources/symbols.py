"""Compile-time symbols: the solver's event log, one JSON object in a line, and a launcher
for the solver, a program of its own that writes such a log to its standard output."""

from __future__ import annotations

import queue
import subprocess
import threading
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SITE = "struct<line:int,col:int,name:string,kind:string,resolution:string,declaring:string,signature:string,static:boolean,target_kind:string,argc:int,reason:string>"
EVENTS = f"event string, protocol int, jar_count int, elapsed_ms long, relpath string, status string, note string, message string, sites array<{SITE}>"
STRONG_ZERO = 0.95
#: Seconds until the solver must be ready, and between any two of its lines.
START_S, IDLE_S = 600.0, 120.0


def launch(command: list[str], log: str, start_s: float = START_S, idle_s: float = IDLE_S) -> dict:
    """Run the solver and keep its log; it is stopped if it is not ready in time, or falls
    silent. What it said until then stays usable: ``status`` calls such a log partial or failed."""
    try:
        process = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, encoding="utf-8", errors="replace")
    except OSError as error:
        open(log, "w", encoding="utf-8").close()
        return {"lines": 0, "exit_code": None, "stopped": None, "error": str(error)}
    said: queue.Queue[str | None] = queue.Queue()
    errors: list[str] = []

    def follow() -> None:
        for line in process.stdout:
            said.put(line)
        said.put(None)

    threads = [threading.Thread(target=follow, daemon=True), threading.Thread(target=lambda: errors.extend(process.stderr), daemon=True)]
    for thread in threads:
        thread.start()
    began, ready, lines, stopped = time.monotonic(), False, 0, None
    with open(log, "w", encoding="utf-8") as out:
        while True:
            left = idle_s if ready else began + start_s - time.monotonic()
            try:
                line = said.get(timeout=max(0.0, left))
            except queue.Empty:
                stopped = "idle" if ready else "not ready"
                process.kill()
                break
            if line is None:
                break
            out.write(line if line.endswith("\n") else line + "\n")
            lines += 1
            ready = ready or '"solver_ready"' in line
    code = process.wait()
    threads[1].join(5)
    return {"lines": lines, "exit_code": code, "stopped": stopped, "error": "".join(errors)[-2000:] or None}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The log; lines that are no JSON object are kept as events of kind ``malformed``."""
    return events_of(spark.read.text(path))


def events_of(lines: DataFrame) -> DataFrame:
    """Events of a log's lines (column ``value``)."""
    parsed = lines.where("trim(value) <> ''").select(F.from_json("value", EVENTS, {"mode": "PERMISSIVE"}).alias("e"))
    return parsed.select("e.*").withColumn("event", F.coalesce("event", F.lit("malformed")))


def sites(events: DataFrame) -> DataFrame:
    """Call sites of all files; those without line or name are left out."""
    rows = events.where("event = 'file'").select("relpath", F.explode("sites").alias("s")).select("relpath", "s.*")
    return rows.where("line is not null and name is not null")


def status(events: DataFrame) -> DataFrame:
    """One row: ok if the log has its summary, partial if it broke off after the solver was
    ready, failed if before, unavailable if nothing came; files, failures, coverage."""
    is_file = F.col("event") == "file"
    found = F.filter("sites", lambda x: x["resolution"].isin("expr", "scope"))

    def count(condition) -> Column:
        return F.count(F.when(condition, 1))

    totals = events.agg(
        count(F.col("event") == "summary").alias("summaries"),
        count(F.col("event") == "solver_ready").alias("ready"),
        F.count("*").alias("events"),
        count(is_file).alias("files"),
        count(is_file & (F.col("status") == "failed")).alias("failed_files"),
        count(F.col("event") == "malformed").alias("malformed"),
        F.coalesce(F.sum(F.when(is_file, F.greatest(F.size("sites"), F.lit(0)))), F.lit(0)).cast("long").alias("sites"),
        F.coalesce(F.sum(F.when(is_file, F.greatest(F.size(found), F.lit(0)))), F.lit(0)).cast("long").alias("resolved"),
    )
    state = F.when(F.col("summaries") > 0, "ok").when(F.col("ready") > 0, "partial").when(F.col("events") > 0, "failed").otherwise("unavailable")
    rate = F.round(F.try_divide("resolved", "sites"), 4)
    strong = (F.col("status") == "ok") & (F.col("coverage") >= STRONG_ZERO) & (F.col("failed_files") == 0)
    return totals.select(
        state.alias("status"), "files", "failed_files", "malformed", "sites", "resolved", rate.alias("coverage")
    ).withColumn("strong_zero", F.coalesce(strong, F.lit(False)))
