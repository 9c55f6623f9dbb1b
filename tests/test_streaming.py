"""Streams give what the batch operators give."""

import datetime as dt
import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from broadsheet.operators import registry, reports
from broadsheet.streaming import logs, watcher

SCANS = [(1, "a", 1), (2, "a", 2), (3, "a", 2), (4, "a", 2), (5, "a", 2), (1, "b", 7), (2, "b", 7), (4, "b", 7), (5, "b", 7), (6, "b", 7), (7, "b", 7)]
SCAN_SCHEMA = "scan_id long, path string, size long, mtime_ns long"


def test_release_at_third_scan_with_one_fingerprint(spark):
    rows = registry.stable_files(spark.createDataFrame([(s, p, z, z) for s, p, z in SCANS], SCAN_SCHEMA)).collect()
    assert {(r.scan_id, r.path) for r in rows} == {(4, "a"), (6, "b")}


def write_json(folder: str, name: str, rows: list[dict], at: int) -> None:
    path = os.path.join(folder, name)
    with open(path, "w") as out:
        out.write("\n".join(json.dumps(r) for r in rows))
    os.utime(path, (at, at))


def test_watch_stream_equals_batch(spark):
    folder, now = tempfile.mkdtemp(prefix="scans-"), int(time.time())
    for scan in sorted({s for s, _, _ in SCANS}):
        rows = [{"scan_id": s, "path": p, "size": z, "mtime_ns": z} for s, p, z in SCANS if s == scan]
        write_json(folder, f"scan-{scan}.json", rows, now - 100 + scan)
    stream = spark.readStream.schema(SCAN_SCHEMA).option("maxFilesPerTrigger", 2).json(folder)
    query = watcher.stable_files_stream(stream).writeStream.format("memory").queryName("released").outputMode("append").start()
    # A query with processing-time timeouts never runs out of batches, so wait for its rows.
    deadline = time.time() + 90
    while sum(p["numInputRows"] for p in query.recentProgress) < len(SCANS) and time.time() < deadline:
        time.sleep(0.5)
    query.stop()
    streamed = {tuple(r) for r in spark.table("released").collect()}
    batch = {tuple(r) for r in registry.stable_files(spark.createDataFrame([(s, p, z, z) for s, p, z in SCANS], SCAN_SCHEMA)).collect()}
    assert streamed == batch


def test_stage_stream_equals_batch(spark):
    schema = "job_id long, log_id long, step_name string, status string, message string, created_at timestamp"
    rows = []
    for i in range(40):
        rows.append({"job_id": i % 3, "log_id": i, "step_name": ("scan", "render", "odd")[i % 3 - i % 2], "status": ("running", "failed", "completed")[i % 3],
                     "message": f"m{i}", "created_at": (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=(i * 7) % 40)).isoformat()})
    folder, now = tempfile.mkdtemp(prefix="logs-"), int(time.time())
    for k in range(4):
        write_json(folder, f"{k}.json", rows[k * 10:k * 10 + 10], now - 10 + k)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    query = logs.stage_updates(stream).writeStream.format("memory").queryName("stages").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    streamed = reports.fill_stages(spark.table("stages"))
    batch = reports.stage_progress(spark.read.schema(schema).json(folder))
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))


def test_register_stream_adds_each_file_once(spark):
    folder, root = tempfile.mkdtemp(prefix="found-"), tempfile.mkdtemp(prefix="registry-")
    schema = "source_path string, file_hash string, file_size long"
    spark.createDataFrame([("/in/a", "h1", 1)], schema).write.mode("append").parquet(f"{root}/table")
    now = int(time.time())
    rows = [{"source_path": "/in/a", "file_hash": h, "file_size": 1} for h in ("h1", "h2", "h2", "h3")]
    for k, row in enumerate(rows):
        write_json(folder, f"{k}.json", [row], now - 10 + k)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    query = logs.register_stream(stream, f"{root}/table", f"{root}/checkpoint").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.file_hash for r in spark.read.parquet(f"{root}/table").select(F.col("file_hash")).collect()) == ["h1", "h2", "h3"]
