"""Keyed state of paths, joins of streams, and the steps that a listener writes."""

import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from graphloom.sources import files
from graphloom.streaming import changes, telemetry

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_paths_that_come_change_go_and_come_back(spark, tmp_path):
    scans = str(tmp_path / "scans")

    def scan(hour, **found):
        changes.add_scan(spark.createDataFrame(list(found.items()) or [("none", 0.0)], "path string, mtime double"), scans, START + timedelta(hours=hour))

    def run():
        before = spark.conf.get(changes._PROVIDER)
        spark.conf.set(changes._PROVIDER, changes._ROCKSDB)
        try:
            stream = changes.changes(changes.read_scans(spark, scans)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            stream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.set(changes._PROVIDER, before)
        return sorted((r.path, r.at, r.change, r.mtime) for r in spark.read.parquet(str(tmp_path / "out")).select("path", "change", "mtime", (F.unix_seconds("scan") / 3600 - START.timestamp() / 3600).alias("at")).collect())

    scan(0, a=1.0, b=1.0, c=1.0)
    first = run()
    assert first == [("a", 0.0, "added", 1.0), ("b", 0.0, "added", 1.0), ("c", 0.0, "added", 1.0)]
    scan(1, a=1.0, b=2.0)
    scan(2, a=1.0, b=2.0)
    scan(3, a=1.0, b=2.0, c=5.0)
    got = run()  # a new run goes on with the state of the first
    assert got == sorted([*first, ("b", 1.0, "changed", 2.0), ("c", 0.0, "deleted", 1.0), ("c", 3.0, "added", 5.0)])


def test_reads_of_requests_as_streams(spark, tmp_path):
    """Two streams give what the batch join gives; a row that comes later than agreed is dropped."""
    rows = lambda *r: spark.createDataFrame([(i, f"2026-01-01T{h:02}:{m:02}:00", u, "o") for i, h, m, u in r], "seq long, ts string, user string, obj_id string")
    requests = [rows((1, 0, 0, "a"), (2, 0, 5, "b"), (3, 1, 0, "a")), rows((4, 9, 0, "a"))]
    reads = [rows((11, 0, 3, "a"), (12, 0, 20, "b"), (13, 1, 10, "a"), (14, 0, 3, "b")), rows((15, 9, 1, "a"))]
    for name, parts in (("requests", requests), ("reads", reads)):
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        left, right = (telemetry.read_log(spark, str(tmp_path / name), requests[0].schema, 1) for name in ("requests", "reads"))
        out = telemetry.reads_of_requests(left, right, "10 minutes", "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        out.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.request, r["read"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    batch = telemetry.reads_of_requests(requests[0].union(requests[1]), reads[0].union(reads[1]), "10 minutes")
    assert run() == sorted((r.request, r["read"]) for r in batch.collect()) == [(1, 11), (3, 13), (4, 15)]
    rows((5, 0, 0, "a"), (6, 9, 30, "a")).coalesce(1).write.mode("append").parquet(str(tmp_path / "requests"))
    rows((16, 0, 1, "a"), (17, 9, 31, "a")).coalesce(1).write.mode("append").parquet(str(tmp_path / "reads"))
    assert run() == [(1, 11), (3, 13), (4, 15), (6, 17)]  # (5, 16) fits, but its hour is long over


def test_steps_of_a_streaming_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(5).write.mode("append").parquet(str(tmp_path / "in"))
    writer = changes.StepWriter(spark, str(tmp_path / "steps"))
    spark.streams.addListener(writer)
    try:
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check"))
        job = stream.trigger(availableNow=True).start()
        job.awaitTermination()
        for _ in range(50):
            steps = changes.read_steps(spark, str(tmp_path / "steps")).where(F.col("job") == str(job.runId)).collect()
            if any(s.step == "done" for s in steps):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(writer)
    assert {s.step for s in steps} == {"started", "batch", "done"} and [s.rows for s in steps if s.step == "batch"][0] == 5


def test_chosen_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/é x.md").write_text("text", encoding="utf-8")
    rows = spark.createDataFrame([("d/é x.md", 1), ("gone.md", 2)], "path string, n int")
    assert sorted((r.path, r.content and bytes(r.content), r.n) for r in files.read_chosen(rows, str(tmp_path)).collect()) == [("d/é x.md", b"text", 1), ("gone.md", None, 2)]
