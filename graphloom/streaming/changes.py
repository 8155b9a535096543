"""What changes in a folder, from a stream of listings: keyed state by path tells what is new, changed and gone.

A file stream never tells of deletions. A scan lists all files with its own time; state keeps when a path was last seen and
how old its file was, and a timer says that it is gone once it has not been seen for ``grace``, by the time of the scans.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import storage
from ..sources.bundles import admit, to_edges, to_objects
from ..sources.files import listing, read_files
from ..sources.tables import Store

SCANS = "path string, mtime double, scan timestamp"
CHANGES = "path string, change string, mtime double, at long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_scan(spark: SparkSession, root: str, scans: str, at: datetime, pattern: str = "*.md") -> None:
    """Adds a listing of the files below ``root`` to the scans; a scan is one file, so that a batch never has half of it."""
    add_scan(listing(spark, root, pattern), scans, at)


def add_scan(files: DataFrame, scans: str, at: datetime) -> None:
    """Adds (path, mtime) as a scan of the time ``at``; one task writes, what finds the files stays with its own tasks."""
    stamp = F.lit(at.astimezone(timezone.utc).isoformat()).cast("timestamp")
    files.select("path", "mtime", stamp.alias("scan")).repartition(1).write.mode("append").parquet(scans)


def read_scans(spark: SparkSession, scans: str) -> DataFrame:
    return spark.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).parquet(scans)


def path_changes(grace_ms: int) -> StatefulProcessor:
    """A processor of one path's rows. Its class is made here, so that it travels whole: the worker that sets up state on the
    driver does not get the library's code."""

    class PathChanges(StatefulProcessor):
        """The state of one path: the time of its file and of the last scan that listed it, with a timer from there."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.known = handle.getValueState("known", "mtime double, at long")

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
            newest = max(rows, key=lambda r: (r.at, r.mtime))
            mtime, at = self.known.get() if self.known.exists() else (None, None)
            if at is not None and newest.at <= at:
                return
            if at is not None and newest.at > at + grace_ms:  # it was gone, and came back before its timer was due
                yield Row(path=key[0], change="deleted", mtime=mtime, at=at)
                mtime = None
            if mtime is None or newest.mtime != mtime:
                yield Row(path=key[0], change="added" if mtime is None else "changed", mtime=newest.mtime, at=newest.at)
            self.known.update((newest.mtime, newest.at))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest.at + grace_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
            mtime, at = self.known.get()
            self.known.clear()
            yield Row(path=key[0], change="deleted", mtime=mtime, at=at)

        def close(self) -> None:
            pass

    return PathChanges()


def changes(scans: DataFrame, grace: str = "90 minutes") -> DataFrame:
    """(path, change, mtime, scan) of a stream of scans: ``added``, ``changed`` (another file time), ``deleted``.

    A path is deleted when the scans' time has gone on by more than ``grace`` since one listed it; ``grace`` should be longer than
    the pause between two scans. A path that comes back is added again. Scans that come out of order change nothing.
    """
    spark = scans.sparkSession
    ms = spark.range(1).select((F.expr(f"unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {grace})")).alias("ms")).first()[0]
    timed = scans.withWatermark("scan", "0 seconds").withColumn("at", F.unix_millis("scan"))
    found = timed.groupBy("path").transformWithState(path_changes(ms), CHANGES, "append", "eventTime")
    return found.select("path", "change", "mtime", F.timestamp_millis("at").alias("scan"))


def follow(spark: SparkSession, root: str, scans: str, store: Store, registry: DataFrame, checkpoint: str, grace: str = "90 minutes"):
    """Brings the store up to date with all scans that are there, then stops; the files of paths that have not changed stay closed."""

    def merge(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        gone = batch.where("change = 'deleted'").select(F.col("path").alias("source_path"))
        if not gone.isEmpty():
            store.remove(gone)
        new = batch.where("change <> 'deleted'").select("path", "mtime")
        if not new.isEmpty():
            documents = read_files(new, root).select(F.col("path").alias("source_path"), F.col("content").cast("string").alias("raw_md"), "mtime")
            admitted = admit(documents, registry).where("warning is null").persist()
            store.merge(to_objects(admitted), to_edges(admitted))
            admitted.unpersist()
        batch.unpersist()

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # keyed state with timers is kept by RocksDB only
    try:
        found = changes(read_scans(spark, scans), grace)
        return found.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)


class StepWriter(StreamingQueryListener):
    """Writes the steps of streaming jobs as JSON files while they run: started, each batch with its rows, ended or failed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _write(self, job: str, step: str, batch: int | None = None, rows: int | None = None, error: str | None = None) -> None:
        at = datetime.now(timezone.utc).isoformat()
        storage.write_text(self.spark, f"{self.folder}/{uuid.uuid4().hex}.json", json.dumps({"job": job, "step": step, "batch": batch, "rows": rows, "error": error, "at": at}))

    def onQueryStarted(self, event) -> None:  # noqa: N802  Spark's names
        self._write(str(event.runId), "started")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._write(str(p.runId), "batch", p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._write(str(event.runId), "failed" if event.exception else "done", error=event.exception)


def read_steps(spark: SparkSession, folder: str) -> DataFrame:
    """(job, step, batch, rows, error, at) of all jobs that a ``StepWriter`` has told of."""
    return spark.read.schema("job string, step string, batch long, rows long, error string, at timestamp").json(folder)
