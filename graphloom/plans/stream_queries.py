"""Queries that replay changes and logs as streams and end with what a batch would give."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from ..model import default_registry
from ..sources import archives, files, tables
from ..streaming import changes
from ..streaming import telemetry as streams
from . import fixtures as X
from .registry import query, scratch, stored


@query("""SELECT 'ConfigurationSolution@' || s_name AS id, CASE WHEN s_suppkey % 6 = 0 THEN 'new ' ELSE '' END || s_name AS name FROM supplier WHERE s_suppkey % 6 <> 1""")
def followed_documents(spark, sf):
    """Documents are created, some change, some go; the store follows the scans of their folder in two runs."""
    key = F.col("s_suppkey")
    path = F.concat(F.lit("Business/"), key % 5, F.lit("/"), "s_name", F.lit(".md"))

    def documents(front):
        text = F.concat(F.lit("---\nid: ConfigurationSolution@"), "s_name", F.lit("\ntype: ConfigurationSolution\ndomain: d\nscenario: s\nname: "), F.lit(front), "s_name", F.lit("\n---\n# x\n"))
        return X.read(spark, sf, "supplier").select(path.alias("path"), text.cast("binary").alias("content"), key.alias("key"))

    root, kept = scratch(spark, "followed"), scratch(spark, "follow")
    store, registry = tables.Store(spark, f"{kept}/store", 2), default_registry(spark)
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    at = lambda n: start + timedelta(hours=n)
    archives.write_files(documents(""), root)
    changes.write_scan(spark, root, f"{kept}/scans", at(0))
    changes.follow(spark, root, f"{kept}/scans", store, registry, f"{kept}/check").awaitTermination()
    archives.write_files(documents("new ").where("key % 6 = 0"), root)
    gone = documents("").where("key % 6 = 1").select("path")
    for n in range(1, 4):
        changes.add_scan(files.listing(spark, root, "*.md").join(gone, "path", "left_anti"), f"{kept}/scans", at(n))
    changes.follow(spark, root, f"{kept}/scans", store, registry, f"{kept}/check").awaitTermination()
    return store.objects().select("id", "name")


@query("""SELECT r.seq AS request, r.user, o.seq AS read, o.obj_id FROM telemetry r JOIN telemetry o ON r.user = o.user AND r.level = 'request' AND o.level = 'object'
  AND o.ts::TIMESTAMP >= r.ts::TIMESTAMP AND o.ts::TIMESTAMP <= r.ts::TIMESTAMP + INTERVAL 6 HOUR""")
def request_reads(spark, sf):
    """Requests and object reads as two streams, joined by user within six hours."""
    log = stored(X.telemetry(spark, sf).select("seq", "ts", "level", "user", "obj_id"), "log")
    folder = scratch(spark, "joined")
    for level in ("request", "object"):
        log.where(F.col("level") == level).repartitionByRange(4, "ts").write.parquet(f"{folder}/{level}")
    requests, reads = (streams.read_log(spark, f"{folder}/{level}", log.schema, 2) for level in ("request", "object"))
    found = streams.reads_of_requests(requests, reads, "6 hours", "3650 days")  # files are not read in the order of time, so rows may be late
    found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out").select("request", "user", "read", "obj_id")
