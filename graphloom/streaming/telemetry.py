"""Telemetry as a stream: hourly counts, sessions, the change feed, de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.telemetry import qualifying


def read_log(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet log files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def hourly_counts(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Qualifying uses for each hour; an hour is given out once the watermark has passed it."""
    timed = qualifying(log).withColumn("at", F.to_timestamp("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "n")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, n): a user's uses with no longer pause than ``gap``."""
    timed = log.withColumn("at", F.to_timestamp("ts")).withWatermark("at", late)
    found = timed.groupBy("user", F.session_window("at", gap)).agg(F.count("*").alias("n"))
    return found.select("user", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def without_repeats(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events whose sequence number was not seen within the watermark."""
    return log.withColumn("at", F.to_timestamp("ts")).withWatermark("at", late).dropDuplicatesWithinWatermark(["seq"])


def reads_of_requests(requests: DataFrame, reads: DataFrame, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(request, user, requested_at, read, obj_id, read_at): the objects that a user read in the time ``within`` after a request.

    Both are logs (seq, ts, user, ...); as streams their rows may come ``late``, later ones are dropped. Requests are held until
    no read that fits can come any more, reads until no request can. Over tables it is the plain join.
    """
    left = requests.select(F.col("seq").alias("request"), "user", F.to_timestamp("ts").alias("requested_at")).withWatermark("requested_at", late)
    right = reads.select(F.col("seq").alias("read"), F.col("user").alias("_user"), "obj_id", F.to_timestamp("ts").alias("read_at")).withWatermark("read_at", late)
    near = (F.col("read_at") >= F.col("requested_at")) & (F.col("read_at") <= F.col("requested_at") + F.expr(f"interval {within}"))
    return left.join(right, (F.col("user") == F.col("_user")) & near).select("request", "user", "requested_at", "read", "obj_id", "read_at")


def append_feed(log: DataFrame, path: str, checkpoint: str):
    """Writes qualifying uses on to ``path``, all that is there now, then stops; the checkpoint is the cursor."""
    feed = qualifying(log).select("seq", "ts", "obj_id", "obj_type", "user", "operator")
    return feed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def append_log(rows: DataFrame, path: str) -> bool:
    """Adds rows to a log, and says whether it could: what is being logged goes on where it cannot."""
    try:
        rows.write.mode("append").parquet(path)
    except Exception:  # noqa: BLE001  a log that fails must not stop what it tells of
        return False
    return True
