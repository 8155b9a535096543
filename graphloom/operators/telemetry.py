"""Usage telemetry: aggregates, keyset pages, activity."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The endpoints whose use counts.
COUNTED_ENDPOINTS = ("/md", "/domains")


def qualifying(telemetry: DataFrame, since: str | None = None) -> DataFrame:
    """Object reads by skills through the counted endpoints, from ``since`` (ISO text, compared as text) on."""
    found = (F.col("level") == "object") & (F.col("caller") == "skill") & F.col("endpoint").isin(*COUNTED_ENDPOINTS)
    return telemetry.where(found & (F.col("ts") >= since) if since else found)


def cutoff(now: datetime, days: int) -> str:
    """The text from which a look-back of 1 to 365 days counts."""
    return (now - timedelta(days=min(365, max(1, days)))).isoformat()


def _or_unknown(column: str) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit("?"))


def total(telemetry: DataFrame) -> DataFrame:
    return telemetry.agg(F.count("*").alias("total"))


def by_type(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy(_or_unknown("obj_type").alias("obj_type")).agg(F.count("*").alias("n"))


def by_user(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy(_or_unknown("user").alias("user")).agg(F.count("*").alias("n"))


def by_operator(telemetry: DataFrame) -> DataFrame:
    """Blank operators do not count."""
    return telemetry.where("operator <> ''").groupBy("operator").agg(F.count("*").alias("n"))


def top_ids(telemetry: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` ids used most, ties to the smaller id; the type is the one last seen."""
    counts = telemetry.groupBy(_or_unknown("obj_id").alias("obj_id")).agg(
        F.count("*").alias("n"), F.max_by(_or_unknown("obj_type"), F.struct("ts", "seq")).alias("obj_type")
    )
    return counts.orderBy(F.desc("n"), "obj_id").limit(k)


def hour_label(ts: Column) -> Column:
    """``MM-DD HH:00`` of an ISO text in its own offset; null where it is not a time."""
    parts = F.regexp_extract(ts, r"^\d{4}-(\d{2}-\d{2})[T ](\d{2})(?::\d{2}(?::\d{2}(?:\.\d+)?)?)?(?:Z|[+-]\d{2}:?\d{2})?$", 1)
    hour = F.regexp_extract(ts, r"^\d{4}-\d{2}-\d{2}[T ](\d{2})", 1)
    return F.when(parts != "", F.concat(parts, F.lit(" "), hour, F.lit(":00")))


def timeline(telemetry: DataFrame) -> DataFrame:
    """Counts for each hour label, in order of the label's text; bad times are left out here only."""
    labelled = telemetry.select(hour_label(F.col("ts")).alias("hour")).where("hour is not null")
    return labelled.groupBy("hour").agg(F.count("*").alias("n")).orderBy("hour")


def parse_cursor(cursor: str) -> tuple[str, int | None]:
    """A time and, after ``|``, the row that was read last; a bare time has none."""
    ts, bar, seq = cursor.rpartition("|")
    return (ts, int(seq)) if bar and seq.isdigit() else (cursor, None)


def feed_page(telemetry: DataFrame, cursor: str = "", limit: int = 100) -> DataFrame:
    """The next ``limit`` + 1 rows after a cursor by (ts, seq): one more than asked shows that there are more.

    An empty cursor starts at the beginning, a bare time includes it, ``ts|seq`` is strictly after that row. Only rows from
    the cursor on are sorted, and only ``limit`` + 1 of each partition.
    """
    rows = telemetry
    if cursor:
        ts, seq = parse_cursor(cursor)
        later = F.col("ts") >= ts if seq is None else (F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("seq") > seq))
        rows = rows.where(later)
    return rows.orderBy("ts", "seq").limit(limit + 1)


def read_feed(telemetry: DataFrame, cursor: str = "", limit: int = 100) -> tuple[list, bool, str]:
    """(rows, has_more, next cursor) for a client; an empty page gives the cursor back."""
    found = feed_page(telemetry, cursor, limit).collect()  # at most limit + 1 rows
    rows = found[:limit]
    return rows, len(found) > limit, f"{rows[-1]['ts']}|{rows[-1]['seq']}" if rows else cursor


def user_activity(telemetry: DataFrame, user: str, limit: int = 100) -> DataFrame:
    """A user's requests, newest first."""
    return telemetry.where((F.col("level") == "request") & (F.col("user") == user)).orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def object_id_of_path(path: Column) -> Column:
    """The id in ``/api/v1/objects/<id>[/...]``, URL-decoded; null elsewhere."""
    raw = F.regexp_extract(path, r"^/api/v1/objects/([^/?]+)", 1)
    return F.when(raw != "", F.try_url_decode(raw))
