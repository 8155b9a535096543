"""Runs of test cases as archives: uploaded into the review folder, their cards kept, and downloaded again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markdown import set_fields
from ..functions.text import unsafe_member
from .archives import read_archives, write_files, write_named_archives
from .files import listing, read_chosen

#: What a run's card says, in this order.
CARD = ("id", "type", "case", "run_at", "runner", "status", "name", "notes")


def _card(raw_md: F.Column, fields: dict[str, F.Column]) -> F.Column:
    """A card with the fields that are not null set; what it does not have it gets in the order of ``CARD``."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), fields[k].cast("string").alias("value")) for k in CARD if k in fields))
    return set_fields(raw_md, F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())))


def upload_runs(spark: SparkSession, archives: str, uploads: DataFrame, cases: DataFrame, root: str, now: str) -> DataFrame:
    """Unpacks archives as runs below ``root``; returns the uploads whose case is not among ``cases`` (id), which are refused.

    ``uploads`` is (archive, case, id, name, runner): the archive's file name, and the run that it becomes. Members go to
    ``runs/<case>/<id>/``; members with unsafe names are passed over. A run without a card ``<id>.md`` gets one that says when it was
    run (``now``), by whom (``upload`` where that is null or empty), and that it is completed. Tasks inflate ranges of the archives and write the
    files; no archive or run is in memory as a whole.
    """
    known = uploads.join(cases.select(F.col("id").alias("case")).distinct(), "case", "left_semi")
    name = F.replace("name", F.lit("\\"), F.lit("/"))
    members = read_archives(spark, archives).select(F.regexp_extract("archive", r"([^/]+)$", 1).alias("archive"), name.alias("member"), "content")
    safe = members.where(~unsafe_member(F.col("member")))
    folder = F.concat(F.lit("runs/"), "case", F.lit("/"), "id", F.lit("/"))
    files = safe.join(known, "archive").select(F.concat(folder, "member").alias("path"), "content")
    write_files(files, root)
    own = listing(spark, root, "*.md").select("path")
    card = F.concat(folder, "id", F.lit(".md"))
    without = known.withColumn("path", card).join(own, "path", "left_anti")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    fields = {"id": F.col("id"), "type": F.lit("Run"), "case": F.col("case"), "run_at": F.lit(now), "runner": F.coalesce(text("runner"), F.lit("upload")), "status": F.lit("completed"), "name": text("name")}
    heading = F.concat(F.lit("# "), F.coalesce(text("name"), "id"), F.lit("\n"))
    write_files(without.select("path", _card(heading, fields).cast("binary").alias("content")), root)
    return uploads.join(cases.select(F.col("id").alias("case")).distinct(), "case", "left_anti")


def update_runs(spark: SparkSession, root: str, changes: DataFrame) -> None:
    """Edits the cards of runs: ``changes`` is (case, id, name, runner, run_at, status, notes), null where a field stays.

    A run without a card gets one. Only the cards of these runs are read and written.
    """
    path = F.concat(F.lit("runs/"), "case", F.lit("/"), "id", F.lit("/"), "id", F.lit(".md"))
    found = read_chosen(changes.withColumn("path", path), root)
    heading = F.concat(F.lit("# "), F.coalesce("name", "id"), F.lit("\n"))
    fields = {"type": F.lit("Run")} | {c: F.col(c) for c in ("id", "case", "name", "runner", "run_at", "status", "notes")}
    write_files(found.select("path", _card(F.coalesce(F.col("content").cast("string"), heading), fields).cast("binary").alias("content")), root)


def download_runs(spark: SparkSession, root: str, target: str, ids: DataFrame | None = None) -> None:
    """Packs all runs below ``root``, or those of ``ids`` (id), as ``<id>.zip`` each, with reviews and all other files.

    Only paths are shuffled; the task that writes an archive opens its files one after the other.
    """
    pattern = r"^runs/[^/]+/(Run@[^/]+)/(.+)$"
    files = listing(spark, root).where(F.col("path").rlike(pattern)).select("path", F.regexp_extract("path", pattern, 1).alias("archive"), F.regexp_extract("path", pattern, 2).alias("name"))
    if ids is not None:
        files = files.join(ids.select(F.col("id").alias("archive")).distinct(), "archive", "left_semi")
    tasks = max(16, 4 * spark.sparkContext.defaultParallelism)  # the paths are few bytes, what they name is not
    placed = files.repartition(tasks, "archive").sortWithinPartitions("archive", "name")
    write_named_archives(read_chosen(placed, root), target)
