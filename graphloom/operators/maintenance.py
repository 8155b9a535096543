"""Incremental maintenance of tables: upserts, replacements, removals, differences."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the keys of two tables."""
    return reduce(and_, (left[k].eqNullSafe(right[k]) for k in keys))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with the same keys, the one that is last in order."""
    by = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str] = ["id", "version"]) -> DataFrame:
    """Rows of ``new`` and those of ``old`` whose keys are not in it; null keys are equal."""
    ids = new.select(*keys).distinct().alias("n")
    kept = old.alias("o").join(ids, reduce(and_, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys)), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def replace_edges(edges: DataFrame, nodes: DataFrame, new: DataFrame) -> DataFrame:
    """All edges of ``nodes`` (id, version) are replaced by ``new``, without repeats."""
    own = nodes.select(F.col("id").alias("_id"), F.col("version").alias("_v")).distinct()
    kept = edges.join(own, (F.col("from_id") == F.col("_id")) & F.col("from_version").eqNullSafe(F.col("_v")), "left_anti")
    return kept.unionByName(new.dropDuplicates(["from_id", "from_version", "relation", "to_id"]))


def delete_by_path(objects: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, keys that went) for a table of source paths."""
    paths = paths.select("source_path").distinct()
    return objects.join(paths, "source_path", "left_anti"), objects.join(paths, "source_path", "left_semi").select("id", "version")


def changed_files(disk: DataFrame, objects: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(source_path, change): ``changed`` where a file is new or its time differs, ``deleted`` where it is gone."""
    known = objects.groupBy("source_path").agg(F.max("mtime").alias("known"))
    both = disk.select("source_path", F.col("mtime").alias("found")).join(known, "source_path", "full_outer")
    change = (
        F.when(F.col("found").isNull(), "deleted")
        .when(F.col("known").isNull() | (F.abs(F.col("found") - F.col("known")) > tolerance), "changed")
    )
    return both.select("source_path", change.alias("change")).where("change is not null")


def removed_under(objects: DataFrame, disk: DataFrame, prefixes: list[str]) -> DataFrame:
    """Indexed objects under the prefixes whose files are no longer there."""
    from .graph import under_prefixes

    return under_prefixes(objects, prefixes).join(disk.select("source_path").distinct(), "source_path", "left_anti")


def merge_registry(registry: DataFrame, extension: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry with the extension's types, which override; warnings (type, warning) for those it overrides)."""
    merged = registry.join(extension.select("type"), "type", "left_anti").unionByName(extension)
    overridden = extension.join(registry.select("type"), "type", "left_semi")
    return merged, overridden.select("type", F.concat(F.lit("overridden by extension: "), "type").alias("warning"))


def merge_jobs(memory: DataFrame, stored: DataFrame, limit: int = 100) -> DataFrame:
    """Jobs newest first; what memory knows of a job beats what is stored."""
    merged = memory.unionByName(stored.join(memory.select("id"), "id", "left_anti"))
    return merged.orderBy(F.desc("started_at"), "id").limit(limit)


def put_jobs(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs with those of ``new``, which replace jobs of their ids."""
    return upsert(jobs, new, ["id"])


def drop_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return jobs.join(ids.select("id").distinct(), "id", "left_anti")


def may_start(jobs: DataFrame, kind: str) -> bool:
    """Whether no job of a kind is waiting or running: there is one at a time."""
    return jobs.where((F.col("kind") == kind) & F.col("status").isin("pending", "running")).isEmpty()


def step_done(jobs: DataFrame, id_: Column | str, step: str, status: str, detail: str = "") -> DataFrame:
    """Jobs where ``steps array<struct<name,status,detail>>`` of one job has the step with a new status, added if it is new."""
    entry = F.struct(F.lit(step).alias("name"), F.lit(status).alias("status"), F.lit(detail).alias("detail"))
    known = F.exists("steps", lambda s: s["name"] == step)
    changed = F.when(known, F.transform("steps", lambda s: F.when(s["name"] == step, entry).otherwise(s))).otherwise(F.concat("steps", F.array(entry)))
    return jobs.withColumn("steps", F.when(F.col("id") == (id_ if isinstance(id_, Column) else F.lit(id_)), changed).otherwise(F.col("steps")))


def sweep_crashed(jobs: DataFrame, now: float, alive: DataFrame) -> DataFrame:
    """Jobs after a restart: those that were waiting or running and are not in ``alive`` (id) have failed."""
    marked = jobs.join(F.broadcast(alive.select("id", F.lit(True).alias("_alive")).distinct()), "id", "left")  # jobs that run now: few
    crashed = F.col("status").isin("pending", "running") & F.col("_alive").isNull()
    return marked.withColumns({"status": F.when(crashed, "failed").otherwise(F.col("status")), "finished_at": F.when(crashed, F.lit(now)).otherwise(F.col("finished_at"))}).drop("_alive")


def with_columns_of(rows: DataFrame, schema: StructType) -> DataFrame:
    """Rows of an older table with the columns of ``schema``: missing ones are null, and types follow the schema."""
    found = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    return rows.select(*found, *(c for c in rows.columns if c not in schema.names))


def import_counts(valid: DataFrame, existing: DataFrame) -> DataFrame:
    """(added, updated, warnings) of a bundle: rows (path, warning); a path that repeats counts as updated."""
    targets = valid.where("warning is null").groupBy("path").agg(F.count("*").alias("n"))
    known = existing.select("path").distinct().withColumn("_there", F.lit(True))
    counts = targets.join(known, "path", "left").agg(
        F.coalesce(F.sum(F.when(F.col("_there").isNull(), 1).otherwise(0)), F.lit(0)).alias("added"), F.coalesce(F.sum("n"), F.lit(0)).alias("valid")
    )
    warned = valid.where("warning is not null").agg(F.count("*").alias("skipped"))
    both = counts.crossJoin(warned)  # one row each
    return both.select("added", (F.col("valid") - F.col("added")).alias("updated"), "skipped")


def rename_links(objects: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """(affected rows (id, version, source_path), all rows with ``[[old]]`` rewritten to ``[[new]]``)."""
    found = F.contains("raw_md", F.lit(f"[[{old}]]"))
    affected = objects.where(found).select("id", "version", "source_path")
    return affected, objects.withColumn("raw_md", F.when(found, F.replace("raw_md", F.lit(f"[[{old}]]"), F.lit(f"[[{new}]]"))).otherwise(F.col("raw_md")))


def soft_delete(rows: DataFrame, trash: DataFrame, paths: DataFrame, trash_id: Column, now: Column, by: str) -> tuple[DataFrame, DataFrame]:
    """(rows without those under ``paths`` (source_path), trash with an entry for each)."""
    going = rows.join(paths.select("source_path").distinct(), "source_path", "left_semi")
    entries = going.select(trash_id.alias("id"), F.col("source_path").alias("original_path"), now.alias("deleted_at"), F.lit(by).alias("deleted_by"), "raw_md")
    return rows.join(paths.select("source_path").distinct(), "source_path", "left_anti"), trash.unionByName(entries, allowMissingColumns=True)


def restore(rows: DataFrame, trash: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(restorable entries, trash that stays): entries whose place is taken again are kept in the trash."""
    asked = trash.join(ids.select("id").distinct(), "id", "left_semi")
    free = asked.join(rows.select(F.col("source_path").alias("original_path")).distinct(), "original_path", "left_anti")
    return free, trash.join(free.select("id"), "id", "left_anti")


def purge(trash: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(trash that stays, entries that are gone for good): those of ``ids`` (id), or all."""
    if ids is None:
        return trash.where("false"), trash
    ids = ids.select("id").distinct()
    return trash.join(ids, "id", "left_anti"), trash.join(ids, "id", "left_semi")


def move_documents(rows: DataFrame, old: str, new: str, overrides: dict[str, str | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(all rows after the move, moved rows that were refused because their place is taken): paths below ``old`` go below ``new``.

    ``overrides`` sets front-matter fields of the documents that move, or removes them (None).
    """
    from ..functions.markdown import rewrite_front_matter

    old, new = old.strip("/") + "/", new.strip("/") + "/"
    going = F.col("source_path").startswith(old)
    target = F.concat(F.lit(new), F.substring("source_path", F.lit(len(old) + 1), F.length("source_path")))
    stay = rows.where(~going)
    moved = rows.where(going).withColumns({"_from": F.col("source_path"), "source_path": target})
    taken = stay.select("source_path").distinct()
    refused = moved.join(taken, "source_path", "left_semi").withColumn("source_path", F.col("_from")).drop("_from")
    done = moved.join(taken, "source_path", "left_anti").drop("_from")
    if overrides:
        done = done.withColumn("raw_md", rewrite_front_matter(F.col("raw_md"), overrides))
    return stay.unionByName(refused).unionByName(done), refused


def edit_document(rows: DataFrame, path: str, raw_md: str) -> DataFrame:
    """Rows with a new text at ``path``; a text with another id than the one there is an error when the result is read."""
    from ..functions.markdown import parse_documents

    new = F.lit(raw_md)
    own = parse_documents(rows.where(F.col("source_path") == path).select("source_path", F.col("id").alias("_id"), new.alias("raw_md")))
    same = F.try_element_at("fields", F.lit("id")).eqNullSafe(F.col("_id"))
    checked = F.when(same, F.col("raw_md")).otherwise(F.raise_error(F.lit(f"the id of {path} cannot change")).cast("string"))
    edited = own.select("source_path", checked.alias("_new"))
    joined = rows.join(edited, "source_path", "left")
    return joined.withColumn("raw_md", F.coalesce("_new", "raw_md")).select(*rows.columns)


def list_trash(trash: DataFrame) -> DataFrame:
    return trash.orderBy(F.desc("deleted_at"), "id")


def unique_names(rows: DataFrame, name: str, order: str, start: int = 2) -> DataFrame:
    """Adds unique_name: the first of each name keeps it, later ones get ``_2``, ``_3`` ... before the extension."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 2)
    return rows.withColumn("_n", n).withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), (F.col("_n") - 2 + start).cast("string"), ext))).drop("_n")


def dedup_images(images: DataFrame) -> DataFrame:
    """(path, name, hash, asset_name): equal contents share one asset; a name that clashes gets its content's number."""
    hashed = images.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.md5("content").alias("hash"))
    first = hashed.groupBy("hash").agg(F.min_by("name", "path").alias("keeps"), F.min("path").alias("first_path"))
    numbered = unique_names(first, "keeps", "first_path").select("hash", F.col("unique_name").alias("asset_name"))
    return hashed.join(numbered, "hash")


def list_directory(paths: DataFrame, folder: str = "") -> DataFrame:
    """(name, is_dir): entries of a folder, folders first, then by name without case; hidden ones are left out."""
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    rest = F.substring("source_path", F.lit(len(prefix) + 1), F.length("source_path"))
    under = paths.where(F.col("source_path").startswith(prefix)) if prefix else paths
    entry = under.select(F.substring_index(rest, "/", 1).alias("name"), F.contains(rest, F.lit("/")).alias("is_dir"))
    return entry.where(~F.col("name").startswith(".") & (F.col("name") != "")).groupBy("name").agg(F.bool_or("is_dir").alias("is_dir")).orderBy(F.desc("is_dir"), F.lower("name"), "name")
