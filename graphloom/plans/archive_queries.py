"""Queries over archives and files that the executors write from whole tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import archives, bundles, files, runs
from . import fixtures as X
from .registry import query, scratch


def _document_members(spark, sf):
    """(name, content): a Markdown file for each document, and one of another kind for every third."""
    docs = X.read(spark, sf, "documents")
    body = docs.select(F.concat(F.lit("docs/"), F.coalesce("lang", F.lit("none")), F.lit("/"), "doc_id", F.lit(".md")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    other = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("docs/图 "), "doc_id", F.lit(".PNG")).alias("name"), F.concat(F.lit("png"), "doc_id").cast("binary").alias("content"))
    return body.unionByName(other)


_MEMBERS = """SELECT 'docs/' || coalesce(lang, 'none') || '/' || doc_id || '.md' AS name, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'docs/图 ' || doc_id || '.PNG', 'png' || doc_id FROM documents WHERE doc_id % 3 = 0"""


@query(f"SELECT name, strlen(text)::BIGINT AS size, md5(text) AS digest FROM ({_MEMBERS})")
def archive_members(spark, sf):
    """Archives of all documents, written in several tasks and inflated by ranges."""
    root = scratch(spark, "archives")
    archives.write_archives(X.dealt(_document_members(spark, sf), "name"), root, 3000)
    rows = bundles.read_members(spark, root)
    return rows.select("name", F.length("content").cast("long").alias("size"), F.md5("content").alias("digest"))


@query(f"SELECT name, strlen(text)::BIGINT AS size, true AS unread FROM ({_MEMBERS}) WHERE name LIKE '%.PNG'")
def archive_listing(spark, sf):
    """What the directories say of the images; nothing is inflated."""
    root = scratch(spark, "archives")
    archives.write_archives(X.dealt(_document_members(spark, sf), "name"), root)
    rows = bundles.safe(archives.read_archives(spark, root, (".png",), contents=False))
    return rows.select("name", "size", F.col("content").isNull().alias("unread"))


@query("""SELECT 'Img/' || p_partkey % 7 || '/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.txt' WHEN 2 THEN '.svg' ELSE '.json' END AS path, strlen(p_name)::BIGINT AS size,
  CASE WHEN p_partkey % 4 = 0 THEN 'image' WHEN p_partkey % 4 IN (1, 3) THEN 'text' ELSE 'none' END AS opened, CASE WHEN p_partkey % 4 <> 2 THEN p_name END AS text FROM part""")
def chosen_files(spark, sf):
    """A file for each part: a listing of all, and the contents of images and texts only."""
    root = scratch(spark, "files")
    key = F.col("p_partkey")
    end = F.when(key % 4 == 0, ".PNG").when(key % 4 == 1, ".txt").when(key % 4 == 2, ".svg").otherwise(".json")
    part = X.read(spark, sf, "part").select(F.concat(F.lit("Img/"), key % 7, F.lit("/"), key, end).alias("path"), F.col("p_name").cast("binary").alias("content"))
    archives.write_files(part, root)
    images = files.read_images(spark, root).select("path", F.lit("image").alias("opened"), F.col("content").cast("string").alias("text"))
    texts = files.read_preview(spark, root).select("path", F.lit("text").alias("opened"), "text")
    chosen = images.unionByName(texts)
    return files.listing(spark, root).select("path", "size").join(chosen, "path", "left").na.fill("none", ["opened"]).select("path", "size", "opened", "text")


@query("""SELECT 'Run@' || conv_id AS archive, 't' || turn || '.txt' AS name, md5(coalesce(text, '')) AS digest FROM conversations WHERE conv_id % 10 <> 3
  UNION ALL SELECT DISTINCT 'Run@' || conv_id, 'Run@' || conv_id || '.md', md5(CASE WHEN conv_id % 4 = 0 THEN 'own card' ELSE '---' || chr(10) || 'id: Run@' || conv_id || chr(10) || 'type: Run' || chr(10) || 'case: TestCase@' || conv_id % 10 || chr(10) ||
    'run_at: 2026-01-01T00:00' || chr(10) || 'runner: ' || CASE WHEN conv_id % 3 = 0 THEN 'ann' ELSE 'upload' END || chr(10) || 'status: ' || CASE WHEN conv_id % 5 = 2 THEN 'failed' ELSE 'completed' END || chr(10) ||
    CASE WHEN conv_id % 2 = 1 THEN 'name: run ' || conv_id || chr(10) ELSE '' END || '---' || chr(10) || '# ' || CASE WHEN conv_id % 2 = 1 THEN 'run ' || conv_id ELSE 'Run@' || conv_id END || chr(10) END) FROM conversations WHERE conv_id % 10 <> 3""")
def run_archives(spark, sf):
    """Every conversation is a run: packed, uploaded (some cases are unknown, some members unsafe), some cards edited, packed again."""
    turns, conv = X.read(spark, sf, "conversations"), F.col("conv_id")
    run = F.concat(F.lit("Run@"), conv)
    text = turns.select(conv, F.concat(F.lit("t"), "turn", F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    once = turns.select(conv).distinct()
    cards = once.where(conv % 4 == 0).select(conv, F.concat(run, F.lit(".md")).alias("name"), F.lit("own card").cast("binary").alias("content"))
    unsafe = once.where(conv % 6 == 0).select(conv, F.lit("../out.txt").alias("name"), F.lit("x").cast("binary").alias("content"))
    packed = text.unionByName(cards).unionByName(unsafe).select(F.concat(F.lit("up"), conv).alias("archive"), "name", "content")
    uploaded, root, target = (scratch(spark, name) for name in ("uploaded", "runs", "packed"))
    archives.write_named_archives(X.dealt(packed, "archive").sortWithinPartitions("archive", "name"), uploaded)
    uploads = once.select(F.concat(F.lit("up"), conv, F.lit(".zip")).alias("archive"), F.concat(F.lit("TestCase@"), conv % 10).alias("case"), run.alias("id"), F.when(conv % 2 == 1, F.concat(F.lit("run "), conv)).alias("name"), F.when(conv % 3 == 0, "ann").otherwise("").alias("runner"))
    cases = spark.range(10).where("id <> 3").select(F.concat(F.lit("TestCase@"), "id").alias("id"))
    runs.upload_runs(spark, uploaded, uploads, cases, root, "2026-01-01T00:00")
    nothing = F.lit(None).cast("string")
    edited = uploads.where((conv_of := F.regexp_extract("id", r"(\d+)", 1).cast("long")) % 5 == 2).where(conv_of % 4 != 0).join(cases.withColumnRenamed("id", "case"), "case", "left_semi")
    runs.update_runs(spark, root, edited.select("case", "id", *(nothing.alias(c) for c in ("name", "runner", "run_at", "notes")), F.lit("failed").alias("status")))
    runs.download_runs(spark, root, target)
    found = archives.read_archives(spark, target)
    return found.select(F.regexp_extract("archive", r"([^/]+)\.zip$", 1).alias("archive"), "name", F.md5("content").alias("digest"))
