"""Files as DataFrames: Markdown trees, images, previews, directories, page archives."""

from __future__ import annotations

import fnmatch
import posixpath
import re

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import CharsetModel, decoder
from .archives import opened

# Suffixes that may be shown.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "gif", "webp", "bmp")
TEXT_SUFFIXES = ("md", "txt", "json", "yaml", "yml", "csv", "log", "xml", "html", "htm")


def relative_path(root: str, path: Column | None = None) -> Column:
    """Path below ``root``; file paths arrive URL-encoded and with a scheme."""
    path = F.col("_metadata.file_path") if path is None else path
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    bare = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    return F.element_at(F.split(plain, F.concat(F.lit(r"\Q"), F.lit(bare), F.lit(r"\E")), 2), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def read_markdown(spark: SparkSession, *roots: str) -> DataFrame:
    """(source_path, raw_md, mtime) of all Markdown files below the folders, each file once, hidden ones left out."""
    found = None
    for root in roots:
        rows = read_texts(spark, root, "*.md").select(F.col("path").alias("source_path"), F.col("text").alias("raw_md"), "mtime", F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("_file"))
        found = rows if found is None else found.unionByName(rows)
    found = found.dropDuplicates(["_file"]) if len(roots) > 1 else found
    return found.drop("_file").where(~is_hidden(F.col("source_path")))


def read_one(spark: SparkSession, root: str, path: str) -> DataFrame:
    return spark.read.text(f"{root.rstrip('/')}/{path}", wholetext=True).select(F.lit(path).alias("source_path"), F.col("value").alias("raw_md"))


def read_images(spark: SparkSession, root: str, product_documents: bool = False) -> DataFrame:
    """(path, content) of images. Drawings (svg) may hold code, and are read from product documents only."""
    return read_binary(spark, root, (*IMAGE_SUFFIXES, "svg") if product_documents else IMAGE_SUFFIXES)


def named(suffixes: tuple[str, ...]) -> str:
    """A pattern of file names with one of the suffixes in any case, for the listing: other files are not opened."""
    either = lambda c: f"[{c.lower()}{c.upper()}]" if c.lower() != c.upper() else c
    return "*.{" + ",".join("".join(map(either, s)) for s in suffixes) + "}"


def _hidden(name: str) -> bool:
    """Whether Spark passes over a file or folder of this name."""
    return (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")) and not name.startswith(("_metadata", "_common_metadata"))


def _inside(system: fs.FileSystem, folder: str) -> tuple[list[str], list[fs.FileInfo]]:
    """The folders and the files in a folder; hidden ones are left out."""
    found = [x for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if not _hidden(x.base_name)]
    return [x.path for x in found if x.type == fs.FileType.Directory], [x for x in found if x.is_file]


def _tasks(spark: SparkSession) -> int:
    """Tasks of a step that opens files: how long one takes differs, so there are more than run at once."""
    return max(16, 4 * spark.sparkContext.defaultParallelism)


def _patterns(pattern: str) -> list[str]:
    """A pattern of names with alternatives in braces, as patterns without."""
    alternatives = re.fullmatch(r"(.*?)\{(.*)\}(.*)", pattern)
    return [alternatives[1] + x + alternatives[3] for x in alternatives[2].split(",")] if alternatives else [pattern]


#: Folders that are enough to deal out, and rows of a batch.
FOLDERS, LISTED = 1024, 5000


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size, mtime) of all files that hold a byte; no contents are read.

    Tasks list the folders: one goes down until there are enough folders to deal out, then each of the others takes its folders
    with all that is below. Nothing of it passes through the driver.
    """
    place = opened(root)[1].rstrip("/")
    names = [re.compile(fnmatch.translate(p)) for p in _patterns(pattern)]

    def folders(_):
        system, queue, above = opened(root)[0], [place], []
        while queue and len(queue) < FOLDERS:
            below = []
            for folder in queue:
                below += _inside(system, folder)[0]
            above += queue
            queue = below
        rows = [(x, False) for x in above] + [(x, True) for x in queue]
        for at in range(0, len(rows), LISTED):
            yield pd.DataFrame(rows[at : at + LISTED], columns=["folder", "deep"])

    def listed(batches):
        system, held = opened(root)[0], []
        for pdf in batches:
            for top, deep in zip(pdf["folder"], pdf["deep"]):
                stack = [top]
                while stack:
                    below, found = _inside(system, stack.pop())
                    stack += below if deep else ()
                    held += [(posixpath.relpath(x.path, place), x.size, x.mtime_ns // 1_000_000 / 1000) for x in found if x.size and any(n.match(x.base_name) for n in names)]
                    while len(held) >= LISTED:
                        yield pd.DataFrame(held[:LISTED], columns=["path", "size", "mtime"])
                        held = held[LISTED:]
        yield pd.DataFrame(held, columns=["path", "size", "mtime"])

    dealt = spark.range(1).repartition(1).mapInPandas(folders, "folder string, deep boolean").repartition(_tasks(spark), F.xxhash64("folder"))
    return dealt.mapInPandas(listed, "path string, size long, mtime double")


def read_binary(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """(path, content) of files with the given suffixes."""
    return _contents(spark, root, named(suffixes)).select("path", "content")


def read_texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, text, mtime) of files whose names fit."""
    return _contents(spark, root, pattern).select("path", F.col("content").cast("string").alias("text"), "mtime")


def _contents(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, content, mtime) of files whose names fit."""
    return read_files(listing(spark, root, pattern).select("path", "mtime"), root)


def read_files(chosen: DataFrame, root: str) -> DataFrame:
    """``read_chosen`` of the files that are there, dealt out anew: a large folder is read by many tasks."""
    return read_chosen(chosen.repartition(_tasks(chosen.sparkSession), F.xxhash64("path")), root).where("content is not null")


#: Bytes of the contents that go on at once.
BATCH_BYTES = 16 << 20


def read_chosen(chosen: DataFrame, root: str) -> DataFrame:
    """(path, content, ...) of the files below ``root`` that ``chosen`` (path, ...) names, opened by the tasks that hold the rows.

    The content of a file that is not there is null. Other columns pass through.
    """

    def read(batches):
        system, place = opened(root)
        for pdf in batches:
            contents, start, total = [], 0, 0
            for at, path in enumerate(pdf["path"]):
                try:
                    with system.open_input_stream(f"{place.rstrip('/')}/{path}") as file:
                        contents.append(file.read())
                        total += len(contents[-1])
                except FileNotFoundError:
                    contents.append(None)
                if total >= BATCH_BYTES:
                    yield pdf.iloc[start : at + 1].assign(content=contents)[names]
                    contents, start, total = [], at + 1, 0
            yield pdf.iloc[start:].assign(content=contents)[names]

    rest = [f for f in chosen.schema if f.name not in ("path", "content")]
    names = ["path", "content", *(f.name for f in rest)]
    schema = ", ".join(["path string", "content binary", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)])
    return chosen.mapInPandas(read, schema)


def read_preview(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of files that can be shown as text."""
    return read_texts(spark, root, named(TEXT_SUFFIXES)).select("path", "text")


def read_pages(spark: SparkSession, root: str, model: CharsetModel | None = None) -> DataFrame:
    """(path, text, charset) of all HTML files, decoded by their own character sets; ``model`` judges pages that do not state theirs."""
    return read_binary(spark, root, ("html", "htm")).withColumn("_d", decoder(model)("content")).select("path", "_d.text", "_d.charset")


def file_times(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(source_path, mtime): no contents are read."""
    return listing(spark, root, pattern).select(F.col("path").alias("source_path"), "mtime")
