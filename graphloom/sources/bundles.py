"""Zip bundles and document archives: members as rows, imports, exports, navigation trees."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ElementTree
import zipfile
from typing import NamedTuple

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.ids import classify
from ..functions.markdown import parse_documents, rewrite_front_matter
from ..functions.text import unsafe_member
from ..model import REGISTRY
from ..operators.maintenance import import_counts, last_wins, merge_registry
from .archives import read_archives


@udtf(returnType="idx int, name string, content binary")
class unzip:
    """Members of a zip in their order, without folders; names that are not UTF-8 are read as GBK."""

    def eval(self, data: bytes):
        with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
            for i, info in enumerate(z.infolist()):
                if info.is_dir():
                    continue
                name = info.filename
                if not info.flag_bits & 0x800:
                    try:
                        name = name.encode("cp437").decode("gbk")
                    except UnicodeError:
                        pass
                yield i, name, z.read(info)


def members(archives: DataFrame, content: str = "content") -> DataFrame:
    """(archive, idx, name, content) for archives (path, content); an unsafe member stops the job."""
    rows = archives.select(F.col("path").alias("archive"), F.col(content).alias("_zip")).lateralJoin(unzip(F.col("_zip").outer()))
    return safe(rows).select("archive", "idx", "name", "content")


def safe(rows: DataFrame) -> DataFrame:
    """The members (name, ...); one that would leave its folder stops the job."""
    good = F.when(unsafe_member(F.col("name")), F.raise_error(F.concat(F.lit("unsafe archive member: "), F.col("name")))).otherwise(F.lit(True))
    return rows.where(good.cast("boolean"))


def read_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(archive, idx, name, content) of archives of any size: tasks take ranges of an archive, see ``sources.archives``."""
    return safe(read_archives(spark, path, suffixes)).select("archive", "idx", "name", "content")


def markdown_members(rows: DataFrame) -> DataFrame:
    """(idx, source_path, raw_md) of the UTF-8 Markdown members."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return rows.where(F.lower("name").endswith(".md")).select("idx", F.col("name").alias("source_path"), text.alias("raw_md")).where("raw_md is not null")


def extension_types(rows: DataFrame) -> DataFrame:
    """Object types that a bundle brings, in the registry's columns: ``types/<type>.yaml`` holds the type's description.

    A file that is no YAML mapping brings nothing.
    """

    def parse(batches):
        for pdf in batches:
            found = []
            for name, content in zip(pdf["name"], pdf["content"]):
                try:
                    spec = yaml.safe_load(bytes(content).decode()) or {}
                except (yaml.YAMLError, UnicodeDecodeError):
                    continue
                if isinstance(spec, dict):
                    type_ = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                    found.append((type_, spec.get("layer"), spec.get("scope"), spec.get("id_segments"), list(spec.get("path_fields") or []), list(spec.get("frontmatter_required") or [])))
            yield pd.DataFrame(found, columns=["type", "layer", "scope", "id_segments", "path_fields", "frontmatter_required"])

    return rows.where(F.col("name").rlike(r"^types/[^/]+\.yaml$")).select("name", "content").mapInPandas(parse, REGISTRY)


def admit(documents: DataFrame, registry: DataFrame, infer_type: bool = True) -> DataFrame:
    """Parsed documents with their place: adds id, type, path and warning (null where the document is admitted).

    A type that the front matter does not name is taken from the id, unless ``infer_type`` is false.
    """
    parsed = parse_documents(documents)
    id_ = F.try_element_at("fields", F.lit("id"))
    parts = F.split(id_, "@", -1)
    type_ = F.try_element_at("fields", F.lit("type"))
    if infer_type:
        type_ = F.coalesce(type_, F.when(F.size(parts) == 3, parts[1]).when(F.size(parts) == 2, parts[0]))
    typed = parsed.withColumns({"id": id_, "type": type_}).join(F.broadcast(registry), "type", "left")  # one row for each type
    placed = classify(F.col("id"), F.col("scope"), F.col("layer"), F.col("path_fields"), F.col("fields"))
    bad = F.when(F.col("frontmatter_json").isNull(), F.lit("bad front matter")).when(F.col("id").isNull(), F.lit("no id")).when(F.col("type").isNull(), F.lit("no type")).otherwise(placed["warning"])
    return typed.withColumn("warning", bad).withColumn("path", F.when(F.col("warning").isNull(), placed["path"])).drop("id_segments", "path_fields", "frontmatter_required")


class Import(NamedTuple):
    """What an import changes: ``documents`` to write (admitted ones, of each path the last), ``counts`` (added, updated,
    skipped), ``warnings`` (name, warning), and the ``registry`` with the bundle's types."""

    documents: DataFrame
    counts: DataFrame
    warnings: DataFrame
    registry: DataFrame


def import_bundle(rows: DataFrame, registry: DataFrame, existing: DataFrame) -> Import:
    """Imports the members (idx, name, content) of a bundle into a store that holds the paths ``existing`` (path).

    The bundle's types come first, so that its documents may have them. Members that are not UTF-8, not admitted or without id
    or type are skipped with a warning; a path that repeats in the bundle counts as updated, and its last document stays.
    """
    merged, overridden = merge_registry(registry, extension_types(rows))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    documents = rows.where(F.col("name").endswith(".md")).select("idx", F.col("name").alias("source_path"), text.alias("raw_md"))
    admitted = admit(documents, merged, infer_type=False)
    warning = F.when(F.col("raw_md").isNull(), F.lit("not UTF-8")).otherwise(F.col("warning"))
    admitted = admitted.withColumn("warning", warning).withColumn("path", F.when(F.col("warning").isNull(), F.col("path")))
    last = last_wins(admitted.where("warning is null"), ["path"], "idx")
    warned = admitted.where("warning is not null").select(F.col("source_path").alias("name"), "warning")
    return Import(last, import_counts(admitted, existing), overridden.select(F.col("type").alias("name"), "warning").unionByName(warned), merged)


# The folders of the asset tree and the types that may be uploaded to them.
FOLDER_TYPES = {
    "Command": ("MMLCommand",),
    "ConfigObject": ("ConfigObject",),
    "Feature": ("Feature",),
    "License": ("License",),
    "AtomTask": ("AtomTask",),
    "CompoundTask": ("CompoundTask",),
    "FeatureTask": ("FeatureTask",),
    "Business": ("BusinessDomain", "NetworkScenario", "ConfigurationSolution"),
}


def upload(documents: DataFrame, folder: str, registry: DataFrame, existing: DataFrame, overrides: dict[str, str] | None = None) -> Import:
    """Uploads documents (idx, source_path, raw_md) to a folder of the asset tree, each as ``<id>.md``.

    A document whose type belongs to another top folder is skipped with a warning; a top folder without rules takes all types.
    ``overrides`` sets front-matter fields, so that documents agree with their folder.
    """
    allowed = FOLDER_TYPES.get(folder.strip("/").split("/")[0])
    admitted = admit(documents, registry).drop("path")
    unknown = F.when(F.col("layer").isNull() & F.col("type").isNotNull(), F.concat(F.lit("unknown type "), "type"))
    wrong = F.lit(None).cast("string") if allowed is None else F.when(~F.col("type").isin(*allowed), F.concat(F.lit("not the folder of "), "type"))
    # where a document would be filed by its fields does not matter here, only whether it has an id and a known type
    warning = F.when(F.col("warning").isin("bad front matter", "no id", "no type"), F.col("warning")).otherwise(F.coalesce(unknown, wrong))
    admitted = admitted.withColumn("warning", warning)
    top = F.lit(folder.strip("/") + "/" if folder.strip("/") else "")
    admitted = admitted.withColumn("path", F.when(F.col("warning").isNull(), F.concat(top, "id", F.lit(".md"))))
    if overrides:
        admitted = admitted.withColumn("raw_md", rewrite_front_matter(F.col("raw_md"), overrides))
    last = last_wins(admitted.where("warning is null"), ["path"], "idx")
    warned = admitted.where("warning is not null").select(F.col("source_path").alias("name"), "warning")
    return Import(last, import_counts(admitted, existing), warned, registry)


def to_objects(admitted: DataFrame) -> DataFrame:
    """Admitted documents as rows of the object table."""
    field = lambda n: F.try_element_at("fields", F.lit(n))
    parts = F.split("id", "@", -1)
    good = admitted.where("warning is null")
    mtime = F.col("mtime") if "mtime" in admitted.columns else F.lit(None).cast("double")
    return good.select(
        "id", F.when(F.col("scope") == "nf", field("version")).alias("version"), "type", "layer", "scope", F.when(F.size(parts) == 3, parts[0]).alias("nf"),
        field("domain").alias("domain"), field("scenario").alias("scenario"), field("name").alias("name"), field("name_zh").alias("name_zh"),
        "frontmatter_json", "body_md", "raw_md", "source_path", mtime.alias("mtime"),
    )


def to_edges(admitted: DataFrame) -> DataFrame:
    """Edges of the admitted documents' edge sections."""
    from ..functions.text import edge_links

    version = F.when(F.col("scope") == "nf", F.try_element_at("fields", F.lit("version")))
    rows = admitted.where("warning is null").select(F.col("id").alias("from_id"), version.alias("from_version"), F.explode(edge_links(F.col("edge_section"))).alias("e"))
    return rows.select("from_id", "from_version", "e.relation", "e.to_id")


def export_zip(documents: DataFrame, rows_per_zip: int = 5000) -> DataFrame:
    """(part, name, content): zips of (source_path, raw_md), at most ``rows_per_zip`` documents each, in path order."""

    def pack(batches):
        def out(rows, n):
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                for path, text in rows:
                    z.writestr(path, text)
            return pd.DataFrame([(n, f"bundle-{n}.zip", data.getvalue())], columns=["part", "name", "content"])

        held, part, n = [], None, 0
        for pdf in batches:
            for p, path, text in zip(pdf["part"], pdf["source_path"], pdf["raw_md"]):
                part = p
                held.append((path, text or ""))
                if len(held) == rows_per_zip:
                    yield out(held, int(part) * 1_000_000 + n)
                    held, n = [], n + 1
        if held:
            yield out(held, int(part) * 1_000_000 + n)

    ordered = documents.repartitionByRange("source_path").sortWithinPartitions("source_path")
    return ordered.select(F.spark_partition_id().alias("part"), "source_path", "raw_md").mapInPandas(pack, "part long, name string, content binary")


@udtf(returnType="topic_id string, parent_id string, title string, url string, depth int, topic_path array<string>, place int")
class navigation_topics:
    """Topics of a navigation tree in reading order, each with the titles on its way."""

    def eval(self, xml: str):
        root = ElementTree.fromstring(xml)
        stack, place = [(child, None, []) for child in reversed(list(root))], 0
        while stack:
            node, parent, above = stack.pop()
            title = (node.get("txt") or node.get("title") or node.get("name") or "").strip()
            id_ = node.get("id") or f"{parent or 'topic'}-{place}"
            path = [*above, title]
            yield id_, parent, title, node.get("url") or node.get("href"), len(path), path, place
            place += 1
            stack += [(child, id_, path) for child in reversed(list(node))]


def topics(trees: DataFrame, xml: str = "xml") -> DataFrame:
    """Topics of (xml) rows with their number of children."""
    rows = trees.select(xml).lateralJoin(navigation_topics(F.col(xml).outer())).drop(xml)
    counts = rows.groupBy(F.col("parent_id").alias("topic_id")).agg(F.count("*").alias("child_count"))
    return rows.join(counts, "topic_id", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))


def write_topics(found: DataFrame, path: str) -> None:
    """The mapping as JSON and, with the path as one text, as CSV."""
    found.write.mode("overwrite").json(f"{path}/json")
    found.withColumn("topic_path_text", F.array_join("topic_path", " / ")).drop("topic_path").write.mode("overwrite").option("header", True).csv(f"{path}/csv")
