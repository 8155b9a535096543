"""Logs, users, review folders, bundle lists, and the stored tables."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import problems
from ..model import EDGES, OBJECTS
from . import storage
from .files import listing, read_texts

#: Where edges lie whose node is not there.
NO_LAYER = "none"


def read_telemetry_log(spark: SparkSession, path: str, level: str) -> DataFrame:
    """A JSON-lines log: blank and bad lines are dropped, ``id`` and ``type`` are the object's, the file's level is the default."""
    schema = "ts string, level string, caller string, endpoint string, id string, type string, obj_id string, obj_type string, user string, operator string"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("ts is not null")
    return rows.select(
        "ts", F.coalesce("level", F.lit(level)).alias("level"), "caller", "endpoint", F.coalesce("obj_id", "id").alias("obj_id"), F.coalesce("obj_type", "type").alias("obj_type"), "user", "operator"
    )


def with_sequence(log: DataFrame, folder: str, after: int = 0) -> DataFrame:
    """Adds seq: consecutive numbers from ``after`` + 1 in the order of time, over all partitions.

    The sorted log is written to ``folder`` first, so that numbers stay the same however often they are read.
    """
    spark = log.sparkSession
    log.repartitionByRange("ts", *(F.xxhash64(c) for c in log.columns if c != "ts")).withColumn("_part", F.spark_partition_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n"))
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("ts", *(c for c in log.columns if c != "ts")))
    numbered = rows.join(F.broadcast(starts), "_part").withColumn("seq", (F.col("_start") + within + after).cast("long"))  # a row for each partition
    return numbered.drop("_part", "_start")


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """Users of a ``{"users": [...]}`` file; a missing assets flag is the administrator's."""
    user = "struct<username:string,key:string,is_admin:boolean,can_frontend:boolean,can_skill:boolean,can_upload:boolean,can_assets:boolean,can_test:boolean,created_at:string>"
    rows = spark.read.schema(f"users array<{user}>").option("multiLine", True).json(path).select(F.inline("users"))
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("is_admin", "can_frontend", "can_skill", "can_upload", "can_test")}
    return rows.withColumns(flags).withColumn("can_assets", F.coalesce("can_assets", "is_admin"))


def read_bundles(spark: SparkSession, root: str) -> DataFrame:
    """(name, nf, version, status) of bundle folders by their ``bundle.json``; folders without one count as done."""
    names = listing(spark, root).where(F.contains("path", F.lit("/"))).select(F.substring_index("path", "/", 1).alias("name")).distinct()
    described = read_texts(spark, root, "bundle.json").select("path", F.from_json("text", "nf string, version string, status string").alias("m"))
    meta = described.where(F.col("path").rlike("^[^/]+/bundle\\.json$")).select(F.substring_index("path", "/", 1).alias("name"), "m")
    return names.join(meta, "name", "left").select("name", "m.nf", "m.version", F.coalesce("m.status", F.lit("done")).alias("status"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Build manifests (source_path, manifest as map); a bad file has an empty map."""
    rows = read_texts(spark, path, "*.json")
    parsed = F.from_json("text", "map<string,string>")
    return rows.select(F.col("path").alias("source_path"), F.coalesce(parsed, F.create_map().cast("map<string,string>")).alias("manifest"))


def read_external_links(spark: SparkSession, path: str) -> DataFrame:
    """(name, refs array<string>) of a JSON object of lists."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("name", "refs"))
    return rows


def read_review_tree(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Cases, runs, reviews and artifacts of a folder; names of folders and files tell what they are.

    ``cases/<domain>/<scenario>/TestCase@<x>/`` is a case, ``runs/<case>/Run@<y>/`` a run, ``reviews/*.md`` in it a review. The
    documents of a case and a run have their folder's name and may be missing; all other files of a case are its ``files``,
    those of a run its artifacts. Only Markdown files are opened; of the others the listing tells path and size. A case straight below ``cases`` has the domain 未分类. Spark passes over files without a byte.
    """
    from ..functions.markdown import parse_documents

    texts = read_texts(spark, root, "*.md").select("path", F.col("text").alias("raw_md"))
    rows = listing(spark, root)
    pick = lambda pattern, *names: [F.regexp_extract("path", pattern, n + 1).alias(name) for n, name in enumerate(names)]
    in_case, in_run = r"^cases/(.*?)(TestCase@[^/]+)/(.+)$", r"^runs/([^/]+)/(Run@[^/]+)/(.+)$"
    of_cases = rows.where(F.col("path").rlike(in_case)).select(*pick(in_case, "above", "id", "rest"))
    of_runs = rows.where(F.col("path").rlike(in_run)).select("size", *pick(in_run, "case_id", "id", "rest"))
    case_texts = texts.where(F.col("path").rlike(in_case)).select("raw_md", *pick(in_case, "above", "id", "rest"))
    run_texts = texts.where(F.col("path").rlike(in_run)).select("raw_md", *pick(in_run, "case_id", "id", "rest"))
    own = F.col("rest") == F.concat("id", F.lit(".md"))
    is_review = F.col("rest").rlike(r"^reviews/[^/]+\.md$")
    field = lambda n: F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit(""))

    cases = of_cases.groupBy("id", "above").agg(F.array_sort(F.collect_list(F.when(~own, F.col("rest")))).alias("files"))
    told = parse_documents(case_texts.where(own).select("id", "above", "raw_md"))
    heading = F.trim(F.regexp_extract("body_md", r"(?m)^\s*#\s+(.+?)\s*$", 1))
    told = told.select("id", "above", F.coalesce(F.nullif(field("name"), F.lit("")), F.nullif(heading, F.lit(""))).alias("name"))
    folders = F.filter(F.split("above", "/", -1), lambda x: x != "")
    part = lambda n, missing: F.coalesce(F.try_element_at(folders, F.lit(n)), F.lit(missing))
    cases = cases.join(told, ["id", "above"], "left").select(
        "id", part(1, "未分类").alias("domain"), part(2, "").alias("scenario"), F.coalesce("name", "id").alias("name"), "files", F.concat(F.lit("cases/"), "above", "id").alias("source_path")
    )
    runs = of_runs.select("id", "case_id").distinct()
    told = parse_documents(run_texts.where(own).select("id", "case_id", "raw_md")).select("id", "case_id", *(field(n).alias(n) for n in ("name", "runner", "run_at", "status")))
    runs = runs.join(told, ["id", "case_id"], "left").na.fill("", ["name", "runner", "run_at", "status"])
    title = F.when(F.col("name") != "", F.col("name")).otherwise(F.trim(F.concat(F.lit("Run "), "run_at")))
    reviews = parse_documents(run_texts.where(is_review).select(F.regexp_extract("rest", r"([^/]+)\.md$", 1).alias("id"), F.col("id").alias("run_id"), "raw_md"))
    return {
        "cases": cases,
        "runs": runs.select("id", "case_id", title.alias("name"), "runner", "run_at", "status", F.concat_ws("/", F.lit("runs"), "case_id", "id").alias("source_path")),
        "reviews": reviews.select("id", "run_id", field("reviewer").alias("reviewer"), field("reviewed_at").alias("reviewed_at"), field("verdict").alias("verdict"), problems(F.col("body_md")).alias("problems")),
        "artifacts": of_runs.where(~own & ~F.col("rest").startswith("reviews/")).select(F.col("id").alias("run_id"), F.col("rest").alias("path"), "size"),
    }


class Store:
    """The object and edge tables as Parquet in slices, by layer and by a hash of the id.

    A write puts only the slices that it changes into a new folder, then appends a version that says where every slice lies.
    Readers of an earlier version are not disturbed, and a failed write leaves the current one as it was. Edges lie in the
    slice of the node that they start from. ``clean`` deletes folders that no recent version needs.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _versions(self) -> DataFrame:
        schema = "version int, layer string, bucket int, folder string"
        path = f"{self.root}/versions"
        return self.spark.read.schema(schema).parquet(path) if storage.exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def current(self) -> int:
        return self._versions().agg(F.max("version")).first()[0] or 0

    def _slices(self) -> dict[tuple[str, int], str]:
        """Folder of every slice of the current version: at most layers times buckets."""
        n = self.current()
        return {(x["layer"], x["bucket"]): x["folder"] for x in self._versions().where(F.col("version") == n).collect() if x["folder"]}

    def _read(self, table: str, schema: StructType, slices: dict[tuple[str, int], str]) -> DataFrame:
        found = self.spark.createDataFrame([], schema)
        own = StructType([*(f for f in schema if f.name != "layer"), StructField("layer", StringType()), StructField("bucket", IntegerType())])
        for folder in sorted(set(slices.values())):
            layers: dict[str, list[int]] = {}
            for (layer, bucket), place in slices.items():
                if place == folder:
                    layers.setdefault(layer, []).append(bucket)
            live = reduce(or_, ((F.col("layer") == layer) & F.col("bucket").isin(*some) for layer, some in layers.items()))
            path = f"{self.root}/{folder}/{table}"
            if storage.exists(self.spark, path):
                found = found.unionByName(self.spark.read.schema(own).parquet(path).where(live).select(*schema.names))
        return found

    def objects(self) -> DataFrame:
        return self._read("objects", OBJECTS, self._slices())

    def edges(self) -> DataFrame:
        return self._read("edges", EDGES, self._slices())

    def _bucket(self, id_: str) -> F.Column:
        return F.pmod(F.xxhash64(id_), F.lit(self.buckets)).cast("int")

    def _write(self, objects: DataFrame, edges: DataFrame, kept: dict[tuple[str, int], str]) -> int:
        n = self.current() + 1
        folder = f"v{n}-{uuid.uuid4().hex[:8]}"
        rows = objects.select(*OBJECTS.names).withColumn("bucket", self._bucket("id"))
        rows.repartition("layer", "bucket").write.partitionBy("layer", "bucket").parquet(f"{self.root}/{folder}/objects")
        written = self.spark.read.schema("id string, layer string, bucket int").parquet(f"{self.root}/{folder}/objects")
        layers = written.groupBy(F.col("id").alias("from_id")).agg(F.min("layer").alias("layer"))
        placed = edges.select(*EDGES.names).join(layers, "from_id", "left").withColumns({"layer": F.coalesce("layer", F.lit(NO_LAYER)), "bucket": self._bucket("from_id")})
        placed.repartition("layer", "bucket").write.partitionBy("layer", "bucket").parquet(f"{self.root}/{folder}/edges")
        ends = self.spark.read.schema("from_id string, layer string, bucket int").parquet(f"{self.root}/{folder}/edges")
        new = written.select("layer", "bucket").union(ends.select("layer", "bucket")).distinct().collect()  # the slices of this version
        slices = kept | {(x["layer"], x["bucket"]): folder for x in new}
        rows = [(n, layer, bucket, place) for (layer, bucket), place in slices.items()] or [(n, None, None, None)]
        self.spark.createDataFrame(rows, "version int, layer string, bucket int, folder string").coalesce(1).write.mode("append").parquet(f"{self.root}/versions")
        return n

    def replace(self, objects: DataFrame, edges: DataFrame) -> int:
        """Writes all slices anew."""
        return self._write(objects, edges, {})

    def _touched(self, ids: DataFrame) -> tuple[dict[tuple[str, int], str], dict[tuple[str, int], str]]:
        """(slices that the ids' buckets lie in, the others)."""
        buckets = {x[0] for x in ids.select(self._bucket("id")).distinct().collect()}  # at most ``buckets`` rows
        slices = self._slices()
        mine = {k: v for k, v in slices.items() if k[1] in buckets}
        return mine, {k: v for k, v in slices.items() if k not in mine}

    def _holding(self, slices: dict[tuple[str, int], str], keys: DataFrame, layers: DataFrame) -> dict[tuple[str, int], str]:
        """Those of ``slices`` whose layer is in ``layers`` (layer), or that hold rows of ``keys`` (id)."""
        own = self._read("objects", OBJECTS, slices).select("id", "layer").join(keys.select("id").distinct(), "id", "left_semi")
        names = {x[0] for x in own.select("layer").distinct().union(layers.select("layer").distinct()).collect()} | {NO_LAYER}  # a few layers
        return {k: v for k, v in slices.items() if k[0] in names}

    def merge(self, objects: DataFrame, edges: DataFrame) -> int:
        """Upserts the objects and replaces the edges of their nodes; other layers and buckets stay as they are."""
        from ..operators.maintenance import replace_edges, upsert

        near, far = self._touched(objects.select("id").union(edges.select("from_id")))
        mine = self._holding(near, objects, objects)
        far |= {k: v for k, v in near.items() if k not in mine}
        old, old_edges = self._read("objects", OBJECTS, mine), self._read("edges", EDGES, mine)
        return self._write(upsert(old, objects), replace_edges(old_edges, objects.select("id", "version"), edges), far)

    def remove(self, paths: DataFrame) -> int:
        """Removes the objects of source paths with their edges."""
        from ..operators.maintenance import delete_by_path, replace_edges

        gone = self.objects().join(paths.select("source_path").distinct(), "source_path", "left_semi").select("id", "layer")
        near, far = self._touched(gone)
        mine = self._holding(near, gone, gone)
        far |= {k: v for k, v in near.items() if k not in mine}
        kept, keys = delete_by_path(self._read("objects", OBJECTS, mine), paths)
        return self._write(kept, replace_edges(self._read("edges", EDGES, mine), keys, self.spark.createDataFrame([], EDGES)), far)

    def rebuild(self, admitted: DataFrame) -> DataFrame:
        """Replaces everything by the admitted documents (see ``bundles.admit``); returns (objects, edges, skipped), one row.

        Of documents with one id and version the last by path stays.
        """
        from ..operators.maintenance import last_wins
        from .bundles import to_edges, to_objects

        good = admitted.where("warning is null").withColumn("_v", F.try_element_at("fields", F.lit("version")))
        good = last_wins(good, ["id", "_v"], "source_path").drop("_v")
        self.replace(to_objects(good), to_edges(good).distinct())
        skipped = admitted.where("warning is not null").agg(F.count("*").alias("skipped"))
        counts = self.objects().agg(F.count("*").alias("objects")).crossJoin(self.edges().agg(F.count("*").alias("edges")))
        return counts.crossJoin(skipped)  # one row each

    def clean(self, keep: int = 2) -> list[str]:
        """Deletes the folders that none of the last ``keep`` versions uses; returns their names."""
        n = self.current()
        used = {x[0] for x in self._versions().where(F.col("version") > n - keep).select("folder").distinct().collect()}
        gone = [x for x in storage.entries(self.spark, self.root) if x.startswith("v") and x != "versions" and x not in used]
        for name in gone:
            storage.delete(self.spark, f"{self.root}/{name}")
        return gone


class ReviewStore:
    """Cases, runs, reviews with their problems, and artifacts as Parquet; every write replaces all of them at once."""

    NAMES = ("cases", "runs", "reviews", "artifacts")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def replace(self, tables: dict[str, DataFrame]) -> DataFrame:
        """Writes the tables to a new folder, which then is the current one; returns the runs whose case is not there, which stay."""
        from ..operators.reviews import orphan_runs

        folder = f"{self.root}/v-{uuid.uuid4().hex}"
        for name in self.NAMES:
            tables[name].write.parquet(f"{folder}/{name}")
        storage.write_text(self.spark, f"{self.root}/current", folder)
        found = self.load()
        return orphan_runs(found["cases"], found["runs"])

    def load(self) -> dict[str, DataFrame]:
        folder = self.spark.read.text(f"{self.root}/current", wholetext=True).first()[0]
        return {name: self.spark.read.parquet(f"{folder}/{name}") for name in self.NAMES}
