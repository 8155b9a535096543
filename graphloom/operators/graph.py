"""Queries over objects and edges: lists, resolution, neighbours, subgraphs.

``objects`` has a row for each (id, version), ``edges`` (from_id, from_version, relation, to_id); versions may be null. Wide
text columns are read only where a query returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import wikilinks
from ..functions.versions import ver_key
from ..model import types_in_ui_layer


def conditions(
    type: str | None = None,
    layer: str | None = None,
    nf: str | None = None,
    version: str | None = None,
    domain: str | None = None,
    scenario: str | None = None,
    q: str | None = None,
) -> Column:
    """The conjunction of the filters that are given. A type beats a layer; an unknown layer matches nothing."""
    found = F.lit(True)
    if type:
        found = F.col("type") == type
    elif layer:
        found = F.col("type").isin(types_in_ui_layer(layer)) if types_in_ui_layer(layer) else F.lit(False)
    for name, value in (("nf", nf), ("version", version), ("domain", domain), ("scenario", scenario)):
        if value:
            found &= F.col(name) == value
    if q and q.strip():
        found &= matches(q)
    return found


def matches(q: str) -> Column:
    """Case-insensitive substring search in id, name and Chinese name."""
    needle = q.strip().lower()
    return F.greatest(*(F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False)) for c in ("id", "name", "name_zh")))


def newest_per_id(objects: DataFrame) -> DataFrame:
    """The row with the highest version of each id (semantic order; null is lowest)."""
    by_version = Window.partitionBy("id").orderBy(ver_key("version").desc_nulls_last())
    return objects.withColumn("_n", F.row_number().over(by_version)).where("_n = 1").drop("_n")


def versions_per_id(objects: DataFrame) -> DataFrame:
    """(id, versions array in text order)."""
    return objects.groupBy("id").agg(F.array_sort(F.collect_set("version")).alias("versions"))


def latest_versions(objects: DataFrame) -> DataFrame:
    """(id, version): the latest of each id; a null where the id has no versions."""
    return objects.groupBy("id").agg(F.max_by("version", F.coalesce(ver_key("version"), ver_key(F.lit("0")))).alias("version"))


def latest_version_per_nf(objects: DataFrame) -> DataFrame:
    return objects.where("nf is not null and version is not null").groupBy("nf").agg(F.max_by("version", ver_key("version")).alias("version"))


def versions_per_nf(objects: DataFrame) -> DataFrame:
    return objects.where("nf is not null and version is not null").groupBy("nf").agg(F.array_sort(F.collect_set("version")).alias("versions"))


#: Columns that lists leave out.
WIDE = ("raw_md", "body_md", "frontmatter_json")


def list_objects(objects: DataFrame, **filters) -> DataFrame:
    """Newest matching version of each id, with all versions of the id. Filters apply before the newest is chosen.

    One aggregation by id does both; texts are left out.
    """
    found = conditions(**filters)
    columns = [c for c in objects.columns if c != "id" and c not in WIDE]
    newest = F.max_by(F.struct(*columns), F.when(found, F.struct(F.col("version").isNotNull(), ver_key("version"))))
    rows = objects.groupBy("id").agg(newest.alias("_row"), F.array_sort(F.collect_set("version")).alias("versions"), F.bool_or(found).alias("_found"))
    return rows.where("_found").select("id", "_row.*", "versions")


def page(rows: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """One page by (type, id), with ``total`` rows before paging. Pages below 1 are the first."""
    ordered = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row
    return ordered.orderBy(F.coalesce("type", F.lit("")), "id").offset(max(0, number - 1) * size).limit(size)


def point_lookup(objects: DataFrame, id_: str, version: str | None) -> DataFrame:
    return objects.where((F.col("id") == id_) & F.col("version").eqNullSafe(F.lit(version)))


def resolve(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """Resolves (id, version?) requests: the named version, or the latest one.

    Adds status (ok, unknown_id, unknown_version), resolved_version and available_versions (text order, null if unknown).
    """
    known = versions_per_id(objects).join(latest_versions(objects).withColumnRenamed("version", "latest"), "id")
    asked = requests.join(known, "id", "left")
    version = F.coalesce("version", F.lit(""))
    status = (
        F.when(F.col("versions").isNull(), "unknown_id")
        .when((version != "") & ~F.array_contains("versions", version), "unknown_version")
        .otherwise("ok")
    )
    return asked.select(
        "id",
        "version",
        status.alias("status"),
        F.when(status == "ok", F.when(version != "", F.col("version")).otherwise(F.col("latest"))).alias("resolved_version"),
        F.col("versions").alias("available_versions"),
    )


def batch_fetch(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """Documents for ids in request order, each id once: (position, id, version?) in; adds status, resolved version, text."""
    first = requests.groupBy("id").agg(F.min("position").alias("position"), F.min_by("version", "position").alias("version"))
    answered = resolve(objects, first.select("id", "version")).join(first.select("id", "position"), "id")
    text = objects.select("id", F.col("version").alias("resolved_version"), *(c for c in ("raw_md",) if c in objects.columns))
    return answered.join(
        text.withColumnRenamed("id", "_id").withColumnRenamed("resolved_version", "_v"),
        (F.col("id") == F.col("_id")) & F.col("resolved_version").eqNullSafe(F.col("_v")) & (F.col("status") == "ok"),
        "left",
    ).drop("_id", "_v")


def names_map(objects: DataFrame) -> DataFrame:
    """(id, name) by the latest version; the id itself where there is no name."""
    return newest_per_id(objects).select("id", F.coalesce(F.nullif("name", F.lit("")), F.col("id")).alias("name"))


def out_edges(edges: DataFrame, id_: str, version: str | None) -> DataFrame:
    return edges.where((F.col("from_id") == id_) & F.col("from_version").eqNullSafe(F.lit(version)))


def in_edges(edges: DataFrame, id_: str) -> DataFrame:
    """Edges to an id from all versions of all sources."""
    return edges.where(F.col("to_id") == id_)


def neighbors(edges: DataFrame, id_: str, version: str | None) -> DataFrame:
    """Out- and in-edges of a node with their direction."""
    out = out_edges(edges, id_, version).withColumn("dir", F.lit("out"))
    return out.unionByName(in_edges(edges, id_).withColumn("dir", F.lit("in")))


def neighbor_counts(edges: DataFrame) -> DataFrame:
    """(id, n_neighbors): distinct other ids linked to or from each id."""
    both = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).unionByName(
        edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"))
    )
    return both.where("id <> other").distinct().groupBy("id").agg(F.count("*").alias("n_neighbors"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every id on an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def dangling_edges(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to ids that no object has."""
    return edges.join(objects.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_anti")


def has_dangling(objects: DataFrame, edges: DataFrame) -> bool:
    return not dangling_edges(objects, edges).isEmpty()


def subgraph(
    objects: DataFrame, edges: DataFrame, id_: str, version: str | None = None, hops: int = 1, expand_unversioned: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within ``hops`` steps along out-edges; each step goes to the latest version of the target.

    Nodes carry their depth. Edges are all out-edges of the nodes, also where they leave the subgraph. Targets without
    versions are not entered unless ``expand_unversioned``. The loop is bounded by ``hops``; each round joins the frontier
    with the edges and drops what was seen.
    """
    latest = latest_versions(objects)
    center = latest.where(F.col("id") == id_) if version is None else point_lookup(objects, id_, version).select("id", "version")
    seen = center.withColumn("depth", F.lit(0))
    frontier = seen
    targets = latest if expand_unversioned else latest.where("version is not null")
    for depth in range(1, max(0, hops) + 1):
        step = frontier.join(edges, (F.col("id") == F.col("from_id")) & F.col("version").eqNullSafe(F.col("from_version"))).select(F.col("to_id").alias("id")).distinct()
        known = seen.select(F.col("id").alias("_id"), F.col("version").alias("_v"))
        frontier = (
            step.join(targets, "id")
            .join(known, (F.col("id") == F.col("_id")) & F.col("version").eqNullSafe(F.col("_v")), "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = frontier.persist()  # read by the next round, the union and the edges; rebuilt from its parents if lost
        seen = seen.unionByName(frontier)
    node = seen.select(F.col("id").alias("_id"), F.col("version").alias("_v"))
    links = edges.join(node, (F.col("from_id") == F.col("_id")) & F.col("from_version").eqNullSafe(F.col("_v")), "left_semi")
    return seen, links


#: Edges of one node that a task joins; nodes with more, and more than their share if there were HUBS such nodes, are split.
NODE_EDGES, HUBS = 1000, 10_000


def subgraphs(objects: DataFrame, edges: DataFrame, centres: DataFrame, folder: str, hops: int = 1, expand_unversioned: bool = False) -> DataFrame:
    """(centre, id, version, depth): the nodes of ``subgraph`` around every id of ``centres`` (id) at its latest version, in one run.

    The frontier is keyed by centre and node. Every round joins it with the edges, drops what its centre has seen, and is written
    to ``folder``. The edges of a node with very many are dealt out to parts, and the node goes to all of them; such nodes are
    fewer than HUBS, so they are told by broadcast.
    """
    spark = objects.sparkSession
    latest = latest_versions(objects)
    targets = latest if expand_unversioned else latest.where("version is not null")
    degrees = edges.groupBy(F.col("from_id").alias("_h"), F.col("from_version").alias("_hv")).agg(F.count("*").alias("n"))
    most = max(NODE_EDGES, edges.count() // HUBS)
    hubs = degrees.where(F.col("n") > most).select("_h", "_hv", F.ceil(F.col("n") / most).cast("int").alias("_parts"))
    hubs.write.parquet(f"{folder}/hubs")
    hubs = spark.read.schema(hubs.schema).parquet(f"{folder}/hubs")

    def in_parts(rows: DataFrame, id_: str, version: str, part: Column) -> DataFrame:
        marked = rows.join(F.broadcast(hubs), (F.col(id_) == F.col("_h")) & F.col(version).eqNullSafe(F.col("_hv")), "left")
        return marked.withColumn("_part", part).drop("_h", "_hv", "_parts")

    parts = F.coalesce("_parts", F.lit(1))
    own_edges = in_parts(edges.select("from_id", "from_version", "to_id"), "from_id", "from_version", F.pmod(F.xxhash64("to_id"), parts).cast("int"))

    def kept(rows: DataFrame, depth: int) -> DataFrame:
        rows.write.parquet(f"{folder}/depth={depth}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/depth={depth}").withColumn("depth", F.lit(depth))

    start = centres.select("id").distinct().join(latest, "id").select(F.col("id").alias("centre"), "id", "version")
    seen = frontier = kept(start, 0)
    for depth in range(1, max(0, hops) + 1):
        near = in_parts(frontier.select("centre", "id", "version"), "id", "version", F.explode(F.sequence(F.lit(0), parts - 1)))
        joined = near.join(own_edges, (F.col("id") == F.col("from_id")) & F.col("version").eqNullSafe(F.col("from_version")) & (near["_part"] == own_edges["_part"]))
        step = joined.select("centre", F.col("to_id").alias("id")).distinct().join(targets, "id")
        known = seen.select(F.col("centre").alias("_c"), F.col("id").alias("_id"), F.col("version").alias("_v"))
        new = step.join(known, (F.col("centre") == F.col("_c")) & (F.col("id") == F.col("_id")) & F.col("version").eqNullSafe(F.col("_v")), "left_anti")
        frontier = kept(new.select("centre", "id", "version"), depth)
        seen = seen.unionByName(frontier)
    return seen


def link_edges(objects: DataFrame) -> DataFrame:
    """(from_id, from_version, relation, to_id) of the ``[[id]]`` links in the documents' texts, wherever they stand."""
    rows = objects.select(F.col("id").alias("from_id"), F.col("version").alias("from_version"), F.explode(wikilinks(F.col("raw_md"))).alias("to_id"))
    return rows.select("from_id", "from_version", F.lit("link").alias("relation"), "to_id")


def drawing(edges: DataFrame, id_: str, version: str | None) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, is_center), links (from_id, relation, to_id)) of a node and its neighbours, each once."""
    links = neighbors(edges, id_, version).select("from_id", "relation", "to_id").dropDuplicates()
    nodes = links.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return nodes.select("id", (F.col("id") == id_).alias("is_center")), links


def pages_so_far(rows: DataFrame, number: int, size: int = 50) -> DataFrame:
    """The first ``number`` pages together, in the order of ``page``; an id that repeats is listed once, at its first place."""
    first = rows.dropDuplicates(["id"])
    return first.orderBy(F.coalesce("type", F.lit("")), "id").limit(max(0, number) * size)


def navigation_version(targets: DataFrame) -> DataFrame:
    """Which version a link opens: the forced one, else that of the page it is on, else the last listed, where they exist.

    In: (id, forced, current, versions array). Adds ``opens``.
    """
    has = lambda c: F.array_contains("versions", F.col(c))
    return targets.withColumn(
        "opens", F.when(has("forced"), F.col("forced")).when(has("current"), F.col("current")).otherwise(F.try_element_at("versions", F.lit(-1)))
    )


def slice_paths(objects: DataFrame, nf: str | None = None, version: str | None = None, domain: str | None = None, scenario: str | None = None) -> DataFrame:
    """Objects whose path has the given segments: ``layer/nf/version/...`` or ``layer/domain/scenario/...``."""
    parts = F.split("source_path", "/", -1)
    found = F.lit(True)
    for at, value in ((1, nf), (2, version), (1, domain), (2, scenario)):
        if value:
            found &= F.coalesce(parts[at] == value, F.lit(False))
    if domain or scenario:
        found &= parts[0] == "Business"
    return objects.where(found)


def under_prefixes(objects: DataFrame, prefixes: list[str]) -> DataFrame:
    """Objects under any of the folders; empty prefixes are ignored, none means nothing."""
    found = F.lit(False)
    for prefix in prefixes:
        if prefix.strip("/"):
            found |= F.col("source_path").startswith(prefix.strip("/") + "/")
    return objects.where(found)
