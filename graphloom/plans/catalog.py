"""The registered queries: a callable on Spark, and SQL for a second engine where it can say the same."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encoding, html, ids, markdown, text
from ..functions.versions import ver_key
from ..operators import access, graph, maintenance, mining, reviews, search, stats, telemetry
from . import fixtures as X
from . import archive_queries, mining_queries, page_queries, source_queries, stream_queries  # noqa: F401  they register themselves
from .registry import Query, found_queries, found_sql, query, scratch

def _joined(column: str) -> F.Column:
    return F.array_join(column, ",").alias(column)


VERSIONS = "vtext"
FIRST_VERSION = "(SELECT min(version) FROM cmd WHERE nf = 'NF1')"
LIST_COLUMNS = ["id", "type", "layer", "nf", "version", "domain", "scenario", "name", "versions"]


def _list(df: DataFrame) -> DataFrame:
    return df.select(*LIST_COLUMNS[:-1], _joined("versions"))


def _list_sql(where: str) -> str:
    return f"""SELECT id, type, layer, nf, version, domain, scenario, name, {VERSIONS} AS versions FROM
    (SELECT *, row_number() OVER (PARTITION BY id ORDER BY vk DESC NULLS LAST) AS n FROM objects WHERE {where}) JOIN vers USING (id) WHERE n = 1"""


# lists, resolution, names


@query(_list_sql("true"))
def list_objects_latest(spark, sf):
    return _list(graph.list_objects(X.objects(spark, sf)))


def _first_version(spark, sf):
    return X.commands(spark, sf).where("nf = 'NF1'").agg(F.min("version")).first()[0]


@query(_list_sql(f"nf = 'NF1' AND version = {FIRST_VERSION}"))
def list_objects_version_filter(spark, sf):
    return _list(graph.list_objects(X.objects(spark, sf), nf="NF1", version=_first_version(spark, sf)))


@query(_list_sql("contains(lower(id), 'ring') OR contains(lower(name), 'ring') OR contains(lower(name_zh), 'ring')"))
def list_objects_search(spark, sf):
    return _list(graph.list_objects(X.objects(spark, sf), q=" Ring "))


@query("SELECT id, type, total FROM (SELECT id, type, count(*) OVER () AS total FROM newest) ORDER BY coalesce(type, ''), id LIMIT 50 OFFSET 50")
def list_objects_page_total(spark, sf):
    return graph.page(graph.newest_per_id(X.objects(spark, sf)), 2, 50).select("id", "type", "total")


@query(_list_sql("type IN ('MMLCommand', 'ConfigObject')"))
def objects_by_layer(spark, sf):
    return _list(graph.list_objects(X.objects(spark, sf), layer="命令层"))


@query(_list_sql("type = 'Feature'"))
def objects_by_type(spark, sf):
    return _list(graph.list_objects(X.objects(spark, sf), type="Feature", layer="命令层"))


@query(_list_sql("domain = 'ASIA' AND scenario IS NOT NULL"))
def objects_by_domain(spark, sf):
    return _list(graph.list_objects(X.objects(spark, sf).where("scenario is not null"), domain="ASIA"))


@query("SELECT id, version FROM objects WHERE id = (SELECT min(id) FROM cmd) AND version = (SELECT min(version) FROM cmd WHERE id = (SELECT min(id) FROM cmd))")
def point_lookup(spark, sf):
    first = X.commands(spark, sf).groupBy("id").agg(F.min("version").alias("version")).orderBy("id").first()
    return graph.point_lookup(X.objects(spark, sf), first["id"], first["version"]).select("id", "version")


@query(f"SELECT o.id, NULL::VARCHAR AS version, 'ok' AS status, l.version AS resolved_version, {VERSIONS} AS available_versions FROM (SELECT DISTINCT id FROM objects) o JOIN latest l USING (id) JOIN vers USING (id)")
def resolve_latest(spark, sf):
    objects = X.objects(spark, sf)
    asked = objects.select("id").distinct().withColumn("version", F.lit(None).cast("string"))
    return graph.resolve(objects, asked).withColumn("available_versions", _joined("available_versions"))


@query(f"""SELECT a.id, {FIRST_VERSION} AS version, CASE WHEN v.id IS NULL THEN 'unknown_id' WHEN list_contains(coalesce(versions, []), {FIRST_VERSION}) THEN 'ok' ELSE 'unknown_version' END AS status,
    CASE WHEN list_contains(coalesce(versions, []), {FIRST_VERSION}) THEN {FIRST_VERSION} END AS resolved_version, {VERSIONS} AS available_versions
    FROM (SELECT DISTINCT id FROM objects UNION ALL SELECT 'NF0@MMLCommand@NOPE') a LEFT JOIN vers v ON a.id = v.id""")
def resolve_explicit(spark, sf):
    objects = X.objects(spark, sf)
    asked = objects.select("id").distinct().union(spark.createDataFrame([("NF0@MMLCommand@NOPE",)], "id string"))
    return graph.resolve(objects, asked.withColumn("version", F.lit(_first_version(spark, sf)))).withColumn("available_versions", _joined("available_versions"))


@query(f"SELECT id, {VERSIONS} AS versions FROM vers")
def versions_per_id(spark, sf):
    return graph.versions_per_id(X.objects(spark, sf)).withColumn("versions", _joined("versions"))


@query("SELECT id, version FROM latest")
def latest_version_per_id(spark, sf):
    return graph.latest_versions(X.objects(spark, sf))


@query("SELECT nf, arg_max(version, vk) AS version FROM objects WHERE nf IS NOT NULL AND version IS NOT NULL GROUP BY nf")
def latest_version_per_nf(spark, sf):
    return graph.latest_version_per_nf(X.objects(spark, sf))


@query("SELECT nf, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions FROM objects WHERE nf IS NOT NULL AND version IS NOT NULL GROUP BY nf")
def versions_per_nf(spark, sf):
    return graph.versions_per_nf(X.objects(spark, sf)).withColumn("versions", _joined("versions"))


@query("SELECT version, row_number() OVER (ORDER BY vk)::INT AS place FROM (SELECT DISTINCT version, vk FROM objects WHERE version IS NOT NULL)")
def version_order(spark, sf):
    from pyspark.sql import Window

    found = X.objects(spark, sf).where("version is not null").select("version").distinct()  # as few as there are versions
    return found.select("version", F.row_number().over(Window.orderBy(ver_key("version"))).alias("place"))


@query("SELECT id, name FROM newest")
def names_map(spark, sf):
    return graph.names_map(X.objects(spark, sf))


@query("SELECT id, name, domain FROM newest WHERE type = 'BusinessDomain'")
def business_domains(spark, sf):
    return graph.newest_per_id(X.objects(spark, sf).where("type = 'BusinessDomain'")).select("id", "name", "domain")


def _positions(df: DataFrame, column: str) -> DataFrame:
    """(position long from 0 in the order of ``column``, column): no task holds more than a range of the rows."""
    ordered = df.repartitionByRange(column).sortWithinPartitions(column).select(column, F.monotonically_increasing_id().alias("_place")).persist()
    part = F.shiftright("_place", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    # one row for each partition of the sort: as few as there are shuffle partitions
    starts = sizes.alias("x").join(sizes.alias("y"), F.col("y.part") < F.col("x.part"), "left").groupBy("x.part").agg(F.coalesce(F.sum("y.size"), F.lit(0)).alias("_start"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("part", part).join(F.broadcast(starts), "part").select((F.col("_start") + within).cast("long").alias("position"), column)


@query("""SELECT position, id, status, resolved_version FROM (
    SELECT row_number() OVER (ORDER BY id) - 1 AS position, id FROM (SELECT DISTINCT id FROM objects WHERE type IN ('MMLCommand', 'BusinessDomain'))) JOIN
    (SELECT id, 'ok' AS status, version AS resolved_version FROM latest) USING (id)""")
def batch_md(spark, sf):
    objects = X.objects(spark, sf)
    asked = objects.where("type in ('MMLCommand', 'BusinessDomain')").select("id").distinct()
    asked = _positions(asked, "id")
    twice = asked.unionByName(asked.withColumn("position", F.col("position") + 1_000_000)).withColumn("version", F.lit(None).cast("string"))
    return graph.batch_fetch(objects, twice).select("position", "id", "status", "resolved_version")


@query("SELECT id, segments, nf, type, local FROM (SELECT DISTINCT id, len(string_split(id, '@')) AS segments, CASE WHEN len(string_split(id, '@')) = 3 THEN split_part(id, '@', 1) END AS nf, split_part(id, '@', -2) AS type, split_part(id, '@', -1) AS local FROM objects)")
def split_ids(spark, sf):
    own = X.objects(spark, sf).select("id").distinct()
    return own.select("id", ids.segment_count(F.col("id")).cast("long").alias("segments"), ids.split_id(F.col("id"))["nf"].alias("nf"), ids.split_id(F.col("id"))["type"].alias("type"), ids.split_id(F.col("id"))["local"].alias("local"))


@query("SELECT DISTINCT id, version, CASE WHEN scope = 'nf' THEN layer || '/' || nf || '/' || version || '/' || id || '.md' WHEN scenario IS NULL THEN layer || '/' || domain || '/' || id || '.md' ELSE layer || '/' || domain || '/' || scenario || '/' || id || '.md' END AS path FROM objects")
def classify_paths(spark, sf):
    from ..model import default_registry

    own = X.objects(spark, sf).drop("layer", "scope").join(F.broadcast(default_registry(spark)), "type")  # the registry: eleven rows
    fields = F.map_from_arrays(F.array(F.lit("version"), F.lit("domain"), F.lit("scenario")), F.array(*(F.coalesce(c, F.lit("")) for c in ("version", "domain", "scenario"))))
    return own.select("id", "version", ids.classify(F.col("id"), F.col("scope"), F.col("layer"), F.col("path_fields"), fields)["path"].alias("path"))


# graph


_CENTER = "(SELECT min(id) FROM cmd)"


def _center(spark, sf):
    return X.commands(spark, sf).agg(F.min("id")).first()[0]


@query(f"SELECT from_id, from_version, relation, to_id FROM edges WHERE from_id = {_CENTER} AND from_version = (SELECT version FROM latest WHERE id = {_CENTER})")
def out_edges(spark, sf):
    center = _center(spark, sf)
    version = graph.latest_versions(X.objects(spark, sf)).where(F.col("id") == center).first()["version"]
    return graph.out_edges(X.edges(spark, sf), center, version)


@query("SELECT from_id, from_version, relation, to_id FROM edges WHERE to_id = (SELECT min(to_id) FROM edges WHERE relation = '操作配置对象')")
def in_edges(spark, sf):
    edges = X.edges(spark, sf)
    target = edges.where("relation = '操作配置对象'").agg(F.min("to_id")).first()[0]
    return graph.in_edges(edges, target)


@query(f"""SELECT from_id, from_version, relation, to_id, 'out' AS dir FROM edges WHERE from_id = {_CENTER} AND from_version = (SELECT version FROM latest WHERE id = {_CENTER})
    UNION ALL SELECT from_id, from_version, relation, to_id, 'in' FROM edges WHERE to_id = {_CENTER}""")
def neighbors(spark, sf):
    center = _center(spark, sf)
    version = graph.latest_versions(X.objects(spark, sf)).where(F.col("id") == center).first()["version"]
    return graph.neighbors(X.edges(spark, sf), center, version)


@query("SELECT from_id, from_version, relation, to_id FROM edges e WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE o.id = e.to_id)")
def dangling_edges(spark, sf):
    return graph.dangling_edges(X.objects(spark, sf), X.edges(spark, sf)).select("from_id", "from_version", "relation", "to_id")


def _bfs(center: str, hops: int, unversioned: bool = False) -> str:
    return f""", r AS (SELECT id, version, 0 AS depth FROM latest WHERE id = {center}
      UNION SELECT l.id, l.version, r.depth + 1 FROM r JOIN edges e ON e.from_id = r.id AND e.from_version IS NOT DISTINCT FROM r.version JOIN latest l ON l.id = e.to_id
      WHERE r.depth < {hops} AND ({'true' if unversioned else 'l.version IS NOT NULL'}))
    SELECT id, version, min(depth)::INT AS depth FROM r GROUP BY id, version"""


def _nodes(spark, sf, center, hops, unversioned=False):
    return graph.subgraph(X.objects(spark, sf), X.edges(spark, sf), center, None, hops, unversioned)[0].select("id", "version", "depth")


@query(_bfs(_CENTER, 1), recursive=True)
def subgraph_1hop(spark, sf):
    return _nodes(spark, sf, _center(spark, sf), 1)


@query(_bfs(_CENTER, 2), recursive=True)
def subgraph_2hop(spark, sf):
    return _nodes(spark, sf, _center(spark, sf), 2)


@query(_bfs("'BusinessDomain@ASIA'", 2), recursive=True)
def subgraph_unversioned(spark, sf):
    return _nodes(spark, sf, "BusinessDomain@ASIA", 2)


@query(_bfs("'BusinessDomain@ASIA'", 2, True), recursive=True)
def layered_closure(spark, sf):
    return _nodes(spark, sf, "BusinessDomain@ASIA", 2, True)


@query(_bfs(_CENTER, 1).replace("SELECT id, version, min(depth)::INT AS depth FROM r GROUP BY id, version", "SELECT from_id, from_version, relation, to_id FROM edges e WHERE EXISTS (SELECT 1 FROM r WHERE r.id = e.from_id AND r.version IS NOT DISTINCT FROM e.from_version)"), recursive=True)
def subgraph_edges(spark, sf):
    return graph.subgraph(X.objects(spark, sf), X.edges(spark, sf), _center(spark, sf), None, 1)[1].select("from_id", "from_version", "relation", "to_id")


@query("SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT from_id AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT to_id, 0, 1 FROM edges) GROUP BY id")
def degree(spark, sf):
    return graph.degrees(X.edges(spark, sf))


@query("SELECT id, count(DISTINCT other) AS n_neighbors FROM (SELECT from_id AS id, to_id AS other FROM edges UNION ALL SELECT to_id, from_id FROM edges) WHERE id <> other GROUP BY id")
def neighbor_counts(spark, sf):
    return graph.neighbor_counts(X.edges(spark, sf))


@query("SELECT id, o.version FROM objects o WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.to_id = o.id) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.from_id = o.id)")
def orphan_objects(spark, sf):
    ends = graph.degrees(X.edges(spark, sf)).select("id")
    return X.objects(spark, sf).join(ends, "id", "left_anti").select("id", "version")


@query(f"SELECT id, CASE WHEN list_contains(versions, {FIRST_VERSION}) THEN {FIRST_VERSION} WHEN list_contains(versions, '20.2.2') THEN '20.2.2' ELSE versions[-1] END AS opens FROM vers")
def navigation_version(spark, sf):
    own = graph.versions_per_id(X.objects(spark, sf)).withColumns({"forced": F.lit(_first_version(spark, sf)), "current": F.lit("20.2.2")})
    return graph.navigation_version(own).select("id", "opens")


@query("SELECT id, version FROM objects WHERE source_path LIKE 'Command/NF1/%' OR source_path LIKE 'Business/ASIA/%'")
def prefix_filter(spark, sf):
    return graph.under_prefixes(X.objects(spark, sf), ["Command/NF1", "Business/ASIA/", ""]).select("id", "version")


@query(f"SELECT id, version FROM objects WHERE split_part(source_path, '/', 2) = 'NF1' AND split_part(source_path, '/', 3) = {FIRST_VERSION}")
def export_slice(spark, sf):
    return graph.slice_paths(X.objects(spark, sf), nf="NF1", version=_first_version(spark, sf)).select("id", "version")


# counts


@query("SELECT type, count(*) AS n FROM objects GROUP BY type")
def count_by_type(spark, sf):
    return stats.count_by_type(X.objects(spark, sf))


@query("SELECT count(*) AS n FROM edges")
def edge_count(spark, sf):
    return X.edges(spark, sf).agg(F.count("*").alias("n"))


@query("""SELECT 'layer' AS level, ui_layer, NULL::VARCHAR AS nf, NULL::VARCHAR AS version, count(*) AS n FROM objects GROUP BY ui_layer
    UNION ALL SELECT 'nf', ui_layer, nf, NULL, count(*) FROM objects WHERE nf <> '' GROUP BY ui_layer, nf
    UNION ALL SELECT 'version', ui_layer, nf, version, count(*) FROM objects WHERE nf <> '' AND version <> '' GROUP BY ui_layer, nf, version""")
def stats_layer_rollup(spark, sf):
    return stats.layer_rollup(X.objects(spark, sf))


@query("""SELECT 'domain' AS level, domain, NULL::VARCHAR AS scenario, count(*) AS n FROM objects WHERE domain <> '' GROUP BY domain
    UNION ALL SELECT 'scenario', domain, scenario, count(*) FROM objects WHERE domain <> '' AND scenario <> '' GROUP BY domain, scenario""")
def stats_domain_rollup(spark, sf):
    return stats.domain_rollup(X.objects(spark, sf))


@query("SELECT type, n, round(100.0::DOUBLE * n / max(n) OVER ())::BIGINT AS pct FROM (SELECT type, count(*) AS n FROM objects GROUP BY type)")
def pct_of_max(spark, sf):
    return stats.percent_of_max(stats.count_by_type(X.objects(spark, sf)))


@query("SELECT nf, version, bool_or(layer = 'Command') AS has_command, bool_or(layer = 'ConfigObject') AS has_config, bool_or(layer = 'Feature') AS has_feature, bool_or(layer = 'License') AS has_license FROM objects WHERE nf IS NOT NULL GROUP BY nf, version")
def asset_existence(spark, sf):
    return stats.existing_layers(X.objects(spark, sf))



# telemetry


def _used(spark, sf):
    return telemetry.qualifying(X.telemetry(spark, sf))

@query("SELECT count(*) AS total FROM used")
def telemetry_total(spark, sf):
    return telemetry.total(_used(spark, sf))


@query("SELECT coalesce(nullif(obj_type, ''), '?') AS obj_type, count(*) AS n FROM used GROUP BY 1")
def telemetry_by_type(spark, sf):
    return telemetry.by_type(_used(spark, sf))


@query('SELECT "user", count(*) AS n FROM used GROUP BY 1')
def telemetry_by_user(spark, sf):
    return telemetry.by_user(_used(spark, sf))


@query("SELECT operator, count(*) AS n FROM used WHERE operator <> '' GROUP BY 1")
def telemetry_by_operator(spark, sf):
    return telemetry.by_operator(_used(spark, sf))


@query("SELECT obj_id, count(*) AS n, coalesce(nullif(arg_max(obj_type, ts || lpad(seq::VARCHAR, 20, '0')), ''), '?') AS obj_type FROM used GROUP BY obj_id ORDER BY n DESC, obj_id LIMIT 20")
def telemetry_top_ids(spark, sf):
    return telemetry.top_ids(_used(spark, sf))


@query("SELECT substr(ts, 6, 5) || ' ' || substr(ts, 12, 2) || ':00' AS hour, count(*) AS n FROM used GROUP BY 1")
def telemetry_timeline_hour(spark, sf):
    return telemetry.timeline(_used(spark, sf))


@query("SELECT count(*) AS n FROM used WHERE ts >= '2024-01-20'")
def telemetry_lookback(spark, sf):
    return telemetry.qualifying(X.telemetry(spark, sf), since="2024-01-20").agg(F.count("*").alias("n"))


@query("SELECT seq, ts, obj_id FROM used ORDER BY ts, seq LIMIT 101")
def skill_usage_page1(spark, sf):
    return telemetry.feed_page(_used(spark, sf), "", 100).select("seq", "ts", "obj_id")


@query("SELECT seq, ts, obj_id FROM (SELECT * FROM used ORDER BY ts, seq LIMIT 101 OFFSET 100)")
def skill_usage_next(spark, sf):
    _, _, cursor = telemetry.read_feed(_used(spark, sf), "", 100)
    return telemetry.feed_page(_used(spark, sf), cursor, 100).select("seq", "ts", "obj_id")


@query("SELECT seq, ts, endpoint FROM telemetry WHERE level = 'request' AND \"user\" = 'u7' ORDER BY ts DESC, seq DESC LIMIT 100")
def user_activity(spark, sf):
    return telemetry.user_activity(X.telemetry(spark, sf), "u7").select("seq", "ts", "endpoint")


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def hourly_windows(spark, sf):
    e = X.read(spark, sf, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count("*").alias("n"))


# reviews


@query("SELECT run_id, n_reviews, latest_verdict FROM lv")
def latest_verdict(spark, sf):
    return reviews.latest_verdicts(X.reviews(spark, sf))


@query("""SELECT c.id, c.domain, c.scenario, c.name, coalesce(n_runs, 0) AS n_runs, coalesce(n_reviews, 0)::BIGINT AS n_reviews, latest_verdict FROM cases c LEFT JOIN
    (SELECT case_id, count(*) AS n_runs, sum(coalesce(n_reviews, 0)) AS n_reviews, arg_max(coalesce(latest_verdict, '未判定'), r.id) AS latest_verdict
     FROM runs r LEFT JOIN lv ON lv.run_id = r.id GROUP BY case_id) x ON x.case_id = c.id""")
def case_run_review_rollup(spark, sf):
    return reviews.case_rollup(X.cases(spark, sf), X.runs(spark, sf), X.reviews(spark, sf))


@query("SELECT verdict, count(*) AS n FROM reviews GROUP BY verdict")
def verdict_distribution(spark, sf):
    return reviews.verdict_distribution(X.reviews(spark, sf))


@query("SELECT r.id, case_id, run_at, coalesce(n_reviews, 0) AS n_reviews, coalesce(latest_verdict, '未判定') AS latest_verdict FROM runs r LEFT JOIN lv ON lv.run_id = r.id")
def run_list(spark, sf):
    return reviews.runs_with_reviews(X.runs(spark, sf), X.reviews(spark, sf))


@query("SELECT 'domain' AS level, domain, NULL::VARCHAR AS scenario, count(*) AS n FROM cases GROUP BY domain UNION ALL SELECT 'scenario', domain, scenario, count(*) FROM cases GROUP BY domain, scenario")
def cases_by_domain(spark, sf):
    return reviews.cases_by_domain(X.cases(spark, sf))


@query("SELECT id, name FROM cases WHERE domain = 'd1' AND contains(lower(name), 'case 1')")
def case_search(spark, sf):
    return reviews.filter_cases(X.cases(spark, sf), domain="d1", q="CASE 1").select("id", "name")


@query("SELECT r.id AS run_id, 'R' || lpad((coalesce(n_reviews, 0) + 1)::VARCHAR, 3, '0') AS next_id FROM runs r LEFT JOIN lv ON lv.run_id = r.id")
def next_review_id(spark, sf):
    return reviews.next_review_id(X.runs(spark, sf), X.reviews(spark, sf))


@query("SELECT id FROM runs WHERE case_id NOT IN (SELECT id FROM cases WHERE domain <> 'd3')")
def orphan_runs(spark, sf):
    return reviews.orphan_runs(X.cases(spark, sf).where("domain <> 'd3'"), X.runs(spark, sf)).select("id")


# mining


_VERBS = "CASE src % 4 WHEN 0 THEN 'ADD' WHEN 1 THEN 'LST' WHEN 2 THEN 'SET' ELSE 'DSP' END"

@query(f"""SELECT object, CASE WHEN bool_or(verb = 'ADD') THEN 'entity' WHEN bool_or(verb = 'SET') THEN 'global_setting' ELSE 'query_target' END AS object_kind, count(*) AS n_commands
    FROM (SELECT {_VERBS} AS verb, local AS object FROM p) GROUP BY object HAVING bool_or(verb IN ('ADD', 'SET'))""")
def object_kind(spark, sf):
    p = X.parts(spark, sf)
    verb = F.element_at(F.array(*(F.lit(v) for v in ("ADD", "LST", "SET", "DSP"))), (F.col("src") % 4 + 1).cast("int"))
    rows = p.select(F.col("src").cast("string").alias("path"), F.lit("").alias("md"), F.lit("").alias("name_zh"), F.concat_ws(" ", verb, "local").alias("name"), verb.alias("verb"), F.col("local").alias("object"))
    return mining.families(rows).select("object", "object_kind", "n_commands")


@query("SELECT code, count(*) AS n FROM (SELECT 'GWFD-' || lpad((p_partkey % 40)::VARCHAR, 6, '0') AS code FROM part) GROUP BY code")
def feature_groups(spark, sf):
    p = X.read(spark, sf, "part")
    code = F.concat(F.lit("GWFD-"), F.lpad((F.col("p_partkey") % 40).cast("string"), 6, "0"))
    paths = p.select(F.concat_ws("/", F.lit("GWFD-999999 总"), F.concat(code, F.lit(" 特性")), F.concat(F.col("p_partkey").cast("string"), F.lit(".md"))).alias("path"))
    return paths.groupBy(text.deepest_code(F.col("path")).alias("code")).agg(F.count("*").alias("n"))


# maintenance, registry, access


def _disk(spark, sf):
    return X.objects(spark, sf).where("mtime % 10 <> 3").select("source_path", (F.col("mtime") + F.when(F.col("mtime") % 7 == 0, 1.0).otherwise(0.0005)).alias("mtime"))

@query("""SELECT source_path, change FROM (SELECT coalesce(d.source_path, o.source_path) AS source_path, CASE WHEN d.source_path IS NULL THEN 'deleted' WHEN abs(d.mtime - o.mtime) > 0.001 THEN 'changed' END AS change
    FROM (SELECT source_path, mtime + CASE WHEN mtime % 7 = 0 THEN 1.0 ELSE 0.0005 END AS mtime FROM objects WHERE mtime % 10 <> 3) d FULL JOIN (SELECT source_path, max(mtime) AS mtime FROM objects GROUP BY 1) o ON d.source_path = o.source_path) WHERE change IS NOT NULL""")
def mtime_diff(spark, sf):
    return maintenance.changed_files(_disk(spark, sf), X.objects(spark, sf))


@query("SELECT id, version FROM objects WHERE source_path LIKE 'Command/%' AND mtime % 10 = 3")
def prefix_reindex_removed(spark, sf):
    return maintenance.removed_under(X.objects(spark, sf), _disk(spark, sf), ["Command"]).select("id", "version")


@query("SELECT id, version, CASE WHEN mtime % 5 = 0 THEN name || ' new' ELSE name END AS name FROM objects")
def upsert_objects(spark, sf):
    objects = X.objects(spark, sf).select("id", "version", "name", "mtime")
    new = objects.where("mtime % 5 = 0").withColumn("name", F.concat("name", F.lit(" new")))
    return maintenance.upsert(objects, new).select("id", "version", "name")


@query(f"SELECT from_id, from_version, relation, to_id FROM edges WHERE from_version IS DISTINCT FROM {FIRST_VERSION} UNION ALL SELECT DISTINCT from_id, from_version, 'new', to_id FROM edges WHERE from_version = {FIRST_VERSION}")
def replace_edges(spark, sf):
    edges = X.edges(spark, sf)
    own = edges.where(F.col("from_version") == _first_version(spark, sf))
    return maintenance.replace_edges(edges, own.select(F.col("from_id").alias("id"), F.col("from_version").alias("version")), own.withColumn("relation", F.lit("new"))).select("from_id", "from_version", "relation", "to_id")


@query("SELECT id, version, type, CASE type WHEN 'MMLCommand' THEN 'X' ELSE layer END AS layer FROM objects")
def registry_override(spark, sf):
    """Every object's layer by a registry in which a bundle has put one type elsewhere."""
    from ..model import REGISTRY, default_registry

    more = spark.createDataFrame([("MMLCommand", "X", "nf", 3, [], []), ("Extra", "Y", "nf", 3, [], [])], REGISTRY)
    merged = maintenance.merge_registry(default_registry(spark), more)[0].select("type", "layer")
    return X.objects(spark, sf).drop("layer").join(F.broadcast(merged), "type").select("id", "version", "type", "layer")  # a row for each type


_USERS = "SELECT 'u' || i::VARCHAR AS \"user\", i & 1 = 1 AS f, i & 2 = 2 AS s, i & 4 = 4 AS u, i & 8 = 8 AS a, i & 16 = 16 AS t, i & 32 = 32 AS adm FROM (SELECT c_custkey AS i FROM customer)"


@query(f""", w AS ({_USERS}) SELECT "user", 'admin' AS permission, adm AS allowed FROM w UNION ALL SELECT "user", 'frontend', adm OR f FROM w UNION ALL SELECT "user", 'skill', adm OR f OR s FROM w
    UNION ALL SELECT "user", 'upload', adm OR (f AND u) FROM w UNION ALL SELECT "user", 'assets', adm OR a FROM w UNION ALL SELECT "user", 'test', adm OR (f AND t) FROM w""")
def permission_matrix(spark, sf):
    i = F.col("c_custkey")
    bits = {"can_frontend": 1, "can_skill": 2, "can_upload": 4, "can_assets": 8, "can_test": 16, "is_admin": 32}
    users = X.read(spark, sf, "customer").select(F.concat(F.lit("u"), i.cast("string")).alias("user"), *((i.bitwiseAND(b) == b).alias(n) for n, b in bits.items()))
    return access.permission_matrix(users)


@query("SELECT DISTINCT split_part(source_path, '/', 1) AS name, true AS is_dir FROM objects")
def list_directory(spark, sf):
    return maintenance.list_directory(X.objects(spark, sf))


@query(""", c0 AS (SELECT id AS centre, id, version, 0 AS depth FROM latest WHERE id IN (SELECT id FROM cmd)),
    c1 AS (SELECT DISTINCT centre, l.id, l.version, 1 AS depth FROM c0 JOIN edges e ON e.from_id = c0.id AND e.from_version IS NOT DISTINCT FROM c0.version JOIN latest l ON l.id = e.to_id WHERE l.version IS NOT NULL),
    c2 AS (SELECT DISTINCT centre, l.id, l.version, 2 AS depth FROM c1 JOIN edges e ON e.from_id = c1.id AND e.from_version IS NOT DISTINCT FROM c1.version JOIN latest l ON l.id = e.to_id WHERE l.version IS NOT NULL)
    SELECT centre, id, version, min(depth) AS depth FROM (FROM c0 UNION ALL FROM c1 UNION ALL FROM c2) GROUP BY ALL""")
def subgraphs_all(spark, sf):
    """The neighbourhoods of all commands, two hops wide, in one run."""
    return graph.subgraphs(X.objects(spark, sf), X.edges(spark, sf), X.commands(spark, sf).select("id"), scratch(spark, "subgraphs"), 2)


@query("""SELECT q, id, version FROM objects, (VALUES ('gold'), (' LAV'), ('增加s'), ('e'), ('nf1@'), ('no such text')) s(q) WHERE contains(lower(id), trim(lower(q))) OR contains(lower(name), trim(lower(q))) OR contains(lower(name_zh), trim(lower(q)))""")
def indexed_search(spark, sf):
    """Searches of several lengths through the index of letter runs."""
    objects, path = X.objects(spark, sf), scratch(spark, "letters")
    search.build_index(objects, path)
    found = [search.search(objects, path, q).select(F.lit(q).alias("q"), "id", "version") for q in ("gold", " LAV", "增加s", "e", "nf1@", "no such text")]
    return functools.reduce(DataFrame.unionByName, found)


# texts: no SQL can say these


@query()
def html_to_md(spark, sf):
    return X.read(spark, sf, "pages").select("page_id", html.html_to_markdown("html").alias("md"), html.is_meaningful(F.col("html")).alias("meaningful"))


@query()
def dictionary_scan(spark, sf):
    docs = X.read(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.upper("text").alias("md"))
    words = X.read(spark, sf, "benchmark").select(F.regexp_extract_all(F.upper("text"), F.lit("[A-Z0-9_]+"), 0).alias("w"))
    names = words.select("w", F.explode(F.sequence(F.lit(2), F.lit(6))).alias("n")).where("size(w) >= n").select(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("name"))
    return mining.scan_names(docs, names)


@query()
def extract_problems(spark, sf):
    c = X.read(spark, sf, "conversations")
    line = F.regexp_replace("text", r"\R+", " ")  # a field of a review is one line, so the whole text becomes one
    md = F.concat(F.lit("# R\n### 问题 1\n- 描述: "), line, F.lit("\n- 归因: a，b、c\n- 涉及对象: [[A@B@C]] [[D]]\n"))
    return c.select("conv_id", "turn", F.to_json(text.problems(md)).alias("problems"))


@query()
def mojibake_scan(spark, sf):
    return encoding.mojibake(X.read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "kind", "score", "segments")


def queries() -> dict[str, Query]:
    return dict(found_queries)


def oracle_sql() -> dict[str, str]:
    return dict(found_sql)
