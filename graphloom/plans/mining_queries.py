"""Queries of the mining layer over pages that are made from the tables, each with SQL that says what was put into the pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import mining, telemetry
from . import fixtures as X
from .registry import query

VERBS = ("ADD", "LST", "SET", "DSP")
NOTES = ("立即生效", "对新流有效", "对新用户有效", "延迟或者重启", "高危操作")
MODES = ("立即生效", "对新流生效", "对新用户生效", "延迟生效", "")


def _one_of(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _case(values: tuple[str, ...], number: str) -> str:
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _lines(*lines) -> Column:
    return F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))


def _six(number: Column) -> Column:
    return F.lpad(number.cast("string"), 6, "0")


def command_pages(spark, sf) -> DataFrame:
    """(src, path, md): a page for each part; every eleventh describes no command."""
    p = X.parts(spark, sf).select("src", "local", F.split_part("local", F.lit(" "), F.lit(1)).alias("w"), _one_of(VERBS, F.col("src")).alias("verb"))
    p = p.withColumn("name", F.concat_ws(" ", "verb", "w"))
    p = p.withColumn("ref", F.col("src") * 7 % 1009 + 1).join(F.broadcast(p.where("src between 1 and 1009").select(F.col("src").alias("ref"), F.col("name").alias("other"))), "ref", "left")  # no page names another part
    title = F.when(F.col("src") % 11 == 0, F.concat(F.lit("# overview "), "src")).otherwise(F.concat(F.lit("# 增加"), "local", F.lit("（"), "name", F.lit("）")))
    row = F.concat(F.lit("| P"), "src", F.lit(" | "), "w", F.lit(" | see "), "local", F.lit(" |"))
    md = _lines(
        title, "", "## 命令功能", "", "适用NF：AMF、SMF，UPF", F.concat(F.lit("does "), "local"), "", "## 注意事项", _one_of(NOTES, F.col("src")), "",
        "## 参数说明", "| 参数标识 | 参数名称 | 参数说明 |", "| --- | --- | --- |", row, "", F.concat(F.lit("- ref: "), F.coalesce("other", F.lit("none")), F.lit(".")),
    )
    return X.dealt(p.select("src", F.concat(F.lpad(F.col("src").cast("string"), 9, "0"), F.lit(".md")).alias("path"), md.alias("md")), "src")


PAGES = f""", named AS (SELECT src, local, split_part(local, ' ', 1) AS w, {_case(VERBS, 'src')} AS verb FROM p),
every AS (SELECT *, verb || ' ' || w AS name, lpad(src::VARCHAR, 9, '0') || '.md' AS path FROM named),
pg AS (SELECT a.*, b.name AS other FROM every a LEFT JOIN every b ON b.src = a.src * 7 % 1009 + 1 WHERE a.src % 11 <> 0)
"""


def _commands(spark, sf) -> DataFrame:
    return mining.command_pages(command_pages(spark, sf))


@query(f"""{PAGES} SELECT path, '增加' || local AS name_zh, name, verb, w AS object, 'AMF,SMF,UPF' AS nfs, {_case(MODES, 'src')} AS effect_mode, src % 5 = 4 AS dangerous,
    'P' || src || '/' || w || '/see ' || local AS params FROM pg""")
def command_fields(spark, sf):
    md = F.col("md")
    params = F.array_join(F.transform(text.param_rows(md), lambda x: F.concat_ws("/", x["id"], x["name"], x["text"])), ";")
    return _commands(spark, sf).select(
        "path", "name_zh", "name", "verb", "object",
        F.array_join(text.applicable_nf(text.section(md, text.FUNCTION_SECTION)), ",").alias("nfs"),
        text.effect_mode(text.section(md, "注意事项")).alias("effect_mode"),
        text.is_dangerous(md).alias("dangerous"), params.alias("params"),
    )


@query(f"{PAGES} SELECT src, CASE WHEN src % 11 = 0 THEN '' ELSE '增加' || local END AS zh, CASE WHEN src % 11 = 0 THEN 'overview ' || src ELSE name END AS name FROM every")
def loose_titles(spark, sf):
    title = text.command_title(F.col("md"), strict=False)
    return command_pages(spark, sf).select("src", title["name_zh"].alias("zh"), title["name"].alias("name"))


@query(f"""{PAGES} SELECT DISTINCT 'NF0@MMLCommand@' || name AS from_id, '操作配置对象' AS relation, 'NF0@ConfigObject@' || w AS to_id FROM pg
    WHERE w IN (SELECT w FROM pg WHERE verb IN ('ADD', 'SET'))""")
def config_object_edges(spark, sf):
    return mining.config_edges(_commands(spark, sf), "NF0")


@query(f"""{PAGES} SELECT DISTINCT 'NF0@MMLCommand@' || name AS from_id, '参见' AS relation, 'NF0@MMLCommand@' || other AS to_id FROM pg
    WHERE other <> name AND other IN (SELECT name FROM pg)""")
def reference_edges(spark, sf):
    return mining.reference_edges(_commands(spark, sf), "NF0")


@query(f"""{PAGES}, x AS (SELECT name, other AS ref FROM pg UNION SELECT name, name FROM pg UNION SELECT 'NO SUCH', 'ADD IT')
    SELECT DISTINCT 'NF0@MMLCommand@' || name AS from_id, '参数引用' AS relation, 'NF0@MMLCommand@' || ref AS to_id FROM x WHERE ref <> name AND name IN (SELECT name FROM pg)""")
def external_link_edges(spark, sf):
    own = _commands(spark, sf)
    other = F.regexp_extract("md", r"- ref: (.+)\.$", 1)
    links = own.select("name", F.array(F.when(other != "none", other).otherwise(""), F.col("name")).alias("refs"))
    links = links.union(spark.createDataFrame([("NO SUCH", ["ADD IT"])], "name string, refs array<string>"))
    return mining.external_edges(own, links, "NF0")


_FAMILIES = f"""{PAGES}, f AS (SELECT w AS object, array_to_string(list_sort(list(DISTINCT verb)), ',') AS verbs, count(*) AS n_commands,
    CASE WHEN bool_or(verb = 'ADD') THEN 'entity' ELSE 'global_setting' END AS object_kind,
    coalesce(arg_min(local, path) FILTER (WHERE verb = 'ADD'), arg_min(local, path)) AS name_zh,
    '适用NF：AMF、SMF，UPF' || chr(10) || 'does ' || coalesce(arg_min(local, path) FILTER (WHERE verb = 'ADD'), arg_min(local, path) FILTER (WHERE verb = 'SET')) AS description,
    string_agg(name, ',' ORDER BY path) AS members FROM pg GROUP BY w HAVING bool_or(verb IN ('ADD', 'SET')))"""


@query(f"{_FAMILIES} SELECT object, verbs, n_commands FROM f")
def configobject_families(spark, sf):
    return mining.families(_commands(spark, sf)).select("object", F.array_join("verbs", ",").alias("verbs"), "n_commands")


@query(f"{_FAMILIES} SELECT object, object_kind, name_zh, description, members FROM f")
def family_details(spark, sf):
    return mining.families(_commands(spark, sf)).select("object", "object_kind", "name_zh", "description", F.array_join("members", ",").alias("members"))


# codes: found in texts, valid ones, both


_CODES = "SELECT DISTINCT 'LKV' || lpad((l_partkey % 97)::VARCHAR, 6, '0') AS code FROM lineitem"
_VALID = "SELECT 'LKV' || lpad((s_suppkey % 60)::VARCHAR, 6, '0') AS code FROM supplier"


def _codes(spark, sf):
    line = X.read(spark, sf, "lineitem").select(F.concat(F.lit("licence LKV"), _six(F.col("l_partkey") % 97), F.lit(" of")).alias("md"))
    found = line.select(F.explode(text.codes_in(F.col("md"), text.LICENSE_CODE)).alias("code")).distinct()
    valid = X.read(spark, sf, "supplier").select(F.concat(F.lit("LKV"), _six(F.col("s_suppkey") % 60)).alias("code")).distinct()
    return found, valid


@query(f"{_CODES} INTERSECT {_VALID}")
def code_intersection(spark, sf):
    return mining.known_codes(*_codes(spark, sf))


@query(f"{_CODES} EXCEPT {_VALID}")
def code_difference(spark, sf):
    return mining.unknown_codes(*_codes(spark, sf))


@query(f"{_CODES} UNION {_VALID}")
def code_union(spark, sf):
    return mining.all_codes(*_codes(spark, sf))


# features and licences


def feature_pages(spark, sf) -> DataFrame:
    """(c, path, md): a page for each customer, forty features."""
    c = F.col("c_custkey")
    own = F.concat(F.lit("GWFD-"), _six(c % 40))
    kinds = (F.concat(own, F.lit(" 特性概述_1.md")), F.lit("配置X_2.md"), F.lit("实现原理.md"), F.concat(F.lit("激活特性_"), c, F.lit(".md")), F.lit("调测.md"), F.concat(F.lit("说明"), c, F.lit(".md")), F.concat(own, F.lit(" 业务.md")))
    name = F.element_at(F.array(*kinds), (c % 7 + 1).cast("int"))
    folder = _one_of(("ops", "原理", "ref"), c)
    path = F.concat_ws("/", F.concat(own, F.lit(" 特性")), folder, F.lpad(c.cast("string"), 9, "0"), F.concat(F.lit("p"), c % 13), name)
    md = _lines(F.concat(F.lit("# page "), c), "", F.concat(F.lit("needs GWFD-"), _six(c * 3 % 60), F.lit(" and LKV"), _six(c % 97)), "```", "GWFD-000039 in code", "```", "- [GWFD-000038](#x)")
    return X.read(spark, sf, "customer").select(c.alias("c"), path.alias("path"), md.alias("md"))


FEATURES = """, c0 AS (SELECT c_custkey AS c, 'GWFD-' || lpad((c_custkey % 40)::VARCHAR, 6, '0') AS code FROM customer),
c1 AS (SELECT *, CASE c % 7 WHEN 0 THEN code || ' 特性概述_1.md' WHEN 1 THEN '配置X_2.md' WHEN 2 THEN '实现原理.md' WHEN 3 THEN '激活特性_' || c || '.md' WHEN 4 THEN '调测.md' WHEN 5 THEN '说明' || c || '.md' ELSE code || ' 业务.md' END AS filename,
  CASE c % 7 WHEN 0 THEN code || ' 特性概述' WHEN 1 THEN '配置X' WHEN 2 THEN '实现原理' WHEN 3 THEN '激活特性' WHEN 4 THEN '调测' WHEN 5 THEN '说明' || c ELSE code || ' 业务' END AS slug0,
  CASE c % 7 WHEN 0 THEN '概述' WHEN 1 THEN '配置' WHEN 2 THEN '原理' WHEN 3 THEN '激活' WHEN 4 THEN '调测' ELSE CASE WHEN c % 3 = 1 THEN '原理' ELSE '其它' END END AS doc_type,
  CASE c % 7 WHEN 0 THEN 0 WHEN 6 THEN 1 END AS rank, 'p' || (c % 13) AS parent FROM c0),
c2 AS (SELECT *, code || ' 特性/' || CASE c % 3 WHEN 0 THEN 'ops' WHEN 1 THEN '原理' ELSE 'ref' END || '/' || lpad(c::VARCHAR, 9, '0') || '/' || parent || '/' || filename AS path FROM c1),
c3 AS (SELECT *, rank IS NOT NULL AND row_number() OVER (PARTITION BY code ORDER BY rank ASC NULLS LAST, filename, path) = 1 AS is_overview FROM c2),
c4 AS (SELECT *, CASE WHEN NOT is_overview AND count(*) OVER (PARTITION BY code, is_overview, slug0) > 1 THEN parent || '-' || slug0 ELSE slug0 END AS slug1 FROM c3),
fd AS (SELECT *, CASE WHEN NOT is_overview AND count(*) OVER (PARTITION BY code, is_overview, slug1) > 1 THEN slug1 || '-' || row_number() OVER (PARTITION BY code, is_overview, slug1 ORDER BY filename, path) ELSE slug1 END AS slug FROM c4)
"""


@query(f"""{FEATURES} SELECT path, code, filename, doc_type, 'page ' || c AS title, is_overview, slug,
    'NF0@Feature@' || code || CASE WHEN is_overview THEN '' ELSE '-' || slug END AS id FROM fd""")
def feature_documents(spark, sf):
    docs = mining.feature_ids(mining.feature_documents(feature_pages(spark, sf)), "NF0")
    return docs.select("path", "code", "filename", "doc_type", "title", "is_overview", "slug", "id")


@query(f"""{FEATURES} SELECT code, count(*) FILTER (WHERE c % 7 = 0) AS n_overviews FROM fd GROUP BY code
    HAVING count(*) FILTER (WHERE c % 7 = 0) > 1 OR NOT bool_or(is_overview)""")
def overview_problems(spark, sf):
    return mining.overview_counts(mining.feature_documents(feature_pages(spark, sf)))


_FEATURE_EDGES = f"""{FEATURES}, ov AS (SELECT DISTINCT code FROM fd WHERE is_overview),
dep AS (SELECT DISTINCT code, 'GWFD-' || lpad((c * 3 % 60)::VARCHAR, 6, '0') AS target FROM fd), lic AS (SELECT DISTINCT code, 'LKV' || lpad((c % 97)::VARCHAR, 6, '0') AS target FROM fd)"""


@query(f"""{_FEATURE_EDGES} SELECT DISTINCT 'NF0@Feature@' || code AS from_id, '依赖特性' AS relation, 'NF0@Feature@' || target AS to_id FROM dep
      WHERE code <> target AND target IN (SELECT code FROM fd) AND code IN (SELECT code FROM ov)
    UNION SELECT 'NF0@Feature@' || code, '所需License', 'NF0@License@' || target FROM lic WHERE target IN ({_VALID}) AND code IN (SELECT code FROM ov)
    UNION SELECT 'NF0@Feature@' || code, '包含子文档', 'NF0@Feature@' || code || '-' || slug FROM fd WHERE NOT is_overview AND code IN (SELECT code FROM ov)
    UNION SELECT 'NF0@Feature@' || code || '-' || slug, '属于特性', 'NF0@Feature@' || code FROM fd WHERE NOT is_overview""")
def feature_edges(spark, sf):
    return mining.feature_edges(mining.feature_documents(feature_pages(spark, sf)), "NF0", _codes(spark, sf)[1])[0]


@query(f"""{_FEATURE_EDGES} SELECT 'feature' AS kind, count(*) AS n FROM dep WHERE code <> target AND target NOT IN (SELECT code FROM fd)
    UNION ALL SELECT 'license', count(*) FROM lic WHERE target NOT IN ({_VALID})""")
def dropped_codes(spark, sf):
    return mining.feature_edges(mining.feature_documents(feature_pages(spark, sf)), "NF0", _codes(spark, sf)[1])[1]


def license_pages(spark, sf) -> DataFrame:
    """(path, md): a page of two licences for each supplier; licences repeat over the pages."""
    s = F.col("s_suppkey")
    name = F.concat(_one_of(("功能控制项_", "资源控制项_", "其它_"), s), F.lpad(s.cast("string"), 9, "0"), F.lit(".md"))
    md = _lines(
        "# licences", F.concat(F.lit("#### [ NO"), s, F.lit(" LKV"), _six(s % 60), F.lit(" name "), s, F.lit(" ] more")), "",
        "| 归属NF | AMF、SMF |", F.concat(F.lit("for GWFD-"), _six(s % 50)), "", F.concat(F.lit("#### [ M LKV"), _six((s + 1) % 60), F.lit(" other ]")), "nothing",
    )
    return X.read(spark, sf, "supplier").select(F.concat(F.lit("a/"), name).alias("path"), md.alias("md"))


LICENSES = """, s0 AS (SELECT s_suppkey AS s, 'a/' || CASE s_suppkey % 3 WHEN 0 THEN '功能控制项_' WHEN 1 THEN '资源控制项_' ELSE '其它_' END || lpad(s_suppkey::VARCHAR, 9, '0') || '.md' AS path FROM supplier),
s1 AS (SELECT path, s, 0 AS place, 'LKV' || lpad((s % 60)::VARCHAR, 6, '0') AS code, 'NO' || s AS control_id, 'name ' || s AS name, 'AMF,SMF' AS nfs,
       '| 归属NF | AMF、SMF |' || chr(10) || 'for GWFD-' || lpad((s % 50)::VARCHAR, 6, '0') AS body FROM s0
  UNION ALL SELECT path, s, 1, 'LKV' || lpad(((s + 1) % 60)::VARCHAR, 6, '0'), 'M', 'other', '', 'nothing' FROM s0),
lc AS (SELECT *, CASE s % 3 WHEN 0 THEN '功能' WHEN 1 THEN '资源' ELSE '未分类' END AS item_type FROM
       (SELECT *, row_number() OVER (PARTITION BY code ORDER BY path DESC, place DESC) AS n FROM s1) WHERE n = 1)
"""


@query(f"{LICENSES} SELECT code, control_id, name, item_type, nfs, body FROM lc")
def license_rows(spark, sf):
    return mining.licenses(license_pages(spark, sf)).select("code", "control_id", "name", "item_type", F.array_join("applicable_nf", ",").alias("nfs"), "body")


@query(f"""{LICENSES} SELECT 'NF0@License@' || code AS from_id, '对应特性' AS relation, 'NF0@Feature@GWFD-' || lpad((s % 50)::VARCHAR, 6, '0') AS to_id FROM lc
    WHERE place = 0 AND s % 50 IN (SELECT c_custkey % 40 FROM customer)""")
def license_edges(spark, sf):
    features = mining.feature_documents(feature_pages(spark, sf)).select("code")
    return mining.license_edges(mining.licenses(license_pages(spark, sf)), features, "NF0")


# document references, folders, versions


@query("""SELECT id || '@' || version AS key, 'See [[NF0@MMLCommand@' || local || ']] and gone and [web](http://e.org) and ' || CASE WHEN src % 3 <> 0 THEN '[[' || id || ']]' ELSE 'page' END || ' and '
      || CASE WHEN src % 2 = 0 THEN '[[NF0@Feature@GWFD-' || lpad((src % 1000000)::VARCHAR, 6, '0') || ']]' ELSE 'feature' END AS md,
    1 + (src % 3 <> 0)::BIGINT + (src % 2 = 0)::BIGINT AS n_resolved, 1 + (src % 3 = 0)::BIGINT + (src % 2 <> 0)::BIGINT AS n_stripped, local AS commands FROM cmd""")
def doc_ref_rewrite(spark, sf):
    c = X.commands(spark, sf)
    code = F.concat(F.lit("GWFD-"), _six(F.col("src") % 1_000_000))
    links = F.concat(F.lit(" and [gone](b/x.md) and [web](http://e.org) and [page](c/page_"), "src", F.lit(".md) and [feature](d/"), code, F.lit(" x.md)"))
    docs = c.select(F.concat_ws("@", "id", "version").alias("key"), F.concat(F.lit("See [增加（"), "local", F.lit("）](a/增加（"), "local", F.lit("）_1.md)"), links).alias("md"))
    # every third page has no source file, every second feature does not exist
    sources = c.where("src % 3 <> 0").select(F.concat(F.lit("page_"), "src", F.lit(".md")).alias("filename"), "id")
    features = c.where("src % 2 = 0").select(code.alias("code")).distinct()
    out = mining.rewrite_references(docs, "NF0", c.select(F.col("local").alias("name")).distinct(), sources, features)
    return out.select("key", "md", "n_resolved", "n_stripped", F.array_join("commands", ",").alias("commands"))


@query("""SELECT src, CASE src % 3 WHEN 0 THEN nf || ',' || version WHEN 1 THEN 'b,' || nf END AS category
    FROM p""")
def category_paths(spark, sf):
    p = X.parts(spark, sf)
    path = F.when(F.col("src") % 3 == 0, F.concat_ws("/", F.lit("a/b"), "nf", "version", F.lit("x.md"))).when(F.col("src") % 3 == 1, F.concat_ws("/", F.lit("c/b"), "nf", F.lit("x.md"))).otherwise("d/x.md")
    return mining.category_path(p.select("src", path.alias("path")), ["a/b/", "c", "a"]).select("src", F.array_join("category", ",").alias("category"))


@query("""SELECT role, path, strict, rank FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY len(string_split(path, '/')), path) AS rank FROM (
      SELECT *, bool_or(strict) OVER (PARTITION BY role) AS any_strict FROM (
        SELECT k.role, f.path, contains(lower(f.path), 'nf1') AS strict FROM (SELECT DISTINCT nf || '/' || version || '/' || local || ' docs' AS path FROM p) f
        JOIN (VALUES ('commands', 'RED'), ('features', 'Blue'), ('none', 'qqq')) k(role, keyword) ON contains(lower(split_part(f.path, '/', -1)), lower(k.keyword)))) WHERE strict = any_strict) WHERE rank <= 30""")
def located_folders(spark, sf):
    folders = X.parts(spark, sf).select(F.concat_ws("/", "nf", "version", F.concat("local", F.lit(" docs"))).alias("path")).distinct()
    keywords = spark.createDataFrame([("commands", "RED"), ("features", "Blue"), ("none", "qqq")], "role string, keyword string")
    return mining.locate_folders(folders, keywords, "NF1")


@query("SELECT src, version AS found, version = '20.5.' || (src % 12) AS matches FROM p")
def version_guard(spark, sf):
    p = X.parts(spark, sf).withColumn("folder", F.concat(F.lit("UPF V"), "version", F.lit(" docs")))
    stated = F.concat(F.lit("20.5."), (F.col("src") % 12).cast("string"))
    return p.select("src", text.version_in(F.col("folder")).alias("found"), text.version_matches(F.col("folder"), stated).alias("matches"))


@query("SELECT '{' || string_agg('\"' || type || '\":' || n, ',' ORDER BY type) || '}' AS manifest FROM (SELECT type, count(*) AS n FROM objects GROUP BY type)")
def build_manifest(spark, sf):
    return mining.manifest(X.objects(spark, sf))


_MANIFESTS = f"""{PAGES} SELECT 'Command' AS layer, '{{"commands":' || (SELECT count(*) FROM pg) || ',"dangerous":' || (SELECT count(*) FROM pg WHERE src % 5 = 4) || ',"objects":' || (SELECT count(DISTINCT w) FROM pg) || '}}' AS manifest"""


@query(_MANIFESTS)
def command_manifest(spark, sf):
    return mining.command_manifest(_commands(spark, sf))


@query(f"""{PAGES} SELECT 'NF0@MMLCommand@' || name AS from_id, '参见' AS relation, 'NF0@MMLCommand@' || other AS to_id FROM pg WHERE other IS NOT NULL
    UNION SELECT 'NF0@MMLCommand@' || name, '类别', 'NF0@Kind@' || verb FROM pg""")
def extractor_edges(spark, sf):
    """Two extractors and one that fails, whose failure costs its own edges only."""

    def references(md, name):
        for line in md.splitlines():
            if line.startswith("- ref: ") and line != "- ref: none.":
                yield "参见", "MMLCommand@" + line[7:-1]

    def kinds(md, name):
        yield "类别", "Kind@" + name.split(" ")[0]

    def broken(md, name):
        raise ValueError(name)

    return mining.extracted_edges(_commands(spark, sf), "NF0", [references, kinds, broken])


# names, ids, slugs


@query("""SELECT src, src % 3 <> 0 AS valid_name, src % 4 = 1 AS unsafe, 'a_b' || src AS safe, CASE WHEN src % 2 = 0 THEN 'NF' || src END AS nf, CASE WHEN src % 2 = 0 THEN 'x@y' END AS local,
    CASE WHEN src % 2 = 0 THEN 'y' ELSE 'z' END AS label, local || ' x' AS obj, md5(local) AS m, sha256(local) AS s FROM p""")
def name_rules(spark, sf):
    src = F.col("src")
    p = X.parts(spark, sf)
    bundle = F.concat(F.lit("NF"), src, F.when(src % 3 == 0, " x").otherwise("_v1.0"))
    member = _one_of(("a/b.md", "../b.md", "a/..b/c.md", "a b.md"), src)
    id_ = F.when(src % 2 == 0, F.concat(F.lit("NF"), src, F.lit("@Type@x@y"))).otherwise("Type@z")
    parts = ids.split_logical_id(id_)
    return p.select(
        "src", text.valid_bundle_name(bundle).alias("valid_name"), text.unsafe_member(member).alias("unsafe"), text.safe_filename(F.concat(F.lit("a:b"), src)).alias("safe"),
        parts["nf"].alias("nf"), parts["local"].alias("local"), text.short_label(id_).alias("label"),
        telemetry.object_id_of_path(F.concat(F.lit("/api/v1/objects/"), F.url_encode(F.concat("local", F.lit(" x"))), F.lit("/md"))).alias("obj"), F.md5("local").alias("m"), F.sha2("local", 256).alias("s"),
    )


@query("""SELECT src, '增加' || local AS front, local AS bare, 'head' || chr(10) || chr(10) || '# T ' || src || chr(10) || 'end' AS clean,
    CASE WHEN src % 40 = 7 THEN '' ELSE 'GWFD-' || lpad((src % 40)::VARCHAR, 6, '0') END AS codes, 'http://e.org/a b' AS target, src % 5 = 0 AS listed FROM p""")
def text_rules(spark, sf):
    src = F.col("src")
    p = X.parts(spark, sf)
    md = _lines("head", "", "", "", "- [x](#x)", F.concat(F.lit("# [T "), src, F.lit("](#t)")), "end")
    codes = _lines(F.concat(F.lit("a GWFD-"), _six(src % 40), F.lit(" b")), "```", "GWFD-000001", "```", "- [GWFD-000002](#y)")
    return p.select(
        "src", F.concat(F.lit("增加"), "local").alias("front"), text.strip_zh_verb(F.concat(_one_of(("增加", "查询", "去激活"), src), "local")).alias("bare"), text.clean_markdown(md).alias("clean"),
        F.array_join(text.codes_in(codes, text.FEATURE_CODE, F.lit("GWFD-000007")), ",").alias("codes"), text.link_target(F.lit('http://e.org/a b#frag "title"')).alias("target"), (src % 5 == 0).alias("listed"),
    )


@query(f"""{_FAMILIES} SELECT 'ConfigObject' AS layer, '{{"objects":' || count(*) || ',"entity":' || count(*) FILTER (object_kind = 'entity') || ',"global_setting":' || count(*) FILTER (object_kind = 'global_setting') ||
    ',"query_target":' || count(*) FILTER (object_kind = 'query_target') || '}}' AS manifest FROM f""")
def object_manifest(spark, sf):
    return mining.object_manifest(mining.families(_commands(spark, sf)))


@query(f"""{LICENSES} SELECT 'License' AS layer, '{{"licenses":' || count(*) || ',"dangling":' || count(*) FILTER (NOT (place = 0 AND s % 50 IN (SELECT c_custkey % 40 FROM customer))) || '}}' AS manifest FROM lc""")
def license_manifest(spark, sf):
    """Licences, and those of them that name no feature that exists."""
    found = mining.licenses(license_pages(spark, sf))
    edges = mining.license_edges(found, mining.feature_documents(feature_pages(spark, sf)).select("code"), "NF0")
    return mining.license_manifest(found, found.select(F.concat(F.lit("NF0@License@"), "code").alias("from_id")).join(edges, "from_id", "left_anti"))


@query(f"""{FEATURES} SELECT 'Feature' AS layer, '{{"features":' || count(DISTINCT code) || ',"documents":' || count(*) || ',"overviews":' || count(*) FILTER (is_overview) || '}}' AS manifest FROM fd""")
def feature_manifest(spark, sf):
    return mining.feature_manifest(mining.feature_documents(feature_pages(spark, sf)))


@query("""SELECT layer, CASE layer WHEN 'Command' THEN 'Command' WHEN 'ConfigObject' THEN 'Command,ConfigObject' ELSE 'Command,License,Feature,Command' END AS steps,
    CASE layer WHEN 'ConfigObject' THEN 'ConfigObject needs Command' WHEN 'Feature' THEN 'Feature needs Command,Feature needs License' ELSE '' END AS notes, count(*) AS n
    FROM objects WHERE layer IN ('Command', 'ConfigObject', 'Feature') GROUP BY layer""")
def mining_scopes(spark, sf):
    """For the objects of each layer, what must be built if only that layer is asked for, in which order."""
    layers = [r.layer for r in X.objects(spark, sf).select("layer").distinct().collect()]  # a few names
    own = [x for x in layers if x in {b.layer for b in mining.MODES["5gc"].builders}]
    plans = [(x, ",".join(mining.building_steps(mining.scope_closure([x], set())[0])), ",".join(mining.scope_closure([x], set())[1])) for x in own]
    counts = X.objects(spark, sf).groupBy("layer").agg(F.count("*").alias("n"))
    return counts.join(spark.createDataFrame(plans, "layer string, steps string, notes string"), "layer").select("layer", "steps", "notes", "n")
