import re

import pytest
from pyspark.sql import functions as F

from graphloom.model import EDGES
from graphloom.operators import access, graph, maintenance, mining, reviews, search, telemetry

OBJ = "id string, version string, type string, layer string, nf string, domain string, scenario string, name string, name_zh string, source_path string, mtime double, raw_md string"


def obj(id_, version=None, **more):
    parts = id_.split("@")
    type_ = parts[-2]
    layer = {"MMLCommand": "Command", "ConfigObject": "ConfigObject", "Feature": "Feature"}.get(type_, "Business")
    row = {"id": id_, "version": version, "type": type_, "layer": layer, "nf": parts[0] if len(parts) == 3 else None, "domain": None, "scenario": None, "name": parts[-1], "name_zh": None, "source_path": f"{layer}/{id_}{version}.md", "mtime": 1.0, "raw_md": id_}
    return tuple((row | more).values())


@pytest.fixture(scope="module")
def bundle(spark):
    """A sample bundle: two network functions, two versions, one dangling edge."""
    U = "UDG@"
    objects = [
        obj(U + "MMLCommand@ADD URR", "20.15.2"), obj(U + "MMLCommand@ADD URR", "20.16.0"), obj(U + "MMLCommand@MOD URR", "20.16.0"), obj(U + "MMLCommand@SHOW URR", "20.16.0"),
        obj("UNC@MMLCommand@ADD URR", "20.16.0"), obj(U + "ConfigObject@URR", "20.15.2"), obj(U + "ConfigObject@URR", "20.16.0"), obj("UNC@ConfigObject@URR", "20.16.0"),
        obj(U + "Feature@FEAT-0001", "20.16.0"), obj("BusinessDomain@demo", domain="demo"), obj("NetworkScenario@s", domain="demo", scenario="s"), obj("ConfigurationSolution@s-online", domain="demo", scenario="s"),
    ]
    add, mod, urr = U + "MMLCommand@ADD URR", U + "MMLCommand@MOD URR", U + "ConfigObject@URR"
    edges = [
        (add, "20.15.2", "操作配置对象", urr), (add, "20.15.2", "参见", mod), (add, "20.16.0", "操作配置对象", urr), (add, "20.16.0", "参见", mod), (mod, "20.16.0", "操作配置对象", urr), (mod, "20.16.0", "参见", add),
        (U + "MMLCommand@SHOW URR", "20.16.0", "参见", U + "MMLCommand@NOPE"), ("UNC@MMLCommand@ADD URR", "20.16.0", "操作配置对象", "UNC@ConfigObject@URR"),
        (U + "Feature@FEAT-0001", "20.16.0", "依赖命令", add), (U + "Feature@FEAT-0001", "20.16.0", "依赖命令", mod), (U + "Feature@FEAT-0001", "20.16.0", "操作配置对象", urr),
        ("NetworkScenario@s", None, "方案", "ConfigurationSolution@s-online"), ("ConfigurationSolution@s-online", None, "涉及特性", U + "Feature@FEAT-0001"),
    ]
    return spark.createDataFrame(objects, OBJ).cache(), spark.createDataFrame(edges, EDGES).cache()


def test_sizes_and_dangling(bundle):
    objects, edges = bundle
    assert (objects.count(), objects.select("id").distinct().count(), edges.count()) == (12, 10, 13)
    assert [r["to_id"] for r in graph.dangling_edges(objects, edges).collect()] == ["UDG@MMLCommand@NOPE"] and graph.has_dangling(objects, edges)


def test_in_edge_counts(bundle):
    got = {r["id"]: r["in_degree"] for r in graph.degrees(bundle[1]).collect() if r["in_degree"]}
    assert got["UDG@ConfigObject@URR"] == 4 and got["UDG@MMLCommand@MOD URR"] == 3 and got["UDG@MMLCommand@ADD URR"] == 2 and got["UNC@ConfigObject@URR"] == 1


@pytest.mark.parametrize(
    "center, hops, nodes, links",
    [
        ("UDG@MMLCommand@ADD URR", 0, 1, 2), ("UDG@MMLCommand@ADD URR", 1, 3, 4), ("UDG@Feature@FEAT-0001", 1, 4, 7), ("UDG@Feature@FEAT-0001", 2, 4, 7),
        ("ConfigurationSolution@s-online", 1, 2, 4), ("NetworkScenario@s", 3, 1, 1), ("UDG@MMLCommand@ADD URR", -1, 1, 2),
    ],
)
def test_subgraphs(bundle, center, hops, nodes, links):
    found = graph.subgraph(*bundle, center, hops=hops)
    assert (found[0].count(), found[1].count()) == (nodes, links)


def test_unversioned_targets_on_demand(bundle):
    assert graph.subgraph(*bundle, "NetworkScenario@s", hops=2, expand_unversioned=True)[0].count() == 3


def test_filters_before_newest(spark):
    objects = spark.createDataFrame([obj("UDG@MMLCommand@ACT DEMO", "20.15.2", name_zh="激活演示"), obj("UDG@MMLCommand@ACT DEMO", "20.16.2"), obj("UDG@MMLCommand@OLD ONLY", "20.15.2"), obj("UNC@MMLCommand@SEM TRAP", "20.9.10"), obj("UNC@MMLCommand@SEM TRAP", "20.15.2")], OBJ)
    ids = lambda **f: sorted(r["id"].split("@")[2] for r in graph.list_objects(objects, **f).collect())
    assert ids(nf="UDG", version="20.15.2") == ["ACT DEMO", "OLD ONLY"] and ids(nf="UDG", version="20.16.2") == ["ACT DEMO"]
    assert ids(q="激活") == ["ACT DEMO"] and ids(layer="none") == [] and ids(type="MMLCommand", layer="none") == ["ACT DEMO", "OLD ONLY", "SEM TRAP"]
    row = graph.list_objects(objects, q="sem").first()
    assert row["version"] == "20.15.2" and row["versions"] == ["20.15.2", "20.9.10"]
    assert graph.page(graph.newest_per_id(objects), 1, 2).select("total").distinct().first()[0] == 3


def test_resolution(bundle, spark):
    asked = spark.createDataFrame([("UDG@MMLCommand@ADD URR", None), ("UDG@MMLCommand@ADD URR", "9"), ("nope", None), ("BusinessDomain@demo", None)], "id string, version string")
    got = {(r["id"], r["version"]): (r["status"], r["resolved_version"], r["available_versions"]) for r in graph.resolve(bundle[0], asked).collect()}
    assert got[("UDG@MMLCommand@ADD URR", None)] == ("ok", "20.16.0", ["20.15.2", "20.16.0"])
    assert got[("UDG@MMLCommand@ADD URR", "9")][0] == "unknown_version" and got[("nope", None)] == ("unknown_id", None, None)
    assert got[("BusinessDomain@demo", None)] == ("ok", None, [])


def test_batch_fetch_in_order_once(bundle, spark):
    asked = spark.createDataFrame([(0, "BusinessDomain@demo", None), (1, "nope", None), (2, "BusinessDomain@demo", None)], "position int, id string, version string")
    got = [(r["position"], r["status"], r["raw_md"]) for r in graph.batch_fetch(bundle[0], asked).orderBy("position").collect()]
    assert got == [(0, "ok", "BusinessDomain@demo"), (1, "unknown_id", None)]


LOG = "seq long, ts string, level string, caller string, endpoint string, obj_id string, obj_type string, user string, operator string"


def test_telemetry(spark):
    rows = [(i, f"2026-01-0{1 + i % 3}T10:00:00", "object", "skill", "/md", "F@1" if i < 3 else "C@1", "Feature" if i < 3 else "", "sk1", "EMP1" if i % 2 else "") for i in range(5)]
    rows += [(9, "bad", "object", "skill", "/domains", "", "T", "", ""), (10, "2026-01-01T00:00:00", "object", "web", "/md", "x", "x", "x", "x")]
    used = telemetry.qualifying(spark.createDataFrame(rows, LOG))
    assert telemetry.total(used).first()[0] == 6
    assert {r[0]: r[1] for r in telemetry.by_type(used).collect()} == {"Feature": 3, "?": 2, "T": 1}
    assert telemetry.top_ids(used).first()["obj_id"] == "F@1" and telemetry.by_operator(used).count() == 1
    assert [tuple(r) for r in telemetry.timeline(used).collect()] == [("01-01 10:00", 2), ("01-02 10:00", 2), ("01-03 10:00", 1)]


def test_cursor_advances_on_ties(spark):
    log = spark.createDataFrame([(i, "2026-01-01T00:00:00", *["x"] * 7) for i in range(5)], LOG)
    cursor, seen, rounds = "2026-01-01", [], 0
    while True:
        rows, more, cursor = telemetry.read_feed(log, cursor, 2)
        seen += [r["seq"] for r in rows]
        rounds += 1
        if not more:
            break
    assert seen == [0, 1, 2, 3, 4] and rounds == 3
    assert telemetry.read_feed(log, cursor, 2) == ([], False, cursor)


def test_reviews(spark):
    cases = spark.createDataFrame([("c1", "d", "s", "n"), ("c2", "d", "s", "n")], "id string, domain string, scenario string, name string")
    runs = spark.createDataFrame([("r1", "c1", "2026"), ("r2", "gone", "2025")], "id string, case_id string, run_at string")
    found = spark.createDataFrame([("R001", "r1", "通过"), ("R002", "r1", " ")], "id string, run_id string, verdict string")
    got = {r["id"]: (r["n_runs"], r["n_reviews"], r["latest_verdict"]) for r in reviews.case_rollup(cases, runs, found).collect()}
    assert got == {"c1": (1, 2, "未判定"), "c2": (0, 0, None)}
    assert [r["id"] for r in reviews.orphan_runs(cases, runs).collect()] == ["r2"]
    assert dict(reviews.next_review_id(runs, found).collect()) == {"r1": "R003", "r2": "R001"}


def test_permissions(spark):
    got = {p: spark.sql(f"select '{p}' p").select(access.required_permission(F.col("p"))).first()[0] for p in ("/api/v1/users/login", "/api/v1/users/x", "/api/v1/md", "/api/v1/objects", "/api/v1/fs/file", "/api/v1/mdx", "/md/x", "/api/v1/login")}
    assert list(got.values()) == [None, "admin", "skill", "frontend", "assets", "frontend", None, "frontend"]


def test_upsert_and_replace(bundle, spark):
    objects, edges = bundle
    new = objects.where("id = 'BusinessDomain@demo'").withColumn("name", F.lit("new"))
    merged = maintenance.upsert(objects, new)
    assert merged.count() == 12 and merged.where("name = 'new'").count() == 1
    own = spark.createDataFrame([("NetworkScenario@s", None)], "id string, version string")
    assert maintenance.replace_edges(edges, own, spark.createDataFrame([], EDGES)).count() == 12


def test_file_changes(spark):
    disk = spark.createDataFrame([("a", 1.0005), ("b", 2.5), ("n", 1.0)], "source_path string, mtime double")
    known = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("g", 1.0)], "source_path string, mtime double")
    assert dict(maintenance.changed_files(disk, known).collect()) == {"b": "changed", "n": "changed", "g": "deleted"}


def test_import_counts_rename_trash(spark):
    valid = spark.createDataFrame([("a", None), ("a", None), ("b", None), (None, "bad")], "path string, warning string")
    assert tuple(maintenance.import_counts(valid, spark.createDataFrame([("b",)], "path string")).first()) == (1, 2, 1)
    objects = spark.createDataFrame([("i", "1", "p", "see [[A]] and [[AB]]")], "id string, version string, source_path string, raw_md string")
    affected, all_rows = maintenance.rename_links(objects, "A", "Z")
    assert affected.count() == 1 and all_rows.first()["raw_md"] == "see [[Z]] and [[AB]]"
    trash = spark.createDataFrame([], "id string, original_path string, deleted_at string, deleted_by string, raw_md string")
    rest, trash = maintenance.soft_delete(objects, trash, objects, F.lit("t1"), F.lit("2026"), "me")
    assert rest.count() == 0 and maintenance.restore(rest, trash, trash)[0].count() == 1
    assert maintenance.restore(objects, trash, trash)[0].count() == 0


def test_unique_names_and_images(spark):
    images = spark.createDataFrame([("a/x.png", b"1"), ("b/x.png", b"2"), ("c/y.png", b"1")], "path string, content binary")
    assert {r["path"]: r["asset_name"] for r in maintenance.dedup_images(images).collect()} == {"a/x.png": "x.png", "b/x.png": "x_2.png", "c/y.png": "x.png"}


PAGES = [
    ("01.md", "# 增加URR（ADD URR）\n#### 命令功能\n增加。参见MOD URR。依次执行SET A、ADD URRINFO\n```\nDSP URR\n```\n- [x](#DSP URR)"),
    ("02.md", "# 修改URR（MOD URR）\nADD URR"), ("03.md", "# 查询URR（DSP URR）\n**[ADD URR](x（ADD URR）_1.md)**"), ("04.md", "# 设置A（SET A）"), ("05.md", "# 信息（ADD URRINFO）"), ("06.md", "# 概念"), ("07.md", "# 激活X（ACT X）"),
]


def test_command_mining(spark):
    commands = mining.command_pages(spark.createDataFrame(PAGES, "path string, md string"))
    assert commands.count() == 6
    refs = {(r["from_id"].split("@")[2], r["to_id"].split("@")[2]) for r in mining.reference_edges(commands, "U").collect()}
    assert refs == {("ADD URR", "MOD URR"), ("ADD URR", "SET A"), ("ADD URR", "ADD URRINFO"), ("MOD URR", "ADD URR"), ("DSP URR", "ADD URR")}
    assert {r["from_id"].split("@")[2] for r in mining.config_edges(commands, "U").collect()} == {"ADD URR", "MOD URR", "DSP URR", "SET A", "ADD URRINFO"}
    fam = {r["object"]: r for r in mining.families(commands).collect()}
    assert set(fam) == {"URR", "A", "URRINFO"} and fam["URR"]["name_zh"] == "URR" and fam["URR"]["members"] == ["ADD URR", "MOD URR", "DSP URR"]
    assert fam["A"]["object_kind"] == "global_setting" and fam["URR"]["description"].startswith("增加。")
    links = spark.createDataFrame([("ADD URR", ["MOD URR", "ADD URR", ""]), ("NOPE", ["A"])], "name string, refs array<string>")
    assert mining.external_edges(commands, links, "U").count() == 1


def test_longest_name_wins(spark):
    docs = spark.createDataFrame([("k", "LST ACLGROUP6 x LST ACLGROUP y XADD URR ADD URR_ ADD URR Z")], "key string, md string")
    names = spark.createDataFrame([("LST ACLGROUP",), ("LST ACLGROUP6",), ("ADD URR",), ("ADD URR Z",)], "name string")
    assert {r["name"] for r in mining.scan_names(docs, names).collect()} == {"LST ACLGROUP6", "LST ACLGROUP", "ADD URR Z"}


def test_feature_mining(spark):
    pages = [("GWFD-000001 甲/特性概述_1.md", "# 概述\nGWFD-000002 LKV100001 LKV999999"), ("GWFD-000001 甲/原理/说明_2.md", "# 说明\nGWFD-000009"), ("GWFD-000001 甲/配置/说明_3.md", "x"), ("GWFD-000002 乙/GWFD-000002 乙_4.md", "y"), ("none/x.md", "z")]
    docs = mining.feature_documents(spark.createDataFrame(pages, "path string, md string"))
    ids = {r["id"] for r in mining.feature_ids(docs, "U").collect()}
    assert ids == {"U@Feature@GWFD-000001", "U@Feature@GWFD-000001-原理-说明", "U@Feature@GWFD-000001-配置-说明", "U@Feature@GWFD-000002"}
    edges, dropped = mining.feature_edges(docs, "U", spark.createDataFrame([("LKV100001",)], "code string"))
    got = {(r["from_id"][10:], r["relation"], r["to_id"]) for r in edges.collect()}
    assert ("GWFD-000001", "依赖特性", "U@Feature@GWFD-000002") in got and ("GWFD-000001", "所需License", "U@License@LKV100001") in got
    assert sum(r[1] == "包含子文档" for r in got) == 2 and sum(r[1] == "属于特性" for r in got) == 2 and len(got) == 6
    assert dict(dropped.collect()) == {"feature": 1, "license": 1}
    assert mining.overview_counts(docs).count() == 0


def test_license_mining(spark):
    pages = spark.createDataFrame([("a/功能控制项_1.md", "#### [1 LKV100001 旧](#x)\nGWFD-000001"), ("b/资源控制项_1.md", "#### [2 LKV100001 新](#x)\nGWFD-000001 GWFD-000005")], "path string, md string")
    found = mining.licenses(pages)
    assert [(r["name"], r["item_type"]) for r in found.collect()] == [("新", "资源")]
    assert mining.license_edges(found, spark.createDataFrame([("GWFD-000001",)], "code string"), "U").count() == 1


def test_reference_rewriting(spark):
    docs = spark.createDataFrame([("k", "a [查询（LST ME）](x/查询（LST ME）_1.md) b [LST ME](y.md) [doc](z/own_2.md) [f](q/GWFD-000001 x.md) [gone](w.md) [web](http://e) ![i](p.png)"), ("n", "none")], "key string, md string")
    out = mining.rewrite_references(docs, "U", spark.createDataFrame([("LST ME",)], "name string"), spark.createDataFrame([("own_2.md", "U@Feature@F-own")], "filename string, id string"), spark.createDataFrame([("GWFD-000001",)], "code string"))
    got = {r["key"]: r for r in out.collect()}
    assert got["k"]["md"] == "a [[U@MMLCommand@LST ME]] b [[U@MMLCommand@LST ME]] [[U@Feature@F-own]] [[U@Feature@GWFD-000001]] gone [web](http://e) ![i](p.png)"
    assert (got["k"]["n_resolved"], got["k"]["n_stripped"], got["k"]["commands"], got["n"]["md"]) == (4, 1, ["LST ME"], "none")


def test_scope_and_folders(spark):
    assert mining.scope_closure(["Feature"], set()) == (["Command", "License", "Feature"], ["Feature needs Command", "Feature needs License"])
    assert mining.scope_closure(["Feature"], {"Command", "License"})[0] == ["Feature"]
    with pytest.raises(ValueError):
        mining.scope_closure(["Nope"], set())
    assert mining.building_steps(["Command", "Feature"]) == ["Command", "Feature", "Command"] and mining.building_steps(["License"]) == ["License"]
    with pytest.raises(ValueError):
        mining.register_mode("bad", mining.Mode("x", {}, (mining.Builder("A", ("B",)), mining.Builder("B"))))
    folders = spark.createDataFrame([("udg/命令参考",), ("unc/命令参考",), ("x/y",)], "path string")
    got = mining.locate_folders(folders, spark.createDataFrame([("Command", "命令参考")], "role string, keyword string"), "UDG").collect()
    assert [(r["path"], r["strict"]) for r in got] == [("udg/命令参考", True)]


def test_edits_keep_the_id(spark):
    rows = spark.createDataFrame([("a.md", "T@x", "---\nid: T@x\n---\nold"), ("b.md", "T@y", "---\nid: T@y\n---\n")], "source_path string, id string, raw_md string")
    done = {r["source_path"]: r["raw_md"] for r in maintenance.edit_document(rows, "a.md", "---\nid: T@x\n---\nnew").collect()}
    assert done["a.md"].endswith("new") and done["b.md"].endswith("---\n")
    with pytest.raises(Exception, match="cannot change"):
        maintenance.edit_document(rows, "a.md", "---\nid: T@z\n---\n").collect()


def test_one_job_of_a_kind(spark):
    jobs = spark.createDataFrame([("1", "mine", "running"), ("2", "import", "done")], "id string, kind string, status string")
    assert not maintenance.may_start(jobs, "mine") and maintenance.may_start(jobs, "import")
    assert maintenance.may_start(maintenance.drop_jobs(jobs, jobs.where("id = '1'")), "mine")


def test_names_in_parts_equal_names_at_once(spark):
    """However many parts the names are cut into, the longest name wins and matches do not overlap."""
    import random

    rng = random.Random(2)
    vocabulary = [f"W{i}" for i in range(12)]
    names = {" ".join(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(60)}
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "-", "\n", ", "]) for _ in range(80))
    docs = [(k % 20 if k else None, text()) for k in range(40)] + [(99, None), (98, "")]

    def brute(md):
        found = set()
        for line in (md or "").split("\n"):
            words = [(m.group(), m.start(), m.end()) for m in re.finditer("[A-Z0-9_]+", line)]
            i = 0
            while i < len(words):
                for j in range(len(words) - 1, i - 1, -1):
                    if line[words[i][1] : words[j][2]] in names and all(line[words[k][2] : words[k + 1][1]] == " " for k in range(i, j)):
                        found.add(line[words[i][1] : words[j][2]])
                        i = j
                        break
                i += 1
        return found

    expected = sorted({(k, n) for k, md in docs for n in brute(md)}, key=repr)
    df, known = spark.createDataFrame(docs, "key long, md string"), spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    for size in (1 << 20, 300):
        assert sorted(map(tuple, mining.scan_names(df, known, size).collect()), key=repr) == expected
    assert mining.scan_names(df, known.where("false")).collect() == []


def test_many_subgraphs_equal_single_ones(spark, bundle, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "NODE_EDGES", 1)  # so that nodes with two edges are split
    objects, edges = bundle
    ids = [r.id for r in objects.select("id").distinct().collect()]
    for hops, wide in ((1, False), (3, True)):
        many = graph.subgraphs(objects, edges, spark.createDataFrame([(i,) for i in [*ids, ids[0], "gone"]], "id string"), str(tmp_path / f"{hops}"), hops, wide)
        got = sorted(((r.centre, r.id, r.version, r.depth) for r in many.collect()), key=repr)
        single = [(i, r.id, r.version, r.depth) for i in ids for r in graph.subgraph(objects, edges, i, hops=hops, expand_unversioned=wide)[0].collect()]
        assert got == sorted(single, key=repr)


def test_search_by_index_equals_the_scan(spark, tmp_path):
    rows = [(f"NF@T@{a}{b}", f"Name {b}{a}", None if a == "x" else "增加" + a) for a in ("x", "ab", "É b") for b in ("aba", "", "zz")] + [("only", None, None)]
    objects = spark.createDataFrame(rows, "id string, name string, name_zh string")
    search.build_index(objects, str(tmp_path), 8)
    for q in ("ab", " ABA ", "aba", "é b", "增加", "加", "n", "", "name zz", "nf@t@", "none of it"):
        assert sorted(map(tuple, search.search(objects, str(tmp_path), q, 8).collect()), key=repr) == sorted(map(tuple, objects.where(graph.matches(q)).collect()), key=repr)
    plan = search.candidates(spark, str(tmp_path), "aba", 8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("#", " #").replace("bucket #", "bucket#") or "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1][:60]
