"""Every registered query against a second engine, over the smallest tables."""

import json
import os
import re

import duckdb
import pytest

from graphloom.operators import mining
from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(name, spark, duck, tmp_path):
    catalog.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    expected = duck.sql(catalog.oracle_sql()[name])
    columns = ",".join(f'"{c}"' for c in sorted(expected.columns))
    a = duck.sql(f"select {columns} from ({catalog.oracle_sql()[name]})").fetchall()
    b = duck.sql(f"select {columns} from '{tmp_path}/out/*.parquet'").fetchall()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(name, spark):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_problems_hold_whole_texts(spark, tmp_path):
    texts = ["short", "long " * 400 + "end", "one\ntwo\n\nthree " + "x" * 100 + "\r\nlast", None]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))

    def brute(t):
        md = "# R\n### 问题 1\n- 描述: " + re.sub(r"[\r\n]+", " ", t) + "\n- 归因: a，b、c\n- 涉及对象: [[A@B@C]] [[D]]\n"
        field = {x: re.search(rf"^\s*[-*]\s*{x}\s*[:：]\s*(.+?)\s*$", md, re.M)[1] for x in ("描述", "归因", "涉及对象")}
        return [{"description": field["描述"], "attribution": re.split("[,，、]", field["归因"]), "objects": re.findall(r"\[\[([^\]]+)\]\]", field["涉及对象"])}]

    got = {r["conv_id"]: r["problems"] and json.loads(r["problems"]) for r in catalog.queries()["extract_problems"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else brute(t) for i, t in enumerate(texts)}
    assert [len(got[i][0]["description"].split()) for i in (1, 2)] == [401, 5]


def test_dictionary_scan_equals_brute_force(spark):
    docs = {r["doc_id"]: (r["text"] or "").upper() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    words = [re.findall("[A-Z0-9_]+", r["text"].upper()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = {" ".join(w[:n]) for w in words for n in range(2, 7) if len(w) >= n}
    by_length = re.compile(r"(?<![A-Z0-9_])(?:" + "|".join(sorted(map(re.escape, names), key=len, reverse=True)) + r")(?![A-Z0-9_])")
    expected = {(i, x) for i, t in docs.items() for line in t.split("\n") for x in by_length.findall(line)}
    got = {tuple(r) for r in catalog.queries()["dictionary_scan"](spark, SF).select("key", "name").collect()}
    assert got == expected and max(len(x.split(" ")) for _, x in got) == 6


def test_names_of_any_length_are_found(spark):
    long_name = " ".join(f"W{k}" for k in range(9))
    docs = spark.createDataFrame([("k", f"a {long_name} b W0 W1")], "key string, md string")
    found = mining.scan_names(docs, spark.createDataFrame([(long_name,), ("W0 W1",), ("W3",)], "name string")).collect()
    assert {r["name"] for r in found} == {long_name, "W0 W1"}


def test_doc_ref_rewrite_equals_brute_force(spark):
    rows = catalog.X.commands(spark, SF).collect()
    sources = {}
    for r in rows:
        if r["src"] % 3:
            sources[r["src"]] = min(sources.get(r["src"], r["id"]), r["id"])
    features = {r["src"] for r in rows if r["src"] % 2 == 0}
    expected = {}
    for r in rows:
        page = f"[[{sources[r['src']]}]]" if r["src"] in sources else "page"
        feature = f"[[NF0@Feature@GWFD-{r['src']:06d}]]" if r["src"] in features else "feature"
        n = 1 + (r["src"] in sources) + (r["src"] in features)
        expected[f"{r['id']}@{r['version']}"] = (f"See [[NF0@MMLCommand@{r['local']}]] and gone and [web](http://e.org) and {page} and {feature}", n, 4 - n, r["local"])
    got = {r["key"]: (r["md"], r["n_resolved"], r["n_stripped"], r["commands"]) for r in catalog.queries()["doc_ref_rewrite"](spark, SF).collect()}
    assert got == expected and {n for _, n, _, _ in got.values()} == {1, 2, 3}


def test_positions_take_no_single_task(spark):
    ids = spark.range(0, 5000, 1, 8).selectExpr("concat('n', id * 7919 % 5000) as id")
    numbered = catalog._positions(ids, "id")
    assert [tuple(r) for r in numbered.orderBy("position").collect()] == list(enumerate(sorted(r["id"] for r in ids.collect())))
    plan = catalog.queries()["batch_md"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_rows_that_take_long_are_dealt_out(spark):
    """A table of few bytes is one row group, so one task would have all its pages."""
    from graphloom.plans import mining_queries, page_queries, source_queries

    for query in (page_queries.html_nested, page_queries.wide_spans, source_queries.html_fragments, mining_queries.command_fields, mining_queries.loose_titles):
        found = query(spark, "/root/testdata/sf0.001")
        assert found.rdd.getNumPartitions() >= 16, query.__name__
