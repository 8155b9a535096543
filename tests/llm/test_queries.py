"""The registered queries against SQL over the smallest tables, and clashing columns and empty tables for all of them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = {"op1_embedding_dedup": "embeddings", "op2_vector_search": "embeddings", "op3_warc": "pages", "op11_vector_codes": "embeddings", "op12_chat_format": "conversations"}


def same(con, sql, path):
    expected = con.sql(sql)
    columns = ",".join(f'"{c}"' for c in sorted(expected.columns))
    a = con.sql(f"select {columns} from ({sql})").fetchall()
    b = con.sql(f"select {columns} from '{path}/*.parquet'").fetchall()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(name, spark, tmp_path):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    queries.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    same(con, queries.oracle_sql()[name], tmp_path / "out")


#: Names that the operators use inside; extra columns that have them change nothing.
CLASHES = "links cid component a b row place part block bucket size key text_key class kept copies n_lines _at _id _key _own_key _row _size _cut _words path offset url_key target law shard lang_pred ids dim turn code error n top head tail score words phrase segment seq step kind message alone".split()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_clashing_columns_and_empty_tables(name, spark, tmp_path):
    table = TABLES.get(name, "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet").limit(40)
    rows.write.parquet(str(tmp_path / f"plain/{table}.parquet"))
    rows = spark.read.parquet(str(tmp_path / f"plain/{table}.parquet"))
    rows.withColumns({c: F.lit("x") for c in CLASHES if c not in rows.columns}).write.parquet(str(tmp_path / f"wide/{table}.parquet"))
    rows.where("false").write.parquet(str(tmp_path / f"empty/{table}.parquet"))
    query = queries.queries()[name]
    plain = query(spark, str(tmp_path / "plain"))
    wide = query(spark, str(tmp_path / "wide")).select(*plain.columns)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, wide.collect()))
    rest = query(spark, str(tmp_path / "empty")).collect()
    assert [r.conv_id for r in rest] == [-1] if name == "op12_chat_format" else rest == []
