"""The pipeline's stages with odd rows, empty tables and clashing columns, and whole runs against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_queries import CLASHES, SF
from .test_texts import base_tokenizer, brute_join, brute_line_dedup

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def learned(spark):
    """Clean documents to learn languages from."""
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars")).collect()]


def odd(spark):
    english = next(t for _, t, lang, _, _ in learned(spark) if lang == "en" and len(t) > 200)
    long = " ".join([english] * 300)
    lines = "\n".join(f"the house of the {k} people" for k in ("old", "new", "other", "same", "first"))
    rows = [(None, english, None, None, None), (None, english, "en", "web", 1), (10**6, None, None, None, None), (10**6, None, "en", None, None), (10**6 + 1, "", "en", "web", 0), (10**6 + 2, " \n\t ", None, "web", 4)]
    rows += [(10**6 + 3, "1234 !? 56", "de", None, 10), (10**6 + 4, long, None, "books", len(long)), (10**6 + 4, long, None, "books", len(long)), (10**6 + 5, lines, "en", "web", len(lines)), (10**6 + 6, lines + "\nand the end of it", "en", None, None), (10**6 + 5, english, "en", "web", 7)]
    return rows


def test_language_stage_on_odd_rows(spark):
    docs = spark.createDataFrame(learned(spark) + odd(spark), SCHEMA)
    kept = Counter(map(tuple, STAGES["language_id"](spark, docs, SF).collect()))
    assert kept == Counter(r for r in map(tuple, docs.collect()) if any(c.isalpha() for c in r[1] or ""))
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert STAGES["language_id"](spark, nothing, SF).collect() == []


def test_line_stage_on_odd_rows(spark):
    rows = odd(spark)
    found = STAGES["line_dedup"](spark, spark.createDataFrame(rows, SCHEMA).coalesce(1), SF).collect()
    numbered = [((r[0] is not None, r[0] or 0, k), r[1]) for k, r in enumerate(rows)]
    expected = [(key, text) for key, text, _, removed in brute_line_dedup_of(numbered) if not removed or text.strip()]
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter((rows[key[2]][0], text) for key, text in expected)
    assert all(r["n_chars"] == len(r["text"]) for r in found if r["doc_id"] == 10**6 + 6)


def brute_line_dedup_of(numbered):
    """``brute_line_dedup`` for rows with keys of any kind, in their order."""
    order = sorted(numbered)
    return [(order[k][0], text, n, removed) for k, (_, text, n, removed) in enumerate(brute_line_dedup([(k, t) for k, (_, t) in enumerate(order)]))]


def test_group_stage_on_odd_rows(spark):
    rows = odd(spark)
    found = STAGES["ngram_join"](spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    groups = {k: (n, c) for k, n, c, _ in brute_join([(k, r[1]) for k, r in enumerate(rows)])}
    members: dict[int, list[int]] = {}
    for k, (n, c) in groups.items():
        members.setdefault(c, []).append(k)
    assert len(found) == len(members)
    left = Counter((r["doc_id"], r["text"]) for r in found)
    for own in members.values():
        best = min(own, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
        assert left[rows[best][0], rows[best][1]] >= 1


def test_mix_and_tokens_on_odd_rows(spark):
    rows = odd(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    mix = STAGES["mix_sources"](spark, docs, SF)
    texts = {r[1] for r in rows if r[1]}
    assert all(any(t.startswith(r["text"]) for t in texts) and r["text"].split() for r in mix.collect()) and mix.count() > 0
    enc = base_tokenizer()
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in STAGES["bpe"](spark, docs, SF).collect())
    assert got == Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t, *_ in rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables_and_clashing_columns(spark, name):
    docs = spark.createDataFrame(learned(spark)[:60] + odd(spark), SCHEMA)
    empty = STAGES[name](spark, docs.where("false"), SF)
    assert empty.collect() == [] and (name == "bpe" or empty.columns == docs.columns)
    extra = [c for c in [*CLASHES, "_row_key", "_row_key_", "row", "labels", "node", "_words", "piece"] if c not in docs.columns]
    wide = docs.withColumns({c: F.lit("x") for c in extra})
    found = STAGES[name](spark, wide, SF)
    if name != "bpe":
        assert found.columns == wide.columns and found.where(" or ".join(f"`{c}` <> 'x'" for c in extra)).isEmpty()
    plain = STAGES[name](spark, docs, SF)
    assert Counter(map(repr, plain.collect())) == Counter(map(repr, found.select(*plain.columns).collect()))


def test_whole_run_equals_its_stages(spark, tmp_path):
    docs = spark.createDataFrame(learned(spark) + odd(spark), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        step = spark.read.parquet(str(tmp_path / f"s{k}"))
    assert got == Counter((r["doc_id"], r["ids_sha256"]) for r in step.collect()) and sum(got.values()) > 100
