"""Archives, mixes, shards and the pipeline against brute force."""

import gzip
import hashlib
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import mixing, sharding, warc
from graphloom.llm.shared import Workspace

from .test_queries import SF, same
from .test_texts import base_tokenizer

PAGES = [(5, "http://a.example.com/x?y=1", "<p>" + "é" * 200), (3, "http://b.example.com/", "<p>" + "é" * 200), (7, None, "<p>" + "é" * 200), (8, "http://a.example.com/x?y=1", "short"), (9, "no url at all", "short"), (1, "http://a.example.com/z", None), (2, "http://ü.example.com/ä b", ""), (None, "http://n.example.com/", "<p>" + "é" * 200), (11, "http://[bad", "x" * 300_000), (11, "http://[bad", "x" * 300_000), (12, "http://q.example.org:8080/", "\0\r\n\r\nWARC/1.1\r\n" * 20)]


@pytest.mark.parametrize(("broadcast", "archive_bytes"), [(200_000, 8 << 20), (0, 300)])
def test_archive_round_trip(spark, monkeypatch, broadcast, archive_bytes):
    """Revisits by either join, archives of many records or of few."""
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", broadcast)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    got = warc.archive_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()
    expected = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        first = min((p for p, _, h in PAGES if p is not None and (h or "").encode() == data), default=None)
        revisit = len(data) >= 100 and i is not None and i != first
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else data))
    assert sorted(repr((*list(r)[:5], None if r["payload"] is None else bytes(r["payload"]))) for r in got) == sorted(map(repr, expected))


def test_index_and_files(spark, tmp_path, monkeypatch):
    """The archives are gzip files that any reader opens; a look-up reads the blocks of its own keys only."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/p{i}", f"<p>{i}") for i in range(100)], "page_id long, url string, html string")
    work = Workspace(spark, "test")
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, work)
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "archives").glob("part-*"))
    assert whole.count(b"WARC/1.1\r\n") == 100
    index = warc.build_index(spark, path, work)
    assert index.directory.agg(F.max("lines")).first()[0] <= 3 and "data" not in index.directory.columns
    wanted = spark.createDataFrame([("http://h3.example.com/p10",), ("http://nowhere/",)], "url string")
    assert [r["page_id"] for r in warc.read_captures(spark, path, warc.look_up(index, wanted)).collect()] == [10]


def test_look_up_of_a_url_in_very_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = spark.createDataFrame([(i, "http://same.example.com/" if i % 3 else f"http://h{i}.example.com/", f"<p>{i}") for i in range(300)], "page_id long, url string, html string")
    work = Workspace(spark, "test")
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, work)
    assert all(p.stat().st_size < 3000 for p in (tmp_path / "archives").glob("part-*"))  # bytes bound an archive
    index = warc.build_index(spark, path, work)
    wanted = spark.createDataFrame([("http://same.example.com/",), ("http://h3.example.com/",), (None,)], "url string")
    found = sorted(r["page_id"] for r in warc.read_captures(spark, path, warc.look_up(index, wanted)).collect())
    assert found == sorted([i for i in range(300) if i % 3] + [3])


def test_url_key():
    assert warc.url_key("http://a.example.com/x?y") == "com,example,a)/x?y"


def brute_mix(rows):
    """(target by source, words taken by source)."""
    size = Counter()
    for _, t, s in rows:
        size[s] += len(mixing_words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, float(sum(size.values())), set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * size[s]}
        for s in over or open_:
            target[s] = 3.0 * size[s] if over else share * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    return size, target


def mixing_words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_mix(spark):
    rows = [(i, " ".join(f"v{k}" for k in range(i % 40)), "abc"[i % 3] if i % 10 else ("tiny" if i == 20 else None)) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "empty"), (None, "x y z", "a"), (None, "x y z", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(docs).collect()
    size, target = brute_mix(rows)
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 2 for s in size)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_plan(docs.repartition(7)).collect()))
    plan = {r["doc_id"]: r["taken"] for r in got if r["doc_id"] is not None}
    mixed = Counter()
    for r in mixing.mixed_documents(docs.withColumn("_size", F.lit("x"))).collect():
        assert r["_size"] == "x"
        mixed[r["doc_id"]] += len(mixing_words(r["text"]))
    assert {i: n for i, n in plan.items() if n} == {i: n for i, n in mixed.items() if i is not None and n}


def brute_flow(counts, preferences, bounds):
    """Rows one by one, in rounds."""
    left, room = list(counts), list(bounds)
    out = Counter()
    for k in range(len(bounds)):
        for segment, order in enumerate(preferences):
            while left[segment] and room[order[k]]:
                left[segment] -= 1
                room[order[k]] -= 1
                out[segment, order[k]] += 1
    return out


@pytest.mark.parametrize("shards", [8, 3])
def test_shards(spark, shards):
    rows = [(i, None if i % 50 == 0 else "é" * (i % 9)) for i in range(997)] + [(5, "same")] * 40 + [(None, "n")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_rows(docs, shards).collect()
    import zlib

    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = Counter(r["shard"] for r in got)
    assert len(counts) == shards and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_flows_equal_one_by_one_and_move_little():
    preferences = sharding.ring_preferences(4, 16, 64)
    counts = [(k * 37) % 23 for k in range(64)]
    bounds = [math.ceil(sum(counts) / 4)] * 4
    flows = Counter()
    for segment, first, end, shard, _ in sharding.bounded_flows(counts, preferences, bounds):
        flows[segment, shard] += end - first
    assert flows == brute_flow(counts, preferences, bounds)
    grown = sharding.ring_preferences(5, 16, 64)
    assert all(new[0] in (old[0], 4) for old, new in zip(preferences, grown))  # a new shard takes, the others keep


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from graphloom.llm import line_dedup, mixing, ngram_join

    def written(name, df):
        df.write.parquet(str(tmp_path / name))
        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{tmp_path}/{name}/*.parquet'")
        return spark.read.parquet(str(tmp_path / name)), con

    stages = dict(corpus_pipeline.STAGES)
    one, con1 = written("one", stages["language_id"](spark, docs, SF))
    kept = {r["doc_id"] for r in one.collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    two, con2 = written("two", stages["line_dedup"](spark, one, SF))
    sql = f"select doc_id, text from ({line_dedup.DEDUP_SQL}) where n_removed = 0 or trim(text) <> ''"
    same(con1, sql, tmp_path / "two") if set(two.columns) == {"doc_id", "text"} else None
    assert sorted(con1.sql(sql).fetchall(), key=repr) == sorted(((r["doc_id"], r["text"]) for r in two.collect()), key=repr)
    three, con3 = written("three", stages["ngram_join"](spark, two, SF))
    assert {r["doc_id"] for r in three.collect()} == {x for (x,) in con2.sql(f"select doc_id from ({ngram_join.JOIN_SQL}) where kept").fetchall()}
    four, _ = written("four", stages["mix_sources"](spark, three, SF))
    taken = Counter()
    for r in four.collect():
        taken[r["doc_id"]] += len(mixing_words(r["text"]))
    assert taken == {i: n for i, n in con3.sql(f"select doc_id, taken from ({mixing.MIX_SQL}) where taken > 0").fetchall()}
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    enc = base_tokenizer()
    five = sorted((r["doc_id"], r["ids"]) for r in stages["bpe"](spark, four, SF).collect())
    assert five == sorted((r["doc_id"], enc.encode_ordinary(r["text"])) for r in four.collect())


def test_rows_with_null_or_repeated_ids_are_documents_of_their_own(spark):
    """Of each group of copies one row stays, whatever the ids; a clean text that shares its id with a copy stays."""
    copy, near, clean, other = (" ".join(f"{w}{k}" for k in range(60)) for w in ("copy", "near", "clean", "other"))
    rows = [(1, copy), (7, copy), (7, clean), (None, copy), (None, near), (None, near), (5, other), (5, other), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    left = sorted(map(tuple, stages["ngram_join"](spark, docs, SF).collect()), key=repr)
    assert left == sorted([(1, copy), (7, clean), (None, near), (5, other), (None, None), (9, "")], key=repr)
    lines = "\n".join(f"line {k}" for k in range(6))
    docs = spark.createDataFrame([(None, lines), (None, lines), (3, lines), (4, "\n".join("abcd")), (4, "\n".join("abcd"))], "doc_id long, text string")
    left = sorted((r["text"] for r in stages["line_dedup"](spark, docs, SF).collect()), key=repr)
    assert left == sorted([lines, "\n".join("abcd")], key=repr)


def test_very_long_texts(spark):
    """A text of 600,000 words beside short ones: mixed, put into shards and told its language like any other."""
    from graphloom.llm import language

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang in ('en', 'de')").select("doc_id", "text", "lang", "source")
    english = next(r["text"] for r in docs.collect() if r["lang"] == "en" and len(r["text"]) > 100).split()
    words = (english * (600_000 // len(english) + 1))[:600_000]
    rows = [(10**7, " ".join(words), None, "long"), (10**7 + 1, "x" * 1_000_000, None, "long")]
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).persist()
    plan = {r["doc_id"]: r for r in mixing.mix_plan(docs).collect()}
    assert plan[10**7]["size"] == 600_000 and plan[10**7 + 1]["size"] == 1
    taken = sum(r["taken"] for r in plan.values() if r["doc_id"] >= 10**7)
    assert abs(taken - plan[10**7]["target"]) <= 2
    mixed = [len(mixing_words(r["text"])) for r in mixing.mixed_documents(docs).where("doc_id = 10000000").collect()]
    assert sum(mixed) == plan[10**7]["taken"]
    shards = {r["doc_id"]: r["size"] for r in sharding.shard_rows(docs).collect()}
    assert shards[10**7] == len(rows[0][1]) + 1 and shards[10**7 + 1] == 1_000_001 and len(shards) == docs.count()
    told = {r["doc_id"]: r["lang_pred"] for r in language.predict_languages(docs).collect()}
    assert told[10**7] == "en" and len(told) == docs.count()
    docs.unpersist()


def test_equal_rows_are_cut_into_pieces(spark, monkeypatch):
    """Very many equal rows, and rows without id, get slots from several tasks, each slot once."""
    monkeypatch.setattr(sharding, "EQUAL_ROWS", 7)
    rows = [(5, "same")] * 300 + [(None, f"text {k % 40}") for k in range(200)] + [(k, "x") for k in range(50)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t) + 1) for i, t in rows)


def test_components_without_hot_nodes(spark, monkeypatch):
    """Stars, chains and cliques, with hubs joined by broadcast and without."""
    import random

    from graphloom.llm import shared

    rng = random.Random(5)
    pairs = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(200)] + [(5000, k) for k in range(2000, 2300)] + [(2299, 5001), (7, 7)]
    pairs += [tuple(rng.sample(range(9000, 9300), 2)) for _ in range(400)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    for most in (3, 256):
        monkeypatch.setattr(shared, "MOST_EDGES", most)
        work = Workspace(spark, "test")
        got = {r["node"]: r["component"] for r in shared.components(work, spark.createDataFrame(pairs, "a long, b long"), "c").collect()}
        assert got == {x: root(x) for x in linked}


def test_no_shared_folder_on_a_cluster(monkeypatch, spark):
    from types import SimpleNamespace

    from graphloom.llm import shared

    conf = SimpleNamespace(get=lambda *_: None)
    for master, good in (("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("spark://h:7077", False), ("yarn", False)):
        fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
        if good:
            assert shared.shared_dir(fake).startswith("file://")
        else:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                shared.shared_dir(fake)
