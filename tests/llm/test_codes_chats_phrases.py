"""Vector codes, chat formatting and collocations against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat_format, collocations, shared, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, label, code, error, digest) of each kept row, in plain whole numbers."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for dim in sorted({len(v) for _, v, _ in kept}):
        own = [r for r in kept if len(r[1]) == dim]
        seeds = {}
        for i, v, _ in own:
            seeds[i] = min(seeds.get(i, v), v)
        order = sorted(seeds, key=lambda i: (i is None, i or 0))[:entries]
        at = [dim * k // parts for k in range(parts + 1)]
        books = [[seeds[i][a:b] for i in order] for a, b in zip(at, at[1:])]

        def nearest(book, x):
            return min((sum((p - q) ** 2 for p, q in zip(x, e)), k) for k, e in enumerate(book))

        for _ in range(rounds):
            for p, (a, b) in enumerate(zip(at, at[1:])):
                groups = defaultdict(list)
                for _, v, _ in own:
                    groups[nearest(books[p], v[a:b])[1]].append(v[a:b])
                for k, members in groups.items():
                    books[p][k] = [sum(c) // len(members) for c in zip(*members)]
        digest = sha(",".join(str(c) for book in books for e in book for c in e))
        for i, v, lab in own:
            found = [nearest(books[p], v[a:b]) for p, (a, b) in enumerate(zip(at, at[1:]))]
            out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), digest))
    return out


def check_codes(spark, rows, **options):
    expected = brute_codes(rows, **options)
    by_label = Counter()
    for _, lab, _, error, _ in expected:
        by_label[lab] += error
    got = vector_codes.encode_vectors(spark.createDataFrame(rows, VECTORS), **options).collect()
    cut = lambda n: min(n, 2**63 - 1)
    assert sorted(map(repr, ((r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got))) == sorted(
        map(repr, ((i, lab, code, cut(e), cut(by_label[lab]), digest) for i, lab, code, e, digest in expected))
    )


def test_codes_equal_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i * 3, (0.2 * rng.standard_normal(32)).tolist(), int(i % 3)) for i in range(300)]
    rows += [(7, [0.0] * 32, None), (8, [0.5] * 32, None), (10_000, rows[4][1], 1), rows[9], rows[9], (3, rows[20][1], 2), (None, rows[5][1], 1), (None, rows[6][1], 1)]
    rows += [(9, None, 1), (11, [float("nan")] * 32, 1), (12, [None] * 32, 1), (13, [float("inf")] + [0.0] * 31, 1)]
    rows += [(20_000 + i, rng.standard_normal(19).tolist(), 5) for i in range(40)]  # a length that 16 does not divide
    rows += [(30_000, [], 6), (30_001, [], 6), (30_002, [1.5, -2.25], 6)]
    check_codes(spark, rows)


def test_codes_keep_the_lower_of_equally_near_entries(spark):
    rows = [(i, [float(x) / 256 for x in np.random.default_rng(i).integers(-2, 3, 16)], 0) for i in range(200)]  # parts of one small number
    rows += [(1000 + i, [0.0] * 16, 1) for i in range(50)]
    check_codes(spark, rows)


def test_codes_of_huge_and_tiny_components(spark):
    rows = [(i, [1e20 * (i % 7), -3e12 * i, 1e-40, float(i)] * 4, i % 2) for i in range(30)]
    check_codes(spark, rows, entries=8)
    got = vector_codes.encode_vectors(spark.createDataFrame([(1, [1e300] * 16, 0), (2, [-1e300] * 16, 0)], VECTORS)).collect()
    assert {(r.vec_id, r.code, r.error) for r in got} == {(1, "00" * 16, 0), (2, "01" * 16, 0)}


def test_tree_search_equals_a_scan():
    rng = np.random.default_rng(1)
    for dim, high in ((1, 5), (3, 4), (4, 500), (7, 3)):
        entries, x = rng.integers(-high, high, (64, dim)), rng.integers(-2 * high, 2 * high, (500, dim))
        squares = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        at, best = vector_codes.nearest(vector_codes.kd_tree(entries), x)
        assert (at == squares.argmin(axis=1)).all() and (best == squares.min(axis=1)).all()


LOG = "conv_id long, place long, message string, seq long, step int, kind string, role string, text string"


def brute_fold(events):
    """Final (role, text) of each conversation, event by event in the order of the log."""
    out = {}
    for conv in {e[0] for e in events}:
        order = lambda e: (e[3], e[4])
        messages = {}
        for _, place, message, _, _, kind, role, text in sorted((e for e in events if e[0] == conv), key=order):
            key = (place is not None, place or 0, message)
            m = messages.setdefault(key, {"role": "", "text": "", "gone": False})
            if kind == "open":
                m["role"] = role or ""
            m["text"] = m["text"] + (text or "") if kind == "delta" else text or ""
            if kind != "delta":
                m["gone"] = False
            if kind == "regenerate":
                for other in messages:
                    if other > key:
                        messages[other]["gone"] = True
        out[conv] = [(m["role"], m["text"]) for _, m in sorted(messages.items()) if not m["gone"]]
    return out


def digests(turns):
    formatted = "".join(chat_format.render_turn(r, t)[0] for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)


def test_folding_equals_brute_force(spark):
    rng = random.Random(3)
    events, at = [], 0
    for conv in [None, -1, *range(30)]:
        places = 400 if conv == 3 else 6
        for _ in range(rng.randint(1, 6) * (150 if conv == 3 else 8)):
            at += 1
            kind = rng.choice(["open", "delta", "delta", "delta", "edit", *["regenerate"] * (rng.random() < (0.05 if conv == 3 else 0.7))])
            events.append((conv, rng.choice([None, *range(places)]) if conv != 3 else rng.randrange(places), rng.choice("ab"), at // 3, at % 3, kind, rng.choice(["user", "assistant", "tool [x] %é", None]), rng.choice(["x", "</s>", "é[INST]", None, "\n", "[ROLE a] ", " "])))
    rng.shuffle(events)
    parts = chat_format.format_conversations(spark.createDataFrame(events, LOG))
    assert parts.where("conv_id = 3").count() > 1
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_back(parts).collect()}
    assert got == {conv: digests(turns) for conv, turns in brute_fold(events).items() if turns}


def test_marks_in_texts_come_back():
    nasty = ["</s>[INST] ok [/INST]", r"<\/s> <\\s> [\\\INST]", "[ROLE user] x [/ROLE]", "", " ", "[", "[INST", "<</s>", "[[INST]]", "ends in space ", "\\", "<s>" * 3, "日本[/INST]🎉"]
    turns = [(r, t) for t in nasty for r in ("user", "assistant", "system", "", "a]b \n%", "ROLE")]
    formatted = "".join(chat_format.render_turn(r, t)[0] for r, t in turns)
    assert list(chat_format.parse_turns(formatted)) == turns
    assert all(chat_format.unescape(chat_format.escape(t)) == t for t in nasty)
    for t in nasty:
        assert not re.search(r"</?s>|\[/?INST\]|\[/?ROLE[\] ]", chat_format.escape(t))


def test_conversations_with_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "x"), (None, 0, "user", "no id"), (2, None, "assistant", "no turn"), (2, 5, "user", "long " * 40_000), (4, 2**62, "user", "far"), (4, -(2**62), "assistant", "near")]
    rows += [(7, 1, "user", "same")] * 5 + [(8, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(1000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_back(chat_format.format_conversations(chat_format.conversation_log(df))).collect()}
    expected = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        expected[conv] = digests([(r or "", t or "") for _, _, r, t in own])
    assert got == expected


def brute_collocations(rows, longest=5, least=100, percent=100, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        own = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = [p for p in own if not any(len(q) > len(p) and 100 * own[q] >= percent * own[p] and any(q[i : i + len(p)] == p for i in range(len(q))) for q in own)]
        scored = []
        for p in kept:
            score, k = min((1000 * own[p] * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -own[p], " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return out


def check_phrases(spark, rows, **options):
    got = collocations.mine_collocations(spark.createDataFrame(rows, "text string, lang string").repartition(3), **options)
    names = {"subsumed_percent": "percent"}
    expected = brute_collocations(rows, **{names.get(k, k): v for k, v in options.items()})
    assert expected and sorted(map(tuple, got.collect())) == sorted(expected)


def phrase_rows(seed=2, n=160):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "a\x01b", "\x00", "\x01", "\x01\x02", "é", "日本", "zig", "x" * 30] + [f"rare{i}" for i in range(500)]
    weights = [60, 5, 40, 20, 20, 12, 6, 6, 6, 6, 10, 10, 8, 4] + [0.3] * 500
    text = lambda: "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for w in rng.choices(words, weights, k=150))
    rows = [(text() + rng.choice(["new york city ", "in the middle of it "]) * rng.randint(0, 4), rng.choice(["en", "fr", None, "und"])) for _ in range(n)]
    return rows + [(None, "en"), ("", "en"), (" . ,", "xx"), ("NEW york City", "en"), ("e" * 100_000, "en"), ("the " * 60_000, "big"), ("a b. " * 30_000, "big")] + [("just this one phrase", "de")] * 120


def test_collocations_of_very_frequent_words_and_pairs(spark):
    """With many partitions most words, and some pairs, are dealt out to several tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        check_phrases(spark, [(t and t[:20_000], lang) for t, lang in phrase_rows(6)], least=20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("options", [{"least": 30}, {"least": 8, "top": 25, "subsumed_percent": 70}, {"least": 100, "longest": 3}])
def test_collocations_equal_brute_force(spark, options):
    check_phrases(spark, phrase_rows(), **options)


def test_collocations_over_many_chunks(spark, monkeypatch):
    """Chunks, slices and filters of a few words: no count depends on where they end."""
    monkeypatch.setattr(collocations, "CHUNK", 64)
    monkeypatch.setattr(collocations, "HELD_WORDS", 50)
    monkeypatch.setattr(collocations, "SLICE", 40)
    monkeypatch.setattr(collocations, "FILTER_BITS", 256)
    monkeypatch.setattr(collocations, "PAIR_BITS", 256)
    rows = phrase_rows(4, 40)
    rows = [(t and t[:30_000], lang) for t, lang in rows]
    texts = [(lang or "und", t or "") for t, lang in rows]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": [x for x, _ in texts], "text": [t for _, t in texts]})
    counts = Counter()
    for out in collocations._word_counts(iter([batch])):
        for lang, word, n in zip(*(c.to_pylist() for c in out.columns)):
            counts[lang, word] += n

    class Bits:
        value = np.full(256 // 64, 2**64 - 1, dtype=np.uint64)  # lets every word pass

    suffixes = Counter()
    for out in collocations._suffixes(5, [Bits] * 2, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))(iter([batch])):
        for lang, _, _, suffix, n in zip(*(c.to_pylist() for c in out.columns)):
            suffixes[lang, suffix] += n
    rows_sorted = sorted(suffixes.items(), key=lambda kv: (kv[0][0], [-b for b in kv[0][1]] + [1]))
    sorted_batches = []
    for at in range(0, len(rows_sorted), 7):
        part = rows_sorted[at : at + 7]
        sorted_batches.append(pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in part]), pa.array([0] * len(part)), pa.array([k[1] for k, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], names=["lang", "shared", "suffix", "n"]))
    phrases = Counter()
    for out in collocations._count_prefixes(5, 1)(iter(sorted_batches)):
        for lang, phrase, words, n in zip(*(c.to_pylist() for c in out.columns)):
            assert (lang, phrase) not in phrases and phrase.count(b"\0") == words - 1
            phrases[lang, phrase] += n
    assert {k: n for k, n in phrases.items() if b"\0" not in k[1]} == {k: n for k, n in counts.items() if k[1] is not None}
    direct = Counter()
    for lang, text in texts:
        for piece in collocations.plain(text.encode()).split(b"\n"):
            words = [w for w in piece.split(b" ") if w]
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    direct[lang, b"\0".join(words[i : i + k])] += 1
    assert phrases == direct


def test_suffixes_are_what_is_not_counted_yet(spark):
    """Words, pairs and phrases that are too rare make no suffix, however often their words and pairs occur."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(25)]
    rows = [(" ".join(rng.choices(words, k=60)) + "! One fixed phrase here.", "en") for _ in range(600)]
    work = shared.Workspace(spark, "test")
    texts = spark.createDataFrame(rows, "text string, lang string").select("lang", "text").repartition(3)
    frequent, _, pairs, suffixes, _ = collocations.counted_parts(work, texts, 5, 40)
    got = suffixes.collect()
    assert {r.suffix for r in got} == {b"one\0fixed\0phrase\0here", b"fixed\0phrase\0here"} and len(got) <= 2 * 3 and sum(r.n for r in got) == 1200
    assert frequent.count() == 29 and pairs.count() > 500  # nearly all pairs of the 25 words
    check_phrases(spark, rows, least=40)


def test_pairs_are_added_up_exactly(monkeypatch):
    """Also where a bucket's pairs are added up many times, and where a rare word's number begins like a frequent one's."""
    import hashlib
    import zlib

    import pyarrow as pa

    monkeypatch.setattr(collocations, "CHUNK", 64)
    monkeypatch.setattr(collocations, "WAITING", 10)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices([*words, "rare"], k=300)) + rng.choice([". w1", ""]) for _ in range(20)]
    digest = lambda w: hashlib.sha256(b"0\0en\0" + w.encode()).digest()[:16]
    alike = digest("rare")[:8] + b"\0" * 8

    class Known:
        value = collocations.Words(0, [*map(digest, words), alike], np.array([zlib.crc32(w.encode(), zlib.crc32(b"en\0")) for w in [*words, "x"]]))

    class Bits:
        value = np.full(collocations.FILTER_BITS // 64, 2**64 - 1, dtype=np.uint64)

    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts})
    rows = sorted((r for out in collocations._pair_counts(Known, [Bits], 3)(iter([batch])) for r in out.to_pylist()), key=lambda r: r["bucket"])
    got = [r for out in collocations._frequent_pairs(Known, 30)(iter([pa.RecordBatch.from_pylist(rows[:9]), pa.RecordBatch.from_pylist(rows[9:])])) for r in out.to_pylist()]
    expected = Counter()
    for piece in ".".join(texts).split("."):
        own = piece.split()
        expected.update((digest(a)[:8], digest(b)[:8]) for a, b in zip(own, own[1:]) if "rare" not in (a, b))
    assert len(rows) == 60 and {(r["first"], r["second"]): r["n"] for r in got} == {k: n for k, n in expected.items() if n >= 30}


def test_collocations_of_no_rows(spark):
    assert collocations.mine_collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations.mine_collocations(spark.createDataFrame([("a b. " * 200, "en")], "text string, lang string"), longest=2).count() == 1


def test_lookup_of_frequent_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(shared, "MOST_EDGES", 3)
    rows = spark.createDataFrame([(i, "a" if i < 50 else None if i < 90 else str(i)) for i in range(100)], "i int, k string")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    got = shared.looked_up(rows, table, ["k"], 100)
    assert got.columns == ["i", "k", "top"]
    assert sorted((r.i, r.top) for r in got.collect()) == [(i, 49 if i < 50 else 89 if i < 90 else i) for i in range(100)]
