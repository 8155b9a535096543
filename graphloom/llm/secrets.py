"""Secrets in texts by fixed patterns and by character Markov models, in DataFrame operations only.

Two first-order Markov models over the characters of a token are trained from labelled samples: tokens that a pattern names
as secrets (random strings), and all other long tokens (ordinary words and identifiers). A token that no pattern covers is a
secret where the logarithm of the likelihood ratio, summed over its character pairs, is at least ``min_ratio``.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in their order, with the pattern, the group to measure and its least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: The same for the patterns whose failing matches can be left out at once: a whole run of one class is the match.
SHORT_CUT = {"hex": r"(?<![0-9a-f])[0-9a-f]{16,}", "access": r"AKIA[A-Z0-9]{14,}"}
#: Parts of which a text with a match has one, once it is in lower case (``access``: as it is).
PARTS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("AKIA",)}
MARKOV = "markov"
#: Characters of tokens that the models read, and the tokens.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
TRAINING_TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}"


#: Spans as arrays; array results that grow one by one are built in pieces of so many elements, since each step copies its piece.
SPANS = "array<struct<start:int,kind:int,end:int>>"
CHUNK = 128


def _let(value: F.Column, use) -> F.Column:
    """``use(value)`` with the value computed once. Inside a lambda, a plain expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(values: F.Column, op, first: F.Column) -> F.Column:
    """For each of ``values`` (array<int>), the result of the associative ``op`` over ``first`` and all values up to it."""

    def along(part, start):
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, state, lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(op(a["at"], x))).alias("out")))["out"]

    def in_chunks(chunks):
        starts = along(F.transform(chunks, lambda c: F.aggregate(c, first, op)), first)
        return F.flatten(F.zip_with(chunks, _let(starts, lambda x: F.concat(F.array(first), F.slice(x, F.lit(1), F.size(x) - 1))), along))

    numbers = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))
    cut = lambda v: _let(F.transform(numbers(v), lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK))), in_chunks)
    return _let(values, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(F.array().cast("array<int>")))


def _spans(text: F.Column, kind: int, pattern: str, matches: F.Column, sizes: F.Column | None, least: int) -> F.Column:
    """Spans (start, kind, end) in code points of the matches: the texts between them come from a split at the pattern."""
    between = F.transform(F.split(text, pattern, -1), F.length)

    def with_ends(lengths):
        ends = _scan(F.zip_with(F.slice(between, F.lit(1), F.size(lengths)), lengths, lambda x, y: x + y), lambda x, y: x + y, F.lit(0))
        spans = F.zip_with(ends, lengths, lambda end, n: F.struct((end - n).alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.zip_with(spans, lengths if sizes is None else F.transform(sizes, F.length), lambda span, n: F.when(n >= least, span))

    found = F.filter(_let(F.transform(matches, F.length), with_ends), lambda span: span.isNotNull())
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(SPANS))


def _apart(base: F.Column, added: F.Column) -> F.Column:
    """Those of ``added`` that overlap no span of ``base``: one walk over both in order, and one back."""

    def walk(both):
        is_base = lambda s: s["kind"] < len(KINDS)
        before = _scan(F.transform(both, lambda s: F.when(is_base(s), s["end"]).otherwise(-1)), lambda x, y: F.greatest(x, y), F.lit(-1))
        beyond = _scan(F.transform(F.reverse(both), lambda s: F.when(is_base(s), -s["start"]).otherwise(-(2**31) + 1)), lambda x, y: F.greatest(x, y), F.lit(-(2**31) + 1))
        limits = F.zip_with(before, F.reverse(beyond), lambda x, y: F.struct(x.alias("from"), (-y).alias("to")))
        return F.zip_with(both, limits, lambda s, m: F.when(~is_base(s) & (m["from"] <= s["start"]) & (s["end"] <= m["to"]), s))

    kept = F.filter(_let(F.array_sort(F.concat(base, added)), walk), lambda s: s.isNotNull())
    return F.when((F.size(base) > 0) & (F.size(added) > 0), kept).otherwise(added)


def _base(df: DataFrame) -> DataFrame:
    """Adds ``_base``: the spans of all kinds, in order of start and kind."""
    columns, found = {}, []
    for number, (kind, pattern, group, least) in enumerate(KINDS):
        pattern = SHORT_CUT.get(kind, pattern)
        matches = F.regexp_extract_all("_text", F.lit(pattern), 0)
        if kind in PARTS:  # looking for a fixed part costs far less than the pattern
            where = F.lower("_text") if kind == "assign" else F.col("_text")
            matches = F.when(reduce(or_, (F.contains(where, F.lit(x)) for x in PARTS[kind])), matches).otherwise(F.array().cast("array<string>"))
        columns[f"_{kind}"] = matches
        sizes = F.regexp_extract_all("_text", F.lit(pattern), group) if group else None
        found.append(_spans(F.col("_text"), number, pattern, F.col(f"_{kind}"), sizes, least))
    df = df.withColumns(columns)
    return df.withColumn("_base", F.array_sort(F.concat(*found))).drop(*columns)


def _pairs(token: F.Column) -> F.Column:
    """Numbers of the token's neighbouring character pairs: row and column of the models' table. One walk, however long."""
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.zip_with(codes, F.slice(codes, F.lit(2), F.length(token)), lambda x, y: x * len(ALPHABET) + y)
    return F.slice(pairs, F.lit(1), F.length(token) - 1)


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = 4000, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios (random string against ordinary token) for each pair of ``ALPHABET``.

    The labelled samples come from about ``sample_docs`` documents, chosen by a hash of id and text: values that the fixed
    patterns find, and the other tokens of those documents (a secret that no pattern names counts as ordinary there). The table has len(ALPHABET) squared entries whatever the input.
    """
    n = docs.count()
    share = min(1.0, sample_docs / max(n, 1))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = docs.select(text.alias("_text"), F.col(id_col).cast("string").alias("_id"))
    some = some.where(F.pmod(F.xxhash64(F.lit("train"), "_id", "_text"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    named = F.concat(*(F.regexp_extract_all("_text", F.lit(SHORT_CUT.get(kind, pattern)), group) for kind, pattern, group, _ in KINDS))
    without = F.col("_text")
    for kind, pattern, _, _ in KINDS:
        without = F.regexp_replace(without, SHORT_CUT.get(kind, pattern), " ")
    tokens = some.select(
        F.explode(
            F.concat(
                F.transform(F.flatten(F.transform(named, lambda x: F.regexp_extract_all(x, F.lit(TOKEN), 0))), lambda x: F.struct(F.lit(1).alias("label"), x.alias("token"))),
                F.transform(F.regexp_extract_all(without, F.lit(TRAINING_TOKEN), 0), lambda x: F.struct(F.lit(0).alias("label"), x.alias("token"))),
            )
        ).alias("t")
    )
    # a pair counts once for each token, so that a very long one weighs no more than the table has entries
    counts = tokens.select("t.label", F.explode(F.array_distinct(_pairs(F.col("t.token")))).alias("pair")).groupBy("label", "pair").count()
    size = len(ALPHABET)
    table = [[smoothing] * (size * size) for _ in range(2)]
    for label, pair, number in counts.collect():  # at most 2 * len(ALPHABET) ** 2 rows
        table[label][pair] += number
    totals = [[sum(t[a * size : (a + 1) * size]) for a in range(size)] for t in table]
    return [
        math.log(table[1][p] / totals[1][p // size]) - math.log(table[0][p] / totals[0][p // size]) for p in range(size * size)
    ]


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_ratio: float = 20.0,
    min_mean: float = 0.8,
    ratios: list[float] | None = None,
) -> DataFrame:
    """Secrets of every text, by the fixed patterns and by the models.

    Returns doc_id, n_assign, n_access, n_hex long, base_sha256 string (hex SHA-256 of the fixed patterns' spans,
    ``kind:start:end`` by start and kind, comma-joined, in code points, end exclusive), spans string (all spans, joined
    likewise; the models' kind is ``markov`` and comes last), n_markov long. ``ratios`` is the result of ``train``; without
    it the models are trained from ``docs``. The models' spans never overlap the patterns'.

    Nulls and odd rows: a null text is empty and has no spans; repeated rows and null ids are rows like any other. An
    empty table gives an empty result. Other columns are ignored.
    """
    if ratios is None:
        ratios = train(docs, text_col, id_col)
    table = F.lit([float(x) for x in ratios])
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    df = _base(df).withColumn("_tokens", F.regexp_extract_all("_text", F.lit(TOKEN), 0))
    spans = _spans(F.col("_text"), len(KINDS), TOKEN, F.col("_tokens"), None, 1)

    def ratio(token):
        return F.aggregate(_pairs(token), F.lit(0.0), lambda a, p: a + F.element_at(table, p + 1))

    def random(token):
        return ratio(token) >= F.greatest(F.lit(min_ratio), min_mean * (F.length(token) - 1))

    scored = F.filter(F.zip_with(spans, F.col("_tokens"), lambda s, t: F.when(random(t), s)), lambda s: s.isNotNull())
    df = df.withColumn("_random", F.when(F.size("_tokens") > 0, scored).otherwise(F.array().cast(SPANS)))
    df = df.withColumn("_added", _apart(F.col("_base"), F.col("_random")))
    names = F.array(*(F.lit(k[0]) for k in KINDS), F.lit(MARKOV))
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return df.select(
        "doc_id",
        *(count("_base", i).alias(f"n_{kind[0]}") for i, kind in enumerate(KINDS)),
        F.sha2(show("_base").cast("binary"), 256).alias("base_sha256"),
        show(F.array_sort(F.concat("_base", "_added"))).alias("spans"),
        F.size("_added").cast("long").alias("n_markov"),
    )
