"""Language identification by multilingual mixture inference.

Training counts the letter trigrams of words for each language. A document is a mixture: each of its words comes from one
language, and expectation-maximisation over the words' trigram likelihoods estimates the languages' proportions. The set of
languages is the one with the highest penalised likelihood among the document's one, two, three ... strongest. The language
with the largest proportion is the prediction.

Where texts may be rejected, a background takes part besides the chosen languages: for each word the better of letters drawn
independently and uniform trigrams. It has the words that no learned language explains.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
#: Trigrams are hashed into so many buckets.
BUCKETS = 1 << 16
#: Most languages that can be learned: every worker holds BUCKETS numbers for each. More are an error, none is left out.
LANGUAGES = 1000
#: Words whose likelihoods a worker keeps, and words of the documents that it solves at once.
KEPT_WORDS, WORDS_AT_ONCE = 300_000, 400_000
UNKNOWN = "und"


def word_trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of the words (with a blank on each side), and where each word's begin."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    inside = codes[1:-1] != 32
    before = np.cumsum(inside) - inside
    starts = np.flatnonzero(codes[:-2] == 32)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)[inside], before[starts]


def background_likelihoods(words: list[str], starts: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word without any language; ``starts`` as ``word_trigrams`` gives them."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), dtype=np.uint32)
    each = letters[codes % BUCKETS]
    drawn = np.add.reduceat((each[:-2] + each[1:-1] + each[2:])[codes[1:-1] != 32], starts)
    return np.maximum(drawn, -np.log(BUCKETS) * np.array([len(w) for w in words]))


def is_held_out(doc_id: F.Column) -> F.Column:
    """Documents that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, usable: F.Column, docs_per_language: int = 3000, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, logarithms of trigram probabilities as a matrix languages x BUCKETS, those of letters over all languages).

    ``docs`` has text and lang; ``usable`` names the rows that may be learned from. About ``docs_per_language`` whole
    documents of each language are used, chosen by a hash of the text.
    """
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    rows = {x["lang"]: x["n"] for x in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(rows) > LANGUAGES:
        raise ValueError(f"there are more than {LANGUAGES} languages")
    languages = sorted(rows)
    if not languages:
        return [], np.zeros((0, BUCKETS), dtype=np.float32), np.zeros(BUCKETS, dtype=np.float32)
    number = {x: i for i, x in enumerate(languages)}
    sizes = labelled.sparkSession.createDataFrame([(x, docs_per_language * 1e6 / n) for x, n in rows.items()], "lang string, share double")
    some = labelled.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64(F.lit("train"), "text"), F.lit(1_000_000)) < F.col("share"))

    def count(batches):
        totals = np.zeros((len(languages) + 1, BUCKETS), dtype=np.int64)  # the last row counts letters
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(text.lower())
                if words:
                    totals[number[lang]] += np.bincount(word_trigrams(words)[0], minlength=BUCKETS)
                    totals[-1] += np.bincount(np.frombuffer((" " + " ".join(words)).encode("utf-32-le"), dtype=np.uint32) % BUCKETS, minlength=BUCKETS)
        lang, bucket = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(totals[lang, bucket])], names=["lang", "bucket", "n"])

    table = np.full((len(languages) + 1, BUCKETS), smoothing)
    counted = some.select("lang", "text").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most BUCKETS rows for each language
    table[found["lang"].to_numpy(), found["bucket"].to_numpy()] += found["n"].to_numpy()
    table = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    return languages, table[:-1], table[-1]


def solve(likelihood: np.ndarray, sizes: np.ndarray, rounds: int = 8, penalty: float = 2.0) -> np.ndarray:
    """Proportions of the languages for each document, from the log-likelihoods of its words.

    ``likelihood`` has a row for each word, documents one after the other, ``sizes`` words each (none empty).
    """
    n, languages = len(sizes), likelihood.shape[1]
    starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(n), sizes)
    top = likelihood.max(axis=1)
    chance = np.exp(likelihood - top[:, None])

    def improve(p: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(times):
            joint = chance * p[doc]
            joint /= joint.sum(axis=1, keepdims=True) + 1e-30
            p = np.add.reduceat(joint, starts, axis=0) / sizes[:, None]
        # words that no language of the set could have written count as very unlikely, not as impossible
        fit = np.log((chance * p[doc]).sum(axis=1) + 1e-30) + top
        return p.astype(np.float32), np.add.reduceat(fit.astype(np.float64), starts)

    full, _ = improve(np.full((n, languages), 1 / languages, dtype=np.float32), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    best, best_value = full, np.full(n, -np.inf)
    for m in range(1, languages + 1):
        keep = np.zeros_like(full, dtype=bool)
        np.put_along_axis(keep, order[:, :m], True, axis=1)
        p = np.where(keep, full + 1e-6, 0)
        p, fit = improve((p / p.sum(axis=1, keepdims=True)).astype(np.float32), 0 if m == 1 else rounds // 2)
        value = fit - penalty * (m - 1) * np.log(sizes + 1)
        better = value > best_value
        best = np.where(better[:, None], p, best)
        best_value = np.where(better, value, best_value)
    return best


def beside_background(p: np.ndarray, likelihood: np.ndarray, sizes: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Proportions ``p`` of the languages estimated anew with the background, whose likelihoods are the last column."""
    starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    chance = np.exp(likelihood - likelihood.max(axis=1, keepdims=True))
    p = np.column_stack([0.75 * p, np.full(len(sizes), 0.25)]).astype(np.float32)
    for _ in range(rounds):
        joint = chance * p[doc]
        joint /= joint.sum(axis=1, keepdims=True) + 1e-30
        p = (np.add.reduceat(joint, starts, axis=0) / sizes[:, None]).astype(np.float32)
    return p


def identify(docs: DataFrame, languages: list[str], table: np.ndarray, text_col: str = "text", letters: np.ndarray | None = None) -> DataFrame:
    """(row: all columns of ``docs`` as a struct, lang_pred, score, mixture) for each row; see ``predict_languages``.

    With ``letters`` the background takes part: shares are of all words, and a text of which it has the most is ``und``.
    """
    model = docs.sparkSession.sparkContext.broadcast((table, letters))  # bounded: BUCKETS numbers for each language
    columns = len(languages) + (letters is not None)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, mixture map<string,double>"

    def run(batches):
        (probabilities, letters), known, vectors, used = model.value, {}, np.zeros((0, columns), dtype=np.float32), 0

        def answer(rows, held, sizes):
            flat = np.concatenate([x for x in held if len(x)]) if any(sizes) else np.zeros(0, dtype=np.int32)
            sizes = np.array(sizes)
            preds, scores, mixtures = [UNKNOWN] * len(sizes), [0.0] * len(sizes), [[] for _ in sizes]
            real = np.flatnonzero(sizes)
            if len(real):
                likelihood = vectors[flat]
                p, background = solve(likelihood[:, : len(languages)], sizes[real]), np.zeros(len(real))
                if letters is not None:
                    p = beside_background(p, likelihood, sizes[real])
                    p, background = p[:, :-1], p[:, -1]
                for i, row, rest in zip(real, p, background):
                    best = int(row.argmax())
                    preds[i], scores[i] = UNKNOWN if rest > row[best] else languages[best], float(min(1.0, row[best]))
                    mixtures[i] = [(languages[k], float(row[k])) for k in np.flatnonzero(row > 1e-3)]
            return pa.RecordBatch.from_arrays(
                [rows, pa.array(preds), pa.array(scores, pa.float64()), pa.array(mixtures, pa.map_(pa.string(), pa.float64()))],
                names=["row", "lang_pred", "score", "mixture"],
            )

        for batch in batches:
            at, held, sizes, total, fresh = 0, [], [], 0, []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                words = WORD.findall(text.lower()) if text and languages else []
                if words and not any(c.isalpha() for w in words[:100] for c in w) and not any(c.isalpha() for w in words for c in w):
                    words = []
                numbers = np.empty(len(words), dtype=np.int32)
                for k, w in enumerate(words):
                    v = known.get(w)
                    if v is None:
                        v = known[w] = used + len(fresh)
                        fresh.append(w)
                    numbers[k] = v
                held.append(numbers)
                sizes.append(len(words))
                total += len(words)
                if total >= WORDS_AT_ONCE or i == batch.num_rows - 1:
                    if fresh:
                        grams, starts = word_trigrams(fresh)
                        # each word has a trigram at least, so that every segment has a row
                        lines = [np.add.reduceat(line[grams], starts) for line in probabilities]
                        lines += [] if letters is None else [background_likelihoods(fresh, starts, letters)]
                        fresh_vectors = np.stack(lines, axis=1).astype(np.float32)
                        if used + len(fresh) > len(vectors):
                            vectors = np.concatenate([vectors[:used], fresh_vectors, np.zeros((used + len(fresh), columns), dtype=np.float32)])
                        else:
                            vectors[used : used + len(fresh)] = fresh_vectors
                        used, fresh = used + len(fresh), []
                    yield answer(batch.column(0).slice(at, i + 1 - at), held, sizes)
                    at, held, sizes, total = i + 1, [], [], 0
                    if used > KEPT_WORDS:
                        known, used = {}, 0

    return rows.mapInArrow(run, schema)


def known_languages(docs: DataFrame, min_share: float = 0.25, docs_per_language: int = 3000) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, lang and any others) whose language can be told.

    Rejected are texts without letters, texts of which no language has at least ``min_share`` of the words, and texts of which
    the background has more words than any language: random letters, encoded data, code, languages that were not learned.

    Nulls and odd rows: null texts and texts without letters go; where nothing is labelled, everything does. A null id is not
    learned from, but kept like any other row if its language can be told. Repeated rows are kept or go together. An empty
    table gives an empty result. All columns pass through under any name.
    """
    languages, table, letters = train(docs, F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")), docs_per_language)
    told = identify(docs, languages, table, letters=letters)
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_share)).select("row.*")


def predict_languages(docs: DataFrame, docs_per_language: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The language of every whole text.

    Learns from labelled documents that are not held out (crc32 of the id as text, modulo 4, is 2); a prediction reads the
    text only. Returns doc_id, held_out boolean, lang_pred string, score double (the language's share of the words, 0 to 1),
    mixture map<string,double> (the shares of all languages of the chosen set).

    Nulls and odd rows: a null text or one without letters is ``und`` with score 0 and an empty mixture; so is everything
    where nothing is labelled. A null id is not held out and is not learned from. Repeated rows get the same answer. An empty
    table gives an empty result. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    languages, table, _ = train(own, F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")), docs_per_language)
    told = identify(own.select("doc_id", "text"), languages, table)
    return told.select("row.doc_id", is_held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "mixture")
