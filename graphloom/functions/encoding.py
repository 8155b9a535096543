"""Character sets of pages, and texts that were decoded wrongly."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

# Byte order marks, names that stand for a wider set, and what is tried in turn.
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
_WIDER = {"gb2312": "gb18030", "gbk": "gb18030"}
_FALLBACKS = ("gb18030", "gbk", "big5", "windows-1252", "iso-8859-1")
_STATED = re.compile(rb"""charset\s*=\s*["']?\s*([A-Za-z0-9_-]+)""", re.I)
#: What statistics tell apart, and how sure they must be.
CHARSETS = ("gb18030", "big5", "shift_jis", "euc-kr", "windows-1252")
CONFIDENCE = 0.9
_PAIRS = 1 << 16


def byte_pairs(data: bytes) -> np.ndarray:
    """The numbers of all neighbouring bytes of which one is not ASCII; a line feed stands before and after the data."""
    b = np.frombuffer(b"\n" + data + b"\n", dtype=np.uint8).astype(np.int32)
    pairs = b[:-1] << 8 | b[1:]
    return pairs[(b[:-1] >= 128) | (b[1:] >= 128)]


class CharsetModel:
    """For each character set, the logarithm of how likely a byte follows another one in its texts.

    Likelihood for what never followed a byte is taken from what follows all bytes, ASCII or not, weighed by how many followers it has
    (Witten and Bell); bytes that no text of a set has share ``unseen`` there, however many texts it has. So neither a lead byte that a
    set never had nor a set of few texts gains from pairs that are odd in another one.
    """

    def __init__(self, counts: dict[str, np.ndarray], unseen: float = 1e-4):
        self.logs = {}
        for charset, n in counts.items():
            table = n.reshape(2, 128, 256)  # after ASCII bytes, and after others
            total, seen = table.sum(axis=1, keepdims=True), table.sum(axis=2, keepdims=True)
            anywhere = (1 - unseen) * total / np.maximum(1, total.sum(axis=2, keepdims=True)) + unseen / 256
            kinds = np.maximum(1, (table > 0).sum(axis=2, keepdims=True))
            self.logs[charset] = np.log((table + kinds * anywhere) / (seen + kinds)).ravel().astype(np.float32)

    def detect(self, data: bytes) -> tuple[str, float] | None:
        """The likeliest set that can decode the data, and its share of the likelihood; None if there is none, or no byte above ASCII."""
        pairs = byte_pairs(data)
        scores = {c: float(logs[pairs].sum(dtype=np.float64)) for c, logs in self.logs.items() if decodes(data, c)}
        if not len(pairs) or not scores:
            return None
        best = max(scores, key=scores.get)
        return best, 1 / sum(math.exp(max(-700.0, s - scores[best])) for s in scores.values())


def decodes(data: bytes, charset: str) -> bool:
    try:
        data.decode(charset)
        return True
    except (UnicodeDecodeError, LookupError):
        return False


def train_charsets(texts: DataFrame, column: str = "text", charsets: tuple[str, ...] = CHARSETS) -> CharsetModel:
    """A model from sample texts: each is written in every character set that can hold it, and its byte pairs are counted.

    Tasks count; the driver gets 65,536 counts for each set at most. Texts that are null or plain ASCII teach nothing.
    """

    def count(batches):
        totals = {c: np.zeros(_PAIRS, dtype=np.int64) for c in charsets}
        held = {c: [] for c in charsets}

        def add(charset):
            if held[charset]:
                totals[charset] += np.bincount(np.concatenate(held[charset]), minlength=_PAIRS)
                held[charset] = []

        for pdf in batches:
            for text in pdf[column]:
                if text is None or text.isascii():
                    continue
                for charset in charsets:
                    try:
                        held[charset].append(byte_pairs(text.encode(charset)))
                    except UnicodeEncodeError:
                        continue
                    if len(held[charset]) >= 500:  # a table of all pairs for each short text would take longer than the text
                        add(charset)
        for charset, n in totals.items():
            add(charset)
            found = np.flatnonzero(n)
            yield pd.DataFrame({"charset": charset, "pair": found, "n": n[found]})

    rows = texts.select(column).mapInPandas(count, "charset string, pair int, n long").groupBy("charset", "pair").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, np.ndarray] = {}
    for charset, pair, n in rows:
        counts.setdefault(charset, np.zeros(_PAIRS))[pair] = n
    return CharsetModel(counts)


def decode_page(data: bytes | None, model: CharsetModel | None = None) -> tuple[str, str] | None:
    """(text, charset): by byte order mark, strict UTF-8, the page's own statement wherever it stands, the model, then the fall-backs."""
    if data is None:
        return None
    for mark, charset in _MARKS:
        if data.startswith(mark):
            return data.decode(charset, "replace"), charset
    tried = [("utf-8", "utf-8")]
    if not decodes(data, "utf-8"):
        if stated := _STATED.search(data):
            name = stated[1].decode("ascii").lower()
            tried.append((_WIDER.get(name, name), name))
        if model is not None and not (stated and decodes(data, tried[-1][0])) and (found := model.detect(data)) and found[1] >= CONFIDENCE:
            tried.append((found[0], found[0]))
    for charset, name in (*tried, *((c, c) for c in _FALLBACKS)):
        try:
            return data.decode(charset), name
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("utf-8", "replace"), "utf-8"  # not reached: iso-8859-1 takes all bytes


def decoder(model: CharsetModel | None = None):
    """A function from bytes to (text, charset), in Arrow batches."""

    @F.pandas_udf(StructType().add("text", StringType()).add("charset", StringType()))
    def decoded(pages: pd.Series) -> pd.DataFrame:
        found = [decode_page(None if p is None else bytes(p), model) or (None, None) for p in pages]
        return pd.DataFrame(found, columns=["text", "charset"])

    return decoded


@F.pandas_udf(StructType().add("score", DoubleType()).add("segments", IntegerType()))
def reversal(texts: pd.Series) -> pd.DataFrame:
    """Share of long Chinese stretches of 4096 characters, over the whole text, that read as UTF-8 when turned back into GBK bytes."""
    rows = []
    for t in texts:
        good = total = 0
        for at in range(0, len(t or ""), 4096):
            stretch = re.sub("[^一-鿿]", "", t[at : at + 4096])
            if len(stretch) >= 20:
                total += 1
                try:
                    stretch.encode("gbk").decode("utf-8")
                    good += 1
                except UnicodeError:
                    pass
        rows.append((good / total if total else 0.0, total))
    return pd.DataFrame(rows, columns=["score", "segments"])


def mojibake(df, column: str = "text"):
    """Adds kind (null: none found), score, segments: texts that look wrongly decoded."""
    latin = F.regexp_count(F.col(column), F.lit("[æÃåç]{2,}")) > 3
    lost = F.regexp_count(F.col(column), F.lit("\ufffd")) > 5
    scored = df.withColumn("_r", reversal(F.col(column)))
    kind = F.when(F.col("_r.score") > 0.3, "gbk-misread-utf8").when(latin, "latin-misread").when(lost, "replacement-chars")
    return scored.withColumns({"kind": kind, "score": F.round("_r.score", 2), "segments": F.col("_r.segments")}).drop("_r")
