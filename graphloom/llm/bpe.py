"""Byte-level BPE by corpus-level merge replay.

Texts are cut into pieces (matches of the pre-tokenising pattern), which are counted over the whole corpus. The distinct pieces
are then replayed together: they are laid out as arrays of byte tokens, and an inverted index leads from the rank of each
neighbouring token pair to its positions in the pieces. Ranks are taken in order; each applies to all its positions at once, and
only the pairs left and right of a merge are looked up again and filed under their ranks. A piece in which a merge uncovers a
smaller rank than the current one would need steps out of order; such pieces, which are few, are replayed one by one.

The most frequent pieces, at most COMMON, are replayed once for the corpus, and all workers get their ids. A worker replays the
rare pieces of its documents, which hardly any other worker meets, by the same index.
"""

from __future__ import annotations

import base64
import collections
import hashlib
import heapq
import itertools

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

#: Pieces whose ids all workers get, pieces of one replay, pieces that a worker keeps, and occurrences that wait for a replay.
COMMON, REPLAYED, KEPT_PIECES, WAITING = 200_000, 150_000, 600_000, 3_000_000
#: Distinct pieces that a counting task holds.
COUNTED = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """The ranks of a vocabulary, and of every pair of its tokens whose bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [
            (ranks[token[:cut]] << 32 | ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.values = np.array([p[1] for p in pairs] + [-1], dtype=np.int64)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def one(self, piece: bytes) -> list[int]:
        """The ids of one piece: the smallest rank first, the leftmost of equals; by a heap over a linked list."""
        tokens = [bytes([b]) for b in piece]
        after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        heap: list[tuple[int, int, bytes, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(piece) and (rank := self.ranks.get(tokens[i] + tokens[after[i]])) is not None:
                heapq.heappush(heap, (rank, i, tokens[i], tokens[after[i]]))

        for i in range(len(piece) - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != left or j >= len(piece) or tokens[j] != right:
                continue
            tokens[i], tokens[j], after[i] = left + right, b"", after[j]
            if after[j] < len(piece):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [self.ranks[t] for t in tokens if t]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of ids of each piece). No piece is empty."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        token = self.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[starts + sizes - 1] = -1
        before[starts] = -1
        alive = np.ones(n, dtype=bool)
        rank_at = np.full(n, -1, dtype=np.int64)
        open_pairs = np.flatnonzero(after >= 0)
        rank_at[open_pairs] = self.of_pairs(token[open_pairs], token[after[open_pairs]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(places: np.ndarray) -> None:
            places = places[rank_at[places] >= 0]
            if not len(places):
                return
            order = np.argsort(rank_at[places], kind="stable")
            places = places[order]
            ranks = rank_at[places]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, own in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts) if len(cuts) else [places]):
                if r in index:
                    index[r].append(own)
                else:
                    index[r] = [own]
                    heapq.heappush(heap, r)

        file(open_pairs)
        out_of_order: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[rank_at[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                follows = np.zeros(len(at), dtype=bool)
                follows[1:] = after[at[:-1]] == at[1:]
                if follows.any():  # pairs that share a token: from the left, every second one
                    place = np.arange(len(at))
                    run = np.maximum.accumulate(np.where(follows, 0, place))
                    at = at[(place - run) % 2 == 0]
            right = after[at]
            beyond = after[right]
            token[at] = r
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            alive[right] = False
            rank_at[right] = -1
            rank_at[at] = -1
            left = before[at]
            touched = np.concatenate([left[left >= 0], at[inner]])
            if not len(touched):
                continue
            rank_at[touched] = self.of_pairs(token[touched], token[after[touched]])
            early = rank_at[touched] < r
            early &= rank_at[touched] >= 0
            if early.any():
                out_of_order.append(touched[early])
                rank_at[touched[early]] = -1
                touched = touched[~early]
            file(touched)
        counts = np.add.reduceat(alive, starts, dtype=np.int64)
        ids = token[alive]
        if out_of_order:
            again = np.unique(np.searchsorted(starts, np.concatenate(out_of_order), side="right") - 1)
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in again.tolist():
                parts[k] = np.array(self.one(pieces[k]), dtype=np.int64)
                counts[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, counts


_loaded: dict[str, Merges] = {}


def _merges(path: str) -> Merges:
    if path not in _loaded:
        _loaded[path] = Merges(read_ranks(path))
    return _loaded[path]


def piece_finder(pattern: str):
    # White space as the property names it, which leaves out the information separators
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall


def _counted(pattern: str):
    """(piece, n) of texts, summed up in the task."""

    def run(batches):
        find, counts = piece_finder(pattern), collections.Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["piece", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(find(text.as_py() or ""))
                if len(counts) >= COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    return run


def _replayed(path: str):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, REPLAYED):
                pieces = batch.column(0).slice(at, REPLAYED)
                ids, counts = _merges(path).replay([p.encode() for p in pieces.to_pylist()])
                codes = [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([pieces, pa.array(codes, pa.binary())], names=["piece", "codes"])

    return run


def common_pieces(work: Workspace, texts: DataFrame, path: str, pattern: str) -> pa.Table:
    """(piece, codes) of the pieces that occur most often in (text): all that occur at least so often, the least such number
    of occurrences that is a power of two and leaves at most COMMON pieces."""
    counts = texts.mapInArrow(_counted(pattern), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = work.save(counts.where("n > 1"), "counts")
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("pieces")).collect()  # 63 rows at most
    least, left = 64, COMMON
    for power, pieces in sorted(sizes, reverse=True):
        if pieces > left:
            break
        least, left = power, left - pieces
    often = counts.where(F.col("n") >= F.lit(1 << least if least < 63 else 2**63 - 1)).select("piece")
    found = work.save(often.mapInArrow(_replayed(path), "piece string, codes binary"), "codes").toArrow()  # at most COMMON rows
    work.drop("counts", "codes")
    return found


class Encoder:
    """Encodes texts as they come; keeps the ids of the pieces it has met in flat arrays, the common ones from the start."""

    def __init__(self, merges: Merges, pattern: str, common: pa.Table):
        self.merges, self.common, self.find = merges, common, piece_finder(pattern)
        self.forget()

    def forget(self) -> None:
        """Back to the common pieces."""
        self.number = collections.defaultdict(None, zip(self.common.column("piece").to_pylist(), range(self.common.num_rows)))
        self.number.default_factory = self.number.__len__  # a new piece gets the next number
        codes = self.common.column("codes").to_pylist()
        self.size = np.array([len(x) // 4 for x in codes], dtype=np.int64)
        self.ids = np.frombuffer(b"".join(codes), "<u4").astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.back = [decode(x, self.merges.bytes_of) for x in np.split(self.ids, self.start[1:])] if codes else []

    def pieces(self, text: str) -> np.ndarray:
        """Numbers of a text's pieces."""
        found = self.find(text)
        return np.fromiter(map(self.number.__getitem__, found), np.int32, len(found))

    def unlearned(self) -> int:
        return len(self.number) - len(self.start)

    def learn(self) -> None:
        """Replays the pieces that are new."""
        if new := list(itertools.islice(self.number, len(self.start), None)):
            ids, counts = self.merges.replay([p.encode() for p in new])
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
            self.size = np.concatenate([self.size, counts])
            self.ids = np.concatenate([self.ids, ids])
            self.back += [decode(x, self.merges.bytes_of) for x in np.split(ids, np.cumsum(counts)[:-1])]

    def encoded(self, pieces: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(ids of a text as little-endian unsigned 32-bit integers, the bytes that they decode to) from the numbers of its pieces."""
        sizes = self.size[pieces]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[pieces] - (ends - sizes), sizes)
        return self.ids[places].astype("<u4"), b"".join([self.back[k] for k in pieces.tolist()])


def decode(ids: np.ndarray, bytes_of: dict[int, bytes]) -> bytes:
    return b"".join([bytes_of[i] for i in ids.tolist()])


def encode_texts(
    docs: DataFrame,
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = ("ids", "decoded"),
) -> DataFrame:
    """Encodes every whole text by the ranks in ``path`` (on every worker), then decodes the ids.

    Returns doc_id, n_tokens long, ids_sha256 string (hex, of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 string (hex, of the decoded bytes), and of ids array<int> and decoded string those that ``keep`` names.

    Nulls and odd rows: a null text is empty and has no ids. Repeated rows and null ids are rows like any other. An empty
    table gives an empty result. Other columns are ignored.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    common = spark.sparkContext.broadcast(common_pieces(Workspace(spark, "bpe"), own.select("text"), path, pattern))  # COMMON pieces at most
    kind = own.schema["doc_id"].dataType.simpleString()
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep]

    def answer(encoder: Encoder, ids: pa.Array, held: list[np.ndarray]) -> pa.RecordBatch:
        columns: dict[str, list] = {name: [] for name in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        for pieces in held:
            own, back = encoder.encoded(pieces)
            columns["n_tokens"].append(len(own))
            columns["ids_sha256"].append(hashlib.sha256(own.tobytes()).hexdigest())
            columns["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            if "ids" in keep:
                columns["ids"].append(own.astype(np.int32))
            if "decoded" in keep:
                columns["decoded"].append(back.decode())
        types = [pa.int64(), pa.string(), pa.string(), *(kinds[name][1] for name in keep)]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(columns[n], t) for n, t in zip(names[1:], types))], names=names)

    def run(batches):
        encoder = Encoder(_merges(path), pattern, common.value)
        waiting: list[tuple[pa.Array, list[np.ndarray]]] = []
        total = 0

        def flush():
            encoder.learn()
            for ids, held in waiting:
                yield answer(encoder, ids, held)
            waiting.clear()
            if len(encoder.start) > KEPT_PIECES:
                encoder.forget()

        for batch in batches:
            at, held = 0, []
            for i in range(batch.num_rows):
                held.append(encoder.pieces(batch.column(1)[i].as_py() or ""))
                total += len(held[-1])
                if len(held) == 512 or i == batch.num_rows - 1 or total >= WAITING:
                    waiting.append((batch.column(0).slice(at, i + 1 - at), held))
                    at, held = i + 1, []
                if total >= WAITING or encoder.unlearned() >= REPLAYED and not held:
                    yield from flush()
                    total = 0
        yield from flush()

    extra = "".join(f", {name} {kinds[name][0]}" for name in keep)
    return own.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
