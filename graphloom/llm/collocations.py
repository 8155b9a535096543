"""Phrase collocations by sorting suffixes (suffix-sigma).

Every place in a text gives one suffix, cut off after ``longest`` words. The suffixes are counted where they arise, shuffled by
language and first word, and sorted in reverse order, so that a phrase's suffixes stand together; one walk with a stack of the
open phrases counts all prefixes at once. Suffixes end before a word, a pair of words or a longer phrase that is too rare to be in
a result: such are told by bit filters of fixed size, which may pass rare ones but never stop frequent ones. Words and pairs of
frequent words are counted exactly on the way to these filters, so only suffixes of three words or more are shuffled. The suffixes
of a very frequent first word, or first two, are dealt out to many tasks, whose counts are then added up. Last, phrases are joined
to the counts of their parts.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, looked_up, shuffle_width

#: Letters to lower, what ends a piece (it becomes a line feed), and the blanks between words (a space).
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_TRANSLATE = bytes.maketrans(UPPER + ENDS + BLANKS, LOWER + b"\n" * len(ENDS) + b" " * len(BLANKS))
#: Stands between the words of a phrase, below all that words have; texts that have it themselves are escaped.
GAP = b"\x00"
#: Words that a task counts before it hands the counts on; distinct words that it holds; bytes that are split at once.
CHUNK, HELD_WORDS, SLICE = 1 << 20, 1 << 19, 1 << 22
#: Bits of the filters of frequent words, of frequent pairs of them, and of frequent longer phrases.
FILTER_BITS, PAIR_BITS, LONG_BITS = 1 << 26, 1 << 28, 1 << 26
#: Pairs and longer phrases are added up in so many buckets at least; pairs of a bucket that wait to be added up.
BUCKETS, WAITING = 256, 1 << 21


def plain(text: bytes) -> bytes:
    """The text with pieces ended by line feeds, words parted by spaces, and A-Z in lower case."""
    data = text.translate(_TRANSLATE)
    if b"\x00" in data or b"\x01" in data:
        data = data.replace(b"\x01", b"\x01\x03").replace(b"\x00", b"\x01\x02")
    return data


def _shown(phrase: F.Column) -> F.Column:
    """A phrase with spaces between its words, and without escapes."""
    spaced = F.translate(phrase, "\x00", " ")
    return F.replace(F.replace(spaced, F.lit("\x01\x02"), F.lit("\x00")), F.lit("\x01\x03"), F.lit("\x01"))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of each language in a batch of (lang, text)."""
    by_lang = defaultdict(list)
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
        by_lang[lang].append(plain(text))
    yield from by_lang.items()


def _word_counts(batches):
    """Counts of the words of a task, and of all its words (a null word)."""
    held: dict[str, Counter] = defaultdict(Counter)
    totals: Counter = Counter()

    def out():
        rows = [(lang, word, n) for lang, counts in held.items() for word, n in counts.items()]
        held.clear()
        for at in range(0, len(rows), 1 << 16):
            langs, words, counts = zip(*rows[at : at + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["lang", "word", "f"])

    for batch in batches:
        for lang, texts in _texts(batch):
            for text in texts:
                for data in _slices(text):
                    words = data.split()
                    totals[lang] += len(words)
                    held[lang].update(words)
                if sum(map(len, held.values())) >= HELD_WORDS:
                    yield from out()
    for lang, n in totals.items():
        held[lang][None] = n
    yield from out()


def _slices(data: bytes) -> Iterator[bytes]:
    """The text in slices that end between words."""
    at = 0
    while at < len(data):
        ends = [x for x in (data.find(b" ", at + SLICE), data.find(b"\n", at + SLICE)) if x >= 0] if at + SLICE < len(data) else []
        end = min(ends, default=len(data))
        yield data[at:end]
        at = end


def _numbers(text: bytes, numbers: dict[bytes, int]) -> Iterator[np.ndarray]:
    """The numbers of the text's words, 1 where a piece ends."""
    for data in _slices(text):
        words = data.replace(b"\n", b" \n ").split(b" ")
        own = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        yield own[own > 0]
    yield np.ones(1, dtype=np.int32)


class Chunk:
    """Numbered words of one language, with the hashes of the words; -1 stands for rare words and ends of pieces.

    ``filters`` hold the words, the pairs of words and the longer phrases that may be frequent, as far as they are known.
    """

    def __init__(self, lang: str, numbers: dict[bytes, int], parts: list[np.ndarray], filters: list[np.ndarray]):
        self.lang, self.words, self.vocabulary, self.filters = lang, np.concatenate(parts), list(numbers), filters
        seed = zlib.crc32(lang.encode() + GAP)
        self.heads = np.fromiter((zlib.crc32(w, seed) for w in self.vocabulary), np.int64, len(self.vocabulary))
        frequent = _has(filters[0], self.heads % FILTER_BITS)
        frequent[:2] = False
        self.words = np.where(frequent[self.words], self.words, -1)

    def pairs(self) -> np.ndarray:
        """For each place the number of the two words from there; -1 where one of them is rare."""
        after = np.append(self.words[1:], -1)
        return np.where((self.words >= 0) & (after >= 0), joint(self.heads[self.words], self.heads[after]), -1)

    def goes_on(self) -> np.ndarray:
        """For each place whether the two words from there may be a frequent pair."""
        pairs = self.pairs()
        return (pairs >= 0) & _has(self.filters[1], np.maximum(pairs, 0))

    def prefixes(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For k = 2 to ``longest``: k, for each place whether its first k words may be frequent, and their number from k = 3 on."""
        on = open_ = self.goes_on()
        numbers = self.heads[self.words]
        for k in range(2, longest + 1):
            numbers = mixed(numbers, np.append(self.heads[self.words[k - 1 :]], np.zeros(min(k - 1, len(numbers)), dtype=np.int64)))
            if k > 2:
                open_ = open_ & np.append(on[k - 2 :], np.full(min(k - 2, len(on)), False))
                if len(self.filters) > 2:
                    open_ = open_ & _has(self.filters[2], numbers % LONG_BITS)
            yield k, open_, numbers % LONG_BITS


class Words:
    """The frequent words, by the first 64 bits of their digests, all of which differ; other words are told by the next 64."""

    def __init__(self, salt: int, digests: list[bytes], heads: np.ndarray):
        both = np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        order = np.argsort(both[:, 0])
        self.salt, self.first, self.rest, self.heads = salt, both[order, 0], both[order, 1], heads[order]

    def numbers(self, chunk: Chunk) -> np.ndarray:
        """For each place of a chunk the number of its word, -1 where it is rare."""
        prefix = _prefix(self.salt, chunk.lang)
        used = np.unique(chunk.words[chunk.words >= 0])
        own = np.full(len(chunk.vocabulary), -1, dtype=np.int64)
        if len(used) and len(self.first):
            digests = b"".join(hashlib.sha256(prefix + chunk.vocabulary[x]).digest()[:16] for x in used.tolist())
            both = np.frombuffer(digests, dtype=">u8").astype(np.uint64).reshape(-1, 2)
            at = np.minimum(np.searchsorted(self.first, both[:, 0]), len(self.first) - 1)
            own[used] = np.where((self.first[at] == both[:, 0]) & (self.rest[at] == both[:, 1]), at, -1)
        return np.where(chunk.words >= 0, own[chunk.words], -1)


def _prefix(salt: int, lang: str) -> bytes:
    return b"%d" % salt + GAP + lang.encode() + GAP


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number of 32 bits from two such."""
    product = (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (product >> np.uint64(32)).astype(np.int64)


def joint(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of a pair of words from those of the two."""
    return mixed(left, right) % PAIR_BITS


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _chunks(batches, filters: list) -> Iterator[Chunk]:
    """A task's texts in chunks of one language, whole texts together; ``filters`` are broadcast."""
    filters = [f.value for f in filters]
    held: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
    waiting: Counter = Counter()
    for batch in batches:
        for lang, texts in _texts(batch):
            for text in texts:
                if lang not in held:
                    numbers: dict[bytes, int] = defaultdict()
                    numbers.default_factory = numbers.__len__
                    numbers[b""], numbers[b"\n"] = 0, 1
                    held[lang] = numbers, []
                numbers, parts = held[lang]
                parts.extend(own := list(_numbers(text, numbers)))
                waiting[lang] += sum(map(len, own))
                if waiting[lang] >= CHUNK:
                    del waiting[lang]
                    yield Chunk(lang, *held.pop(lang), filters)
        if sum(len(numbers) for numbers, _ in held.values()) >= HELD_WORDS:
            for lang in list(held):
                yield Chunk(lang, *held.pop(lang), filters)
            waiting.clear()
    for lang, (numbers, parts) in held.items():
        yield Chunk(lang, numbers, parts, filters)


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def _pair_counts(words, filters: list, buckets: int):
    """Counts the pairs of frequent words of a task: (bucket, steps, seconds, counts), the first words as steps from one to the next."""

    def run(batches):
        for chunk in _chunks(batches, filters):
            numbers = words.value.numbers(chunk)
            first, second = numbers[:-1], numbers[1:]
            both = (first >= 0) & (second >= 0)
            pairs, counts = np.unique(first[both] << 32 | second[both], return_counts=True)
            if not len(pairs):
                continue
            own = (mixed(pairs >> 32, pairs & 0xFFFFFFFF) % buckets).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order = np.argsort(own, kind="stable")
            own, pairs, counts = own[order], pairs[order], counts[order]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            steps = np.diff(pairs >> 32, prepend=0)
            steps[starts] = pairs[starts] >> 32
            steps, seconds, counts = (x.astype(np.uint32) for x in (steps, pairs & 0xFFFFFFFF, counts))
            rows = [(int(own[a]), *(x[a:b].tobytes() for x in (steps, seconds, counts))) for a, b in zip(starts, [*starts[1:], len(pairs)])]
            yield _rows(["bucket", "steps", "seconds", "counts"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()], rows)

    return run


def _frequent_pairs(words, least: int):
    """Adds up the pairs of each bucket: (first, second, at, n) of those that occur ``least`` times, ``at`` for the pairs' filter."""

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        pairs, counts = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        starts = np.flatnonzero(np.diff(pairs, prepend=-1))
        return [(pairs[starts], np.add.reduceat(counts, starts))]

    def out(held) -> pa.RecordBatch:
        ((pairs, counts),) = added(held)
        pairs, counts = pairs[counts >= least], counts[counts >= least]
        first, second = pairs >> 32, pairs & 0xFFFFFFFF
        known = words.value
        names = [known.first[side].astype(">u8").view("V8").tolist() for side in (first, second)]
        at = joint(known.heads[first], known.heads[second])
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.binary()) for x in names), pa.array(at), pa.array(counts)], names=["first", "second", "at", "n"])

    def run(batches):
        own, held, waiting, most = None, [], 0, WAITING
        for batch in batches:
            for bucket, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != own:
                    if held:
                        yield out(held)
                    own, held, waiting, most = bucket, [], 0, WAITING
                steps, seconds, counts = (np.frombuffer(x, np.uint32).astype(np.int64) for x in parts)
                held.append((np.cumsum(steps) << 32 | seconds, counts))
                waiting += len(steps)
                if waiting > most:
                    held = added(held)
                    waiting = len(held[0][0])
                    most = max(WAITING, 2 * waiting)
        if held:
            yield out(held)

    return run


def _long_counts(longest: int, filters: list, bucket_size: int):
    """Counts a task's phrases of three words or more whose pairs are frequent, by number: (bucket, steps, counts) as for pairs."""

    def run(batches):
        for chunk in _chunks(batches, filters):
            found = [numbers[may] for k, may, numbers in chunk.prefixes(longest) if k > 2]
            phrases, counts = np.unique(np.concatenate(found), return_counts=True)
            if not len(phrases):
                continue
            buckets = phrases // bucket_size
            starts = np.flatnonzero(np.diff(buckets, prepend=-1))
            steps = np.diff(phrases, prepend=0)
            steps[starts] = phrases[starts] % bucket_size
            steps, counts = steps.astype(np.uint32), counts.astype(np.uint32)
            rows = [(int(buckets[a]), steps[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(phrases)])]
            yield _rows(["bucket", "steps", "counts"], [pa.int64(), pa.binary(), pa.binary()], rows)

    return run


def _frequent_numbers(bucket_size: int, least: int):
    """Adds up the numbers of each bucket: (at) of those that occur ``least`` times."""

    def out(bucket: int, totals: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(totals >= least) + bucket * bucket_size)], names=["at"])

    def run(batches):
        held, totals = None, None
        for batch in batches:
            for bucket, steps, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != held:
                    if held is not None:
                        yield out(held, totals)
                    held, totals = bucket, np.zeros(bucket_size, dtype=np.int64)
                totals[np.cumsum(np.frombuffer(steps, np.uint32), dtype=np.int64)] += np.frombuffer(counts, np.uint32)
        if held is not None:
            yield out(held, totals)

    return run


def _suffixes(longest: int, filters: list, hot: np.ndarray, hot_pairs: np.ndarray, shortest: int = 1):
    """Counts the suffixes of a task that have ``shortest`` words: (lang, place, shared, suffix, n).

    Suffixes of one ``place`` go to one task. It is a hash of the first word; of the first two where that word is very frequent;
    of the whole suffix where the two are. ``shared`` is the number of first words whose counts are thus dealt out.
    """
    names = [f"w{k}" for k in range(longest)]

    def counted(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        words, columns = chunk.words, [chunk.words]
        for k, may, _ in chunk.prefixes(longest):
            later = np.append(words[k - 1 :], np.full(min(k - 1, len(words)), -1, dtype=words.dtype))
            columns.append(np.where(may, later, -1))
        starts = columns[shortest - 1] >= 0
        table = pa.table({n: pa.array(c[starts], mask=c[starts] < 0) for n, c in zip(names, columns)})
        table = table.group_by(names, use_threads=False).aggregate([([], "count_all")])
        spelled = pa.array(chunk.vocabulary, pa.large_binary())
        for batch in table.to_batches(max_chunksize=1 << 16):
            suffix = pc.binary_join_element_wise(*(spelled.take(batch.column(k)) for k in range(longest)), pa.scalar(GAP, pa.large_binary()), null_handling="skip")
            first, second = (batch.column(k).fill_null(-1).to_numpy() for k in (0, 1))
            pair = np.where(second >= 0, joint(chunk.heads[first], chunk.heads[second]), -1)
            place, shared = chunk.heads[first], np.isin(chunk.heads[first], hot).astype(np.int32)
            place = np.where((shared > 0) & (pair >= 0), pair, place)
            several = (shared > 0) & np.isin(pair, hot_pairs)
            shared[several] = longest
            own = np.fromiter((zlib.crc32(x) for x in suffix.filter(pa.array(several)).to_pylist()), np.int64, several.sum())
            place[several] = own
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk.lang] * len(first), pa.string()), pa.array(place), pa.array(shared), suffix, batch.column(longest).cast(pa.int64())],
                names=["lang", "place", "shared", "suffix", "n"],
            )

    def added(held: list[pa.RecordBatch]) -> pa.Table:
        keys = ["lang", "place", "shared", "suffix"]
        table = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([("n", "sum")])
        return table.rename_columns([*keys, "n"])

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by([("lang", "ascending"), ("suffix", "ascending")])  # neighbours are alike, which packs well
        table = table.set_column(3, "suffix", table.column(3).cast(pa.binary()))
        yield from table.to_batches(max_chunksize=1 << 16)

    def run(batches):
        held, waiting = [], 0
        for chunk in _chunks(batches, filters):
            for batch in counted(chunk):
                held.append(batch)
                waiting += len(batch)
            if waiting > HELD_WORDS:
                table = added(held)
                held, waiting = table.to_batches(), len(table)
                if waiting > HELD_WORDS // 2:
                    yield from out(table)
                    held, waiting = [], 0
        if held:
            yield from out(added(held))

    return run


def _count_prefixes(longest: int, least: int, shortest: int = 1):
    """Counts the prefixes of ``shortest`` words or more of sorted suffixes: (lang, phrase, words, f).

    Those below ``least`` are returned only where the count is shared.

    The stack of open phrases is one phrase of each length, with the counts so far. A batch is walked as a whole: a phrase
    closes where its words change, and what its last row leaves open is carried to the next batch.
    """

    def walk(lang: str, carried, suffixes, shared: np.ndarray, n: np.ndarray):
        counts = np.repeat(n[:, None], longest, axis=1)
        if carried:
            suffixes = pa.concat_arrays([pa.array([carried[0]], pa.binary()), suffixes])
            shared, counts = np.concatenate([[carried[1]], shared]), np.concatenate([carried[2][None, :], counts])
        lists = pc.split_pattern(suffixes, pattern=GAP)
        offsets = lists.offsets.to_numpy()
        lengths = np.diff(offsets)
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        rows, columns = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(words)) - np.repeat(offsets[:-1], lengths)
        matrix, ends = np.full((len(lengths), longest), -1), np.zeros((len(lengths), longest), dtype=np.int64)
        matrix[rows, columns] = words.dictionary_encode().indices.to_numpy()
        ends[rows, columns] = pc.binary_length(words).to_numpy() + 1
        ends = np.cumsum(ends, axis=1) - 1
        new = np.ones((len(lengths), longest), dtype=bool)
        np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1, out=new[1:])
        still = np.zeros(longest, dtype=np.int64)
        found = []
        for k in range(shortest - 1, longest):
            starts = np.flatnonzero(new[:, k])
            sums = np.add.reduceat(counts[:, k], starts)
            if matrix[-1, k] >= 0:
                still[k] = sums[-1]
                starts, sums = starts[:-1], sums[:-1]
            closed = (matrix[starts, k] >= 0) & ((sums >= least) | (shared[starts] > k))
            starts, sums = starts[closed], sums[closed]
            phrases = [s[:e] for s, e in zip(suffixes.take(pa.array(starts)).to_pylist(), ends[starts, k].tolist())]
            found.append((phrases, k + 1, sums))
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * sum(len(p) for p, _, _ in found), pa.string()),
                pa.array([x for p, _, _ in found for x in p], pa.binary()),
                pa.array(np.repeat([k for _, k, _ in found], [len(p) for p, _, _ in found]).astype(np.int32)),
                pa.array(np.concatenate([s for _, _, s in found])),
            ],
            names=["lang", "phrase", "words", "f"],
        )
        return batch, (suffixes[-1].as_py(), int(shared[-1]), still)

    def closing(lang: str, carried) -> pa.RecordBatch:
        suffix, shared, counts = carried
        words = suffix.split(GAP)
        rows = [(lang, GAP.join(words[: k + 1]), k + 1, int(counts[k])) for k in range(shortest - 1, len(words)) if shared > k or counts[k] >= least]
        return _rows(["lang", "phrase", "words", "f"], [pa.string(), pa.binary(), pa.int32(), pa.int64()], rows)

    def run(batches):
        lang, carried = None, None
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(langs[1:] != langs[:-1]) + 1]) if len(langs) else []
            for a, b in zip(starts, [*starts[1:], len(langs)]):
                if carried and langs[a] != lang:
                    yield closing(lang, carried)
                    carried = None
                lang = langs[a]
                part = batch.slice(a, b - a)
                found, carried = walk(lang, carried, part.column(2), part.column(1).to_numpy(), part.column(3).to_numpy())
                yield found
        if carried:
            yield closing(lang, carried)

    return run


def frequent_phrases(work: Workspace, texts: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``longest`` words that occur ``least`` times, and (lang, n)."""
    words, totals, pairs, suffixes, filters = counted_parts(work, texts, longest, least)
    placed = suffixes.repartition(shuffle_width(work.spark), "lang", "place").sortWithinPartitions(F.col("lang"), F.col("suffix").desc())
    found = placed.select("lang", "shared", "suffix", "n").mapInArrow(_count_prefixes(longest, least, 3), "lang string, phrase binary, words int, f long")
    # shared counts are added up
    found = found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    found = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f").unionByName(pairs).unionByName(found)
    phrases = work.save(found.withColumn("phrase", F.col("phrase").cast("string")), "phrases")
    for sent in filters:
        sent.unpersist()
    return phrases, totals


def counted_parts(work: Workspace, texts: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, list]:
    """Frequent words (lang, word, f), the number of all words (lang, n), frequent pairs (lang, phrase, words, f), the suffixes of
    three words or more as ``_suffixes`` has them, not yet computed, and the broadcast filters that they need."""
    spark = work.spark
    width = shuffle_width(spark)
    buckets = max(width, BUCKETS)
    counts = texts.mapInArrow(_word_counts, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    counts = work.save(counts.where((F.col("f") >= least) | F.col("word").isNull()), "words")
    totals = counts.where("word is null").select("lang", F.col("f").alias("n"))
    frequent = counts.where((F.col("f") >= least) & F.col("word").isNotNull())
    hashed = frequent.select("lang", "word", "f", F.crc32(F.concat(F.encode("lang", "utf-8"), F.lit(GAP), "word")).alias("head"))
    filters = [spark.sparkContext.broadcast(_filter(hashed.select(F.pmod("head", F.lit(FILTER_BITS)).alias("at")), FILTER_BITS))]
    for salt in itertools.count():  # until all frequent words differ in 64 bits, which the first does but for one time in millions
        digest = F.unhex(F.sha2(F.concat(F.lit(b"%d" % salt), F.lit(GAP), F.encode("lang", "utf-8"), F.lit(GAP), "word"), 256))
        named = hashed.select("lang", "word", "head", F.substring(digest, 1, 16).alias("digest"))
        known = named.select("digest", "head").toArrow()
        known = Words(salt, known.column("digest").to_pylist(), known.column("head").to_numpy())
        if (known.first[1:] != known.first[:-1]).all():
            break
    known = spark.sparkContext.broadcast(known)
    pairs = texts.mapInArrow(_pair_counts(known, filters, buckets), "bucket long, steps binary, seconds binary, counts binary")
    pairs = pairs.repartitionById(width, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    pairs = work.save(pairs.mapInArrow(_frequent_pairs(known, least), "first binary, second binary, at long, n long"), "pairs")
    known.unpersist()
    filters = [*filters, spark.sparkContext.broadcast(_filter(pairs.select("at"), PAIR_BITS))]
    # very frequent words and pairs have more than a partition's share of all: of each there are fewer than partitions
    share = (totals.agg(F.sum("n")).first()[0] or 0) / width
    hot, hot_pairs = (
        np.array(sorted({r[0] for r in df.where(F.col(n) > share).select(c).collect()}), dtype=np.int64) for df, c, n in ((hashed, "head", "f"), (pairs, "at", "n"))
    )
    spelled, n = pairs.select("first", "second", F.col("n").alias("f")), pairs.count()
    names = named.select("lang", "word", F.substring("digest", 1, 8).alias("id"))
    for side, columns in (("first", ("lang", "left")), ("second", (None, "right"))):
        used = pairs.groupBy(side).count().withColumnRenamed("count", "n")
        table = names.select(F.col("id").alias(side), *(F.col(c).alias(new) for c, new in zip(("lang", "word"), columns) if new))
        spelled = looked_up(spelled, work.save(used.join(table, side), side), [side], n)
    spelled = work.save(spelled.select("lang", F.concat("left", F.lit(GAP), "right").alias("phrase"), F.lit(2).alias("words"), "f"), "spelled")
    if longest > 2:
        size = -(-LONG_BITS // buckets)
        longer = texts.mapInArrow(_long_counts(longest, filters, size), "bucket long, steps binary, counts binary").repartitionById(width, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
        longer = work.save(longer.mapInArrow(_frequent_numbers(size, least), "at long"), "longer")
        filters = [*filters, spark.sparkContext.broadcast(_filter(longer, LONG_BITS))]
    kinds = "lang string, place long, shared int, suffix binary, n long"
    suffixes = texts.mapInArrow(_suffixes(longest, filters, hot, hot_pairs, 3), kinds) if longest > 2 else spark.createDataFrame([], kinds)
    return frequent, totals, spelled, suffixes, filters


def _filter(indexes: DataFrame, size: int) -> np.ndarray:
    """A bit set of ``size`` bits, with those of ``indexes`` (at); it reaches the driver in blocks of 64, size / 64 rows at most."""
    blocks = indexes.groupBy(F.shiftright("at", 6).alias("block")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    bits = np.zeros(max(size // 64, 1), dtype=np.uint64)
    bits[blocks.column("block").to_numpy()] = blocks.column("bits").to_numpy().view(np.uint64)
    return bits


def mine_collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 5,
    least: int = 100,
    subsumed_percent: int = 100,
    top: int = 2000,
) -> DataFrame:
    """The ``top`` phrases of two to ``longest`` words of each language whose words attract each other most.

    A phrase occurs a times, its first k words l times, the rest r times, among n words of the language: of its cuts the one
    with the lowest floor(1000 * a * n / (l * r)) counts, ties to the smallest k. Phrases below ``least`` occurrences are left
    out, and such as stand within a longer phrase that has ``subsumed_percent`` of their occurrences. Returns lang, rank, phrase,
    a, l, r, n, score, by score and a descending, then phrase in the order of its UTF-8 bytes. Whole numbers are exact.

    Nulls and odd rows: a null text is empty, a null language is ``und``; every row counts, also repeated ones. Texts are read
    whole, however long. An empty table gives an empty result. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "collocations")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    phrases, totals = frequent_phrases(work, texts, longest, least)
    # a phrase within a longer one is within one that has a single word more and is at least as frequent
    shorter = F.expr("array(substring_index(phrase, '\\u0000', words - 1), substring_index(phrase, '\\u0000', 1 - words))")
    covers = phrases.where("words > 2").select("lang", F.explode(shorter).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    candidates = phrases.where("words > 1").join(covers, ["lang", "phrase"], "left")
    candidates = candidates.where(F.col("longer").isNull() | (100 * F.col("longer") < subsumed_percent * F.col("f")))
    candidates = work.save(candidates.select("lang", "phrase", "words", F.col("f").alias("a")), "candidates")
    cut = F.expr("transform(sequence(1, words - 1), k -> struct(k as k, substring_index(phrase, '\\u0000', k) as head, substring_index(phrase, '\\u0000', k - words) as tail))")
    parts = work.save(candidates.withColumn("cut", F.explode(cut)).select("lang", "phrase", "a", "cut.k", "cut.head", "cut.tail"), "cuts")
    n = parts.count()
    for side, name in (("head", "l"), ("tail", "r")):
        used = parts.groupBy("lang", side).count().withColumnRenamed("count", "n")
        known = work.save(used.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side]), name)
        parts = looked_up(parts, known, ["lang", side], n)
    used = candidates.groupBy("lang").count()
    totals = totals.select("lang", F.col("n").alias("total")).join(used.withColumnRenamed("count", "n"), "lang")
    wide = {c: f"cast({c} as decimal(19,0))" for c in ("a", "total", "l", "r")}
    score = F.expr(f"(1000 * ({wide['a']} * {wide['total']})) div ({wide['l']} * {wide['r']})")
    scored = looked_up(parts, work.save(totals, "totals"), ["lang"], n).withColumn("score", score)
    scored = scored.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", _shown(F.col("phrase")).alias("phrase"), "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: What ``mine_collocations`` gives over ``documents`` in DuckDB's SQL.
COLLOCATIONS_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, row_number() OVER () AS piece, text FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS text FROM t)),
w AS (SELECT lang, piece, regexp_extract_all(text, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, words[i:i + k - 1] AS phrase FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w), range(1, 6) AS s(k) WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, phrase, len(phrase) AS k, count(*) AS f FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
s AS (SELECT lang, sub AS phrase, max(f) AS longer FROM (SELECT lang, f, unnest([phrase[1:k - 1], phrase[2:k]]) AS sub FROM f WHERE k > 2) GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN s USING (lang, phrase) WHERE k > 1 AND (longer IS NULL OR 100 * longer < 100 * f)),
u AS (SELECT lang, phrase, f AS a, k, unnest(range(1, k)) AS cut FROM c),
x AS (SELECT u.lang, u.phrase, a, l.f AS l, r.f AS r, n.n, cut, (1000::HUGEINT * a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.phrase[1:cut] JOIN f r ON r.lang = u.lang AND r.phrase = u.phrase[cut + 1:u.k] JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score FROM b)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o QUALIFY rank <= 2000
"""
