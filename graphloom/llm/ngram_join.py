"""Near-duplicate texts by an n-gram Jaccard join over a MinHash LSH forest.

Texts with the same words are one class. Each class gets a signature of min-hashes, cut into one label for each tree of the
forest: a label packs its hashes most significant first, so sorted labels are the tree's prefix trie, and the longest prefix that a
text shares with any other one is what it shares with its two neighbours (``matched_prefixes``). A text starts in each tree at
that matched prefix, and shortens its longest ones, one hash at a time, until a pair at the threshold is met with the target
recall (``shortened``). Prefixes never go below the length ``least_prefix`` at which all trees together reach the recall; a tree
in which a text matches less than that is left out for it.

No link is lost by following the matches: a pair is missed only if it shares less than the text's prefix in every tree, but then
the matched prefixes, and so the choice of prefixes, are those that the other texts alone would give, and over the draws of the
pair's own hashes the product that ``shortened`` bounds is the probability of a miss.

Classes that meet are bundled (connected components over star edges, never pairs). The members of a large bundle are sorted by
label and cut into blocks; two blocks are a tile if members of both share a node, and only tiles are compared, exactly, on
shingle sets. A task returns sums of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import HUBS, MOST_EDGES, Workspace, components, min_labels, shuffle_width, sorted_groups, sums_before

#: Words of a shingle, and the least similarity of a link.
SHINGLE, THRESHOLD = 5, 0.8
#: A label of 5 hashes of 12 bits; the prefixes in use, of 4 or more, are long enough to keep 10**11 texts apart.
TREES, DEPTH, BITS = 16, 5, 12
#: A node's blocks are paired in parts of so many. A row that repeats more often than its share, were there HUBS such rows, is a hot one.
PAIRED = 64
#: A block of a tile has so many texts at most, fewer where texts have many shingles: BLOCK texts of SHINGLES each fill it.
BLOCK, SHINGLES = 256, 1000
#: Longer words are hashed before the text is; texts are hashed in pieces of so many bytes.
LONG_WORD, PIECE = 1024, 1 << 20

_M = np.uint64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MULTIPLY = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for ``n`` places at least."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str) -> list[str]:
    """Lower-case words between white space."""
    words = text.lower().split()
    if any(len(w) > LONG_WORD for w in words):
        words = [w if len(w) <= LONG_WORD else hashlib.blake2b(w.encode(), digest_size=32).hexdigest() for w in words]
    return words


def shingle_hashes(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``size`` words; a shorter text is one shingle, an empty one has none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    out, begin = [], 0
    size = min(size, len(words))
    while begin + size <= len(words):
        end, length = begin, 0
        while end < len(words) and (length < PIECE or end < begin + size):
            length += len(words[end]) + 1
            end += 1
        data = np.frombuffer(" ".join(words[begin:end]).encode(), dtype=np.uint8)
        up, down = _power_tables(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        blanks = np.flatnonzero(data == 32)
        starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(data)]])
        starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
        out.append((total[ends] - total[starts]) * down[starts])
        if end == len(words):
            break
        begin = end - size + 1
    return np.unique(_mix(np.concatenate(out)))


def forest_labels(shingles: np.ndarray) -> np.ndarray:
    """One label for each tree: DEPTH min-hashes of BITS bits, the first most significant."""
    low = np.full(TREES * DEPTH, _M)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        np.minimum(low, (_MULTIPLY[:, None] * part[None, :] + _ADD[:, None]).min(axis=1), out=low)
    digits = (_mix(low) >> np.uint64(64 - BITS)).astype(np.int64).reshape(TREES, DEPTH)
    return digits @ (1 << (BITS * np.arange(DEPTH, dtype=np.int64)[::-1]))


def least_prefix(threshold: float, recall: float) -> int:
    """The longest prefix at which pairs at the threshold meet in some tree with ``recall``; 1 if there is none."""
    return max((x for x in range(1, DEPTH + 1) if (1 - threshold**x) ** TREES <= 1 - recall), default=1)


@functools.lru_cache(maxsize=1 << 16)
def shortened(matched: tuple[int, ...], threshold: float, recall: float) -> tuple[int, ...]:
    """A text's prefix length in each tree: the matched ones (0: the tree is left out), the longest shortened until they reach ``recall``."""
    least, lengths = least_prefix(threshold, recall), list(matched)
    while math.prod(1 - threshold ** (x or least) for x in lengths) > 1 - recall and max(lengths) > least:
        lengths[lengths.index(max(lengths))] -= 1
    return tuple(lengths)


def matched_prefixes(work: Workspace, labels: DataFrame, least: int) -> DataFrame:
    """(node, tree, label, matched): the longest prefix, in hashes, that a label shares with another one of its tree, ``least`` or more.

    The labels are sorted by ranges, and each is held against the one before and the one after; a range's first and last label
    meet their neighbours through a table with a row for each range.
    """
    own = F.struct("tree", "label", "node")
    ranges = labels.repartitionByRange(shuffle_width(work.spark), "tree", "label", "node").withColumn("_range", F.spark_partition_id())
    ranges = work.save(ranges, "sorted_labels")
    ends = ranges.groupBy("_range").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    along = Window.orderBy("_range")
    ends = ends.select("_range", F.lag("last").over(along).alias("_before"), F.lead("first").over(along).alias("_after"))
    inside = Window.partitionBy("_range").orderBy("tree", "label", "node")
    out = ranges.withColumns({"before": F.lag(own).over(inside), "after": F.lead(own).over(inside)})
    out = out.join(F.broadcast(ends), "_range")  # bounded: a row for each shuffle partition

    def common(other: F.Column) -> F.Column:
        found = F.lit(0)
        for x in range(least, DEPTH + 1):
            cut = lambda c: F.shiftright(c, BITS * (DEPTH - x))  # noqa: B023, E731
            found = F.when(cut(other["label"]) == cut(F.col("label")), x).otherwise(found)
        return F.coalesce(F.when(other["tree"] == F.col("tree"), found), F.lit(0))

    matched = F.greatest(common(F.coalesce("before", "_before")), common(F.coalesce("after", "_after")))
    return out.withColumn("matched", matched).where(F.col("matched") >= least).select("node", "tree", "label", "matched")


def _shorten(threshold: float, recall: float):
    """From the matched prefixes of each text (node, trees) its own ones: (node, tree, label, length)."""

    def run(batches):
        for batch in batches:
            rows = []
            for node, trees in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                matched = [0] * TREES
                for t in trees:
                    matched[t["tree"]] = t["matched"]
                lengths = shortened(tuple(matched), threshold, recall)
                rows += [(node, t["tree"], t["label"], lengths[t["tree"]]) for t in trees]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["node", "tree", "label", "length"])

    return run


def shared_nodes(work: Workspace, labels: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(node, tree, prefix, least): the trie nodes that texts share, with the smallest text of each.

    A text takes all that lie below its prefix to its node, so a node is cut where any text below it is: from the shortest
    prefix down, what no text there has chosen is looked at again one hash longer.
    """
    least = least_prefix(threshold, recall)
    matched = matched_prefixes(work, labels, least)
    chosen = matched.groupBy("node").agg(F.collect_list(F.struct("tree", "label", "matched")).alias("trees"))  # TREES at most
    rest = work.save(chosen.mapInArrow(_shorten(threshold, recall), "node long, tree int, label long, length int"), "chosen")
    settled = None
    for x in range(least, DEPTH + 1):
        rest = rest.withColumn("prefix", F.col("label") - F.pmod("label", F.lit(1 << BITS * (DEPTH - x))))
        groups = rest.groupBy("tree", "prefix").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.min("length").alias("shortest"))
        groups = work.save(groups.where("most > least"), f"groups-{x}")
        joined = work.save(rest.join(groups.hint("merge"), ["tree", "prefix"]), f"nodes-{x}")
        here = joined.where(F.col("shortest") <= x).select("node", "tree", "prefix", "least")
        settled = here if settled is None else settled.unionByName(here)
        rest = joined.where(F.col("shortest") > x).select("node", "tree", "label", "length")
    return settled


def _signatures(batches):
    for batch in batches:
        texts = batch.column(2)
        classes, sizes, labels = [], [], []
        for i in range(batch.num_rows):
            words = words_of(texts[i].as_py() or "")
            shingles = shingle_hashes(words)
            classes.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest() if words else None)
            sizes.append(len(shingles))
            labels.append(forest_labels(shingles) if words else np.zeros(0, dtype=np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(labels, pa.list_(pa.int64()))],
            names=["doc_id", "text_key", "class", "size", "labels"],
        )


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets, by products of their incidence matrix in slices."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    everything, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(everything, kind="stable")
    everything, owner = everything[order], owner[order]
    new = np.concatenate([[True], everything[1:] != everything[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    column, owner = column[often], owner[often]
    result = np.zeros((n, n), dtype=np.float64)
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        edges = np.searchsorted(column, np.arange(0, column[-1] + 4097, 4096))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            incidence = np.zeros((n, 4096), dtype=np.float32)
            incidence[owner[a:b], column[a:b] - k * 4096] = 1
            result += incidence @ incidence.T
    np.fill_diagonal(result, [len(s) for s in sets])
    return result.astype(np.int64)


def _verify(threshold: float):
    def run(batches):
        for (_, left, right), table in sorted_groups(_without_repeats(batches), ["bundle", "left", "right"]):
            if table.num_rows < 2:
                continue
            node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
            sets = [shingle_hashes(words_of(x)) for x in table.column("text").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            both = shared_counts(sets)
            linked = np.triu(both / (sizes[:, None] + sizes[None, :] - both) >= threshold, 1)
            if left != right:
                linked &= block[:, None] != block[None, :]
            i, j = np.nonzero(linked)
            if len(i):
                links = np.bincount(i, weights=copies[j], minlength=len(node)) + np.bincount(j, weights=copies[i], minlength=len(node))
                seen = np.flatnonzero(links)
                root = min_labels(len(node), i, j)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[seen]), pa.array(node[root[seen]]), pa.array(links[seen].astype(np.int64))], names=["a", "b", "links"]
                )

    return run


def _tiles(work: Workspace, members: DataFrame, shared: DataFrame) -> DataFrame:
    """The members (node, doc_id, text_key, copies, bundle), once for each tile (left, right) that their block is in.

    A bundle that fits one block is one tile. A larger one is sorted by label and cut into blocks; its tiles are the pairs
    of blocks with a common node of a trie in ``shared``.
    """
    full = BLOCK * SHINGLES
    weights = members.groupBy("bundle").agg(F.sum("weight").alias("total"))
    large = work.save(weights.where(F.col("total") > full).select("bundle", F.lit(True).alias("large")), "large")
    members = work.save(members.join(large, "bundle", "left"), "weighed")
    columns = ("node", "doc_id", "text_key", "copies", "bundle")
    small = members.where("large is null").select(*columns, *(F.lit(0).cast("long").alias(c) for c in ("block", "left", "right")))
    order = [F.col("bundle"), F.col("place"), F.col("node")]
    sorted_members = sums_before(work, members.where("large"), order, {"before": "weight"}, "sorted")
    blocks = work.save(sorted_members.select(*columns, F.floor(F.col("before") / full).alias("block")), "blocks")
    touched = shared.join(blocks.select("node", "bundle", "block"), "node").select("tree", "prefix", "bundle", "block").distinct()
    touched = work.save(touched, "touched")
    sizes = touched.groupBy("tree", "prefix").agg(F.count("*").alias("n"))
    touched = work.save(touched.join(sizes.hint("merge"), ["tree", "prefix"]).withColumn("parts", F.ceil(F.col("n") / PAIRED)), "sized")
    # no task makes all pairs of a node: one side is dealt out to parts, the other goes to all of them
    left = touched.where("n > 1").select("tree", "prefix", "bundle", F.col("block").alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = touched.where("n > 1").select("tree", "prefix", F.col("block").alias("right"), F.pmod("block", "parts").alias("part"))
    pairs = left.join(right, ["tree", "prefix", "part"]).where("left <= right").select("bundle", "left", "right")
    pairs = pairs.unionByName(touched.where("n = 1").select("bundle", F.col("block").alias("left"), F.col("block").alias("right"))).distinct()
    sides = work.save(pairs.withColumn("block", F.explode(F.array_distinct(F.array("left", "right")))), "sides")
    tiled = blocks.join(sides, ["bundle", "block"]).select(*columns, "block", "left", "right")
    return work.save(small.unionByName(tiled), "tiles")


def once(own: DataFrame, signed: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, text) of which those that repeat very often stand once.

    Their keys, fewer than HUBS, are told by broadcast, so that their copies meet in the tasks where they lie and never by a
    shuffle; what repeats less goes on, and ``_verify`` passes over it.
    """
    counts = signed.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") > max(MOST_EDGES, signed.count() // HUBS)).select("doc_id", "text_key")
    hot = own.join(F.broadcast(often), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return own.join(F.broadcast(often), ["doc_id", "text_key"], "left_anti").unionByName(hot)


def _without_repeats(batches):
    """Rows sorted by tile and node, the first of each node in a tile."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("bundle", "left", "right", "node")])
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        new[0] = held is None or (keys[0] != held).any()
        held = keys[-1]
        yield batch if new.all() else batch.filter(pa.array(new))


def near_duplicate_texts(docs: DataFrame, threshold: float = THRESHOLD, recall: float = 0.9997, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links between texts whose sets of five-word shingles have a Jaccard similarity of at least ``threshold``.

    Words are lower-case and stand between white space. Returns a row for each row: doc_id, n_links long (other documents
    linked directly), component_id long (smallest id reachable, itself included), kept boolean (doc_id = component_id),
    n_copies long (documents with the same words, itself included).

    Nulls and odd rows: texts without words (null or blank) link with nothing and are kept; texts of one to four words are
    one shingle. Every row is a document of its own, also where rows share an id; a row with a null id has no links and is
    kept. Whole texts are read, however long. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "ngram-join")
    width = shuffle_width(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = own.select("doc_id", "text_key", "text").mapInArrow(_signatures, "doc_id long, text_key long, class binary, size long, labels array<long>")
    signed = work.save(signed, "signed")
    real_class = F.when(F.col("doc_id").isNotNull(), F.col("class"))
    first = F.min(F.struct("doc_id", "text_key", "size", "labels"))  # size and labels are the class's own
    classes = signed.where(real_class.isNotNull()).groupBy("class").agg(first.alias("x"), F.count("*").alias("copies"))
    classes = work.save(classes.select("class", "x.*", "copies").withColumn("node", F.monotonically_increasing_id()), "classes")
    shared = shared_nodes(work, classes.select("node", F.posexplode("labels").alias("tree", "label")), threshold, recall)
    bundles = components(work, shared.select(F.col("node").alias("a"), F.col("least").alias("b")), "bundles")
    bundles = work.save(bundles.withColumnRenamed("component", "bundle"), "bundles")
    work.drop("sorted_labels", "chosen")
    members = classes.select("node", "doc_id", "text_key", "copies", (F.col("size") + SHINGLES).alias("weight"), F.col("labels")[0].alias("place"))
    members = _tiles(work, members.join(bundles, "node"), shared)
    # by a shuffle at every size, so that small inputs show what large ones cost
    texts = once(own, signed).join(members.hint("merge"), ["doc_id", "text_key"]).select("bundle", "left", "right", "node", "block", "copies", "text")
    found = work.save(
        texts.repartition(width, "bundle", "left", "right").sortWithinPartitions("bundle", "left", "right", "node").mapInArrow(_verify(threshold), "a long, b long, links long"),
        "found",
    )
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    parts = work.save(components(work, found.select("a", "b"), "parts"), "parts")
    names = parts.join(classes.select("node", F.col("doc_id").alias("least")), "node").groupBy("component").agg(F.min("least").alias("name"))
    parts = parts.join(work.save(names, "names"), "component")
    of_class = classes.select("class", "node", F.col("doc_id").alias("least"), "copies").join(links, "node", "left").join(parts, "node", "left")
    of_class = work.save(of_class.where("copies > 1 or component is not null").drop("node", "component"), "of_class")
    work.drop("classes", "bundles", "large", "weighed", "sorted", "blocks", "touched", "sized", "sides", "tiles", "found", "parts", "names")
    work.drop(*(f"{name}-{x}" for x in range(1, DEPTH + 1) for name in ("groups", "nodes")))
    root = F.coalesce("name", "least", "doc_id")
    return (
        signed.select("doc_id", real_class.alias("class"))
        .join(of_class, "class", "left")
        .select(
            "doc_id",
            (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
            root.alias("component_id"),
            F.coalesce(root == F.col("doc_id"), F.lit(True)).alias("kept"),
            F.coalesce("copies", F.lit(1)).alias("n_copies"),
        )
    )


#: What ``near_duplicate_texts`` gives over ``documents`` in DuckDB's SQL; for small inputs.
JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE c / (x.n + y.n - c) >= 0.8),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT doc_id, count(l.b)::BIGINT AS n_links FROM w LEFT JOIN l ON l.a = w.doc_id GROUP BY doc_id),
t AS (SELECT array_to_string(words, ' ') AS t, count(*) AS c FROM w GROUP BY 1)
SELECT k.doc_id, n_links, min(r.b) AS component_id, k.doc_id = min(r.b) AS kept, CASE WHEN len(any_value(w.words)) = 0 THEN 1 ELSE any_value(t.c) END::BIGINT AS n_copies
FROM k JOIN r ON r.a = k.doc_id JOIN w ON w.doc_id = k.doc_id JOIN t ON t.t = array_to_string(w.words, ' ') GROUP BY k.doc_id, n_links
"""
