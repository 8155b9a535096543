"""Near-duplicate vectors by random projection passes.

Every pass draws random hyperplanes and joins the signs into a key. The vectors of one key are a run, and all pairs of a
run are compared exactly, so a pair is missed only where no pass gives both the same key; the number of passes follows
from the bits of a key and the wanted recall at the threshold, whatever the vectors' distribution. Runs longer than two
windows are dealt out as tiles of two blocks, so no task holds one whole. Equal vectors are one class before the passes,
so copies cost nothing. No pair leaves a task: a task returns sums of links and a spanning forest, and it counts a pair
only in the first pass where both have one key, which it knows from the keys each vector carries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, components, min_labels, shuffle_width, sorted_groups

#: A long run has so many blocks, or more where a block would be longer than WINDOWS_PER_BLOCK windows.
BLOCKS_PER_RUN, WINDOWS_PER_BLOCK = 16, 8
#: Rows of a block that are compared at once.
SLICE = 512


def usable(column) -> F.Column:
    """Whether a vector is not null, not empty, not all zeros, and has finite components only."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(column.isNotNull() & (F.size(column) > 0) & ~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def key_bits(n: int, window: int) -> int:
    """Bits of a key: the fewest at which ``n`` evenly spread vectors make runs of at most two windows."""
    return min(30, max(0, math.ceil(math.log2(max(n, 1) / (2 * window)))))


def passes_needed(bits: int, threshold: float, recall: float) -> int:
    """Passes after which a pair at the threshold has had one key in some pass with probability ``recall``."""
    same_sign = 1 - math.acos(threshold) / math.pi
    meet = same_sign**bits
    return 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _directions(table: pa.Table) -> np.ndarray:
    """The vectors at length 1; their largest components go first, so that no square overflows or vanishes."""
    flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = flat.astype(np.float64).reshape(table.num_rows, -1)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _keys(passes: int, bits: int, seed: int):
    """Adds the keys of all passes to batches of (cid, copies, dim, embedding)."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = table.filter(pa.array(dims == dim)).combine_chunks()
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), passes * bits))
                signs = (_directions(part) @ planes[dim] > 0).reshape(part.num_rows, passes, bits)
                keys = (signs @ (1 << np.arange(bits, dtype=np.int64)[::-1])).astype(np.int32)
                offsets = np.arange(0, keys.size + 1, passes, dtype=np.int32)
                yield from part.append_column("keys", pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))).to_batches()

    return run


def joined(root: np.ndarray, rows: np.ndarray, others: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches, once ``linked`` (rows x others) is added to what ``root`` already joins.

    Each turn links every node to one that it does not reach yet, so that no list of all pairs is made.
    """
    while True:
        pairs = linked & (root[rows][:, None] != root[others])
        down, across = np.flatnonzero(pairs.any(axis=1)), np.flatnonzero(pairs.any(axis=0))
        if not len(down):
            return root
        left = np.concatenate([rows[down], rows[pairs[:, across].argmax(axis=0)]])
        right = np.concatenate([others[pairs[down].argmax(axis=1)], others[across]])
        root = min_labels(len(root), root[left], root[right])[root]


def _compare(threshold: float):
    """Compares the pairs of each tile; see the module's text for what it returns."""

    def run(batches):
        for (_, number, _, left, right), table in sorted_groups(batches, ["dim", "pass", "key", "left", "right"]):
            if table.num_rows < 2:
                continue
            x = _directions(table)
            cid, copies, block = (table.column(c).to_numpy() for c in ("cid", "copies", "block"))
            copies = copies.astype(np.float64)
            earlier = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(x), -1)[:, :number].T
            rows = np.flatnonzero(block == left)
            others = rows if left == right else np.flatnonzero(block == right)
            y, y_earlier = x[others], np.ascontiguousarray(earlier[:, others])
            links, root = np.zeros(len(x)), np.arange(len(x))
            for at in range(0, len(rows), SLICE):
                some = rows[at : at + SLICE]
                linked = x[some] @ y.T >= threshold
                if left == right:
                    linked &= np.arange(len(others)) < np.arange(at, at + len(some))[:, None]
                for mine, theirs in zip(earlier[:, some], y_earlier):
                    if not linked.any():
                        break
                    linked &= mine[:, None] != theirs
                if linked.any():
                    links[some] += linked @ copies[others]
                    links[others] += copies[some] @ linked
                    root = joined(root, some, others, linked)
            seen = np.flatnonzero(links)
            if len(seen):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[seen]), pa.array(cid[root[seen]]), pa.array(links[seen].astype(np.int64))], names=["a", "b", "links"]
                )

    return run


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    window: int = 512,
    recall: float = 0.999,
    seed: int = 17,
) -> DataFrame:
    """Links of vectors whose cosine is at least ``threshold``.

    Returns vec_id long, n_links long (other vectors linked directly), component_id long (smallest id reachable, itself
    included), kept boolean, n_copies long (vectors equal to it, itself included).

    Nulls and odd rows: a vector that is null, empty, zero or has null or non-finite components links with nothing, and
    is kept. So does a row with a null id. Every row is a vector of its own, also where rows share an id. Vectors of
    different lengths never link. An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "embedding-dedup")
    width = shuffle_width(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    equal = good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = work.save(equal.withColumn("dim", F.size("embedding")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    bits = key_bits(classes.count(), window)
    passes = passes_needed(bits, threshold, recall)
    kind = classes.schema["embedding"].dataType.simpleString()
    keyed = classes.select("cid", "copies", "dim", "embedding").mapInArrow(
        _keys(passes, bits, seed), f"cid long, copies long, dim int, embedding {kind}, keys array<int>"
    )
    keyed = work.save(keyed, "keyed")
    runs = keyed.select("dim", F.posexplode("keys").alias("pass", "key")).groupBy("dim", "pass", "key").agg(F.count("*").alias("n"))
    long_block = F.least(F.greatest(F.col("n") / BLOCKS_PER_RUN, F.lit(window)), F.lit(WINDOWS_PER_BLOCK * window))
    long_runs = runs.where(F.col("n") > 2 * window).select("dim", "pass", "key", F.ceil(F.col("n") / long_block).cast("int").alias("n_blocks"))
    long_runs = work.save(long_runs, "long_runs")
    spread = keyed.select("cid", "copies", "dim", "embedding", "keys", F.posexplode("keys").alias("pass", "key")).join(
        long_runs, ["dim", "pass", "key"], "left"
    )
    spread = spread.withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("n_blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    tiles = spread.select(
        "dim", "pass", "key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "cid", "copies", "embedding", "keys"
    )
    found = work.save(
        tiles.repartition(width, "dim", "pass", "key", "left", "right")
        .sortWithinPartitions("dim", "pass", "key", "left", "right")
        .mapInArrow(_compare(threshold), "a long, b long, links long"),
        "found",
    )
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    parts = work.save(components(work, found.select("a", "b"), "parts").withColumnRenamed("node", "cid"), "parts")
    names = parts.join(classes.select("cid", "least"), "cid").groupBy("component").agg(F.min("least").alias("name"))
    parts = parts.join(work.save(names, "names"), "component")
    of_class = classes.select("cid", "copies", "least", F.col("embedding").alias("_e")).join(links, "cid", "left").join(parts, "cid", "left")
    of_class = work.save(of_class.where("copies > 1 or component is not null"), "of_class")  # all others are single vectors without links
    work.drop("keyed", "long_runs", "found", "parts", "names")
    name = F.coalesce("name", "least", "vec_id")
    return (
        rows.withColumn("_e", F.when(F.col("vec_id").isNotNull() & usable(F.col("embedding")), F.col("embedding")))
        .select("vec_id", "_e")
        .join(of_class, "_e", "left")
        .select(
            "vec_id",
            (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
            name.alias("component_id"),
            F.coalesce(name == F.col("vec_id"), F.lit(True)).alias("kept"),
            F.coalesce("copies", F.lit(1)).alias("n_copies"),
        )
    )
