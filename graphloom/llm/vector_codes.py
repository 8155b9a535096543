"""Vector codes by product quantisation in whole numbers.

Components become integers, vectors are cut into parts, and each part position has a codebook of a few entries. A round
broadcasts a kd-tree of every codebook, finds each part's nearest entry, and sums the parts of each entry; the sums are added
up by Spark and replace the entries. The search is by branch and bound over the trees' boxes: a box is left out only if it lies
farther away than the best entry so far, so one that is as near is still opened and of equally near entries the lowest wins.
All sums and distances are exact.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, looked_up

#: Parts of a vector, entries of a codebook, rounds, and what components are multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components beyond this count as this, so that sums over 2**36 vectors fit 38 digits.
LARGEST = 2**90
#: A leaf of a tree has so many entries at most. Sums travel in slices of so many positions.
LEAF, SLICE = 8, 64
#: Lengths of vectors are treated together as long as their codebooks have no more components than this.
BOOK_COMPONENTS = 1 << 24
MOST_LONG = 2**63 - 1


def finite(column) -> F.Column:
    """Whether a vector is not null and has neither null nor non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(column.isNotNull() & ~bad, F.lit(False))


def cuts(dim: int, parts: int) -> list[int]:
    """Where a vector is cut: parts are equal if ``dim`` is a multiple of ``parts``, and differ by one otherwise."""
    return [dim * k // parts for k in range(parts + 1)]


def whole_numbers(x: np.ndarray, scale: int, part: int, largest: int = 0) -> np.ndarray:
    """floor(scale * x); as 64-bit integers if squared distances over ``part`` positions fit them, else as Python's."""
    bound = float(LARGEST)
    floors = np.clip(np.floor(np.clip(x.astype(np.float64), -bound, bound) * scale), -bound, bound)
    top = max(int(np.abs(floors).max(initial=0)), largest)
    if max(part, 1) * (2 * top) ** 2 < 2**62:
        return floors.astype(np.int64)
    return np.array([int(v) for v in floors.ravel()], dtype=object).reshape(floors.shape)


@dataclass
class Node:
    """A box (low, high) around some entries: a leaf with their numbers and values, or two nodes below."""

    low: np.ndarray
    high: np.ndarray
    numbers: np.ndarray
    values: np.ndarray | None = None
    below: tuple | None = None

    def away(self, x: np.ndarray) -> np.ndarray:
        """Squared distances from the box, which no entry in it comes under."""
        outside = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        return (outside * outside).sum(axis=1)


def kd_tree(entries: np.ndarray, numbers: np.ndarray | None = None) -> Node:
    """Splits at the median of the widest dimension until a leaf has LEAF entries, or its entries are all equal."""
    numbers = np.arange(len(entries)) if numbers is None else numbers
    own = entries[numbers]
    low, high = (own.min(axis=0), own.max(axis=0)) if own.shape[1] else (own[0], own[0])
    widest = int(np.argmax(high - low)) if own.shape[1] else 0
    if len(numbers) <= LEAF or not own.shape[1] or high[widest] == low[widest]:
        return Node(low, high, numbers, own)
    order = numbers[np.argsort(own[:, widest], kind="stable")]
    half = len(order) // 2
    return Node(low, high, numbers, below=(kd_tree(entries, np.sort(order[:half])), kd_tree(entries, np.sort(order[half:]))))


def nearest(tree: Node, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest entry's number, the lowest of equally near ones, and the squared distance."""
    at = np.zeros(len(x), dtype=np.int64)
    best = np.full(len(x), np.iinfo(np.int64).max) if x.dtype != object else np.full(len(x), 1 << 400, dtype=object)

    def visit(node: Node, rows: np.ndarray) -> None:
        if node.values is not None:
            apart = x[rows][:, None, :] - node.values[None, :, :]
            squares = (apart * apart).sum(axis=2)
            for number, found in zip(node.numbers, squares.T):
                better = ((found < best[rows]) | ((found == best[rows]) & (number < at[rows]))).astype(bool)
                best[rows[better]], at[rows[better]] = found[better], number
            return
        away = [child.away(x[rows]) for child in node.below]
        left_first = (away[0] <= away[1]).astype(bool)
        for near in (True, False):
            for child, bound, goes in zip(node.below, away, (left_first == near, left_first != near)):
                some = rows[goes]
                some = some[(bound[goes] <= best[some]).astype(bool)]  # an equal bound may hide a lower number
                if len(some):
                    visit(child, some)

    if len(x):
        visit(tree, np.arange(len(x)))
    return at, best


def _by_length(batch: pa.RecordBatch):
    """(dim, rows, vectors as doubles) of each length in a batch with columns dim and embedding."""
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    for dim in np.unique(dims).tolist():
        part = batch.filter(pa.array(dims == dim))
        flat = part.column(part.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False)
        yield dim, part, flat.astype(np.float64).reshape(part.num_rows, dim)


class Books:
    """The codebooks of some lengths: for each length and part position, an array of entries and its tree."""

    def __init__(self, entries: dict[int, list[np.ndarray]], parts: int, scale: int):
        self.entries, self.parts, self.scale = entries, parts, scale
        self.largest = {d: max((int(abs(v)) for b in books for v in b.ravel()), default=0) for d, books in entries.items()}
        self.trees = {d: [kd_tree(b) for b in books] for d, books in entries.items()}

    def assign(self, dim: int, vectors: np.ndarray):
        """For each part position: the parts as integers, their entries' numbers, the squared distances."""
        at = cuts(dim, self.parts)
        x = whole_numbers(vectors, self.scale, max(b - a for a, b in zip(at, at[1:])), self.largest[dim])
        for tree, a, b in zip(self.trees[dim], at, at[1:]):
            yield x[:, a:b], *nearest(tree, x[:, a:b])

    def digest(self, dim: int) -> str:
        return hashlib.sha256(",".join(str(int(v)) for book in self.entries[dim] for v in book.ravel()).encode()).hexdigest()


SUMS = "dim int, part int, entry int, slice int, n long, sums array<decimal(38,0)>"


def _sums(books):
    """Sums the parts of each entry over a task."""

    def run(batches):
        own: Books = books.value
        totals: dict[int, list] = {}
        for batch in batches:
            for dim, _, vectors in _by_length(batch):
                held = totals.setdefault(dim, [(np.zeros(len(b), dtype=np.int64), np.zeros(b.shape, dtype=object)) for b in own.entries[dim]])
                for (counts, sums), (x, at, _) in zip(held, own.assign(dim, vectors)):
                    counts += np.bincount(at, minlength=len(counts))
                    part = np.zeros(sums.shape, dtype=x.dtype)
                    np.add.at(part, at, x)
                    sums += part.astype(object)
        for dim, held in totals.items():
            rows = [
                (dim, part, entry, s, int(counts[entry]), [Decimal(int(v)) for v in sums[entry, s * SLICE : (s + 1) * SLICE]])
                for part, (counts, sums) in enumerate(held)
                for entry in np.flatnonzero(counts).tolist()
                for s in range(max(1, -(-sums.shape[1] // SLICE)))
            ]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)))
            names = ["dim", "part", "entry", "slice", "n", "sums"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def _codes(books):
    """Adds the code and its error to the rows of a task."""

    def run(batches):
        own: Books = books.value
        digests = {dim: own.digest(dim) for dim in own.entries}
        for batch in batches:
            for dim, rows, vectors in _by_length(batch):
                codes, errors = np.zeros((rows.num_rows, own.parts), dtype=np.uint8), np.zeros(rows.num_rows, dtype=object)
                for k, (_, at, squares) in enumerate(own.assign(dim, vectors)):
                    codes[:, k] = at
                    errors += squares.astype(object)
                text, wide = codes.tobytes().hex(), 2 * own.parts
                keep = [n for n in rows.schema.names if n not in ("dim", "embedding")]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(rows.schema.get_field_index(n)) for n in keep),
                        pa.array([text[i * wide : (i + 1) * wide] for i in range(rows.num_rows)], pa.string()),
                        pa.array([min(int(e), MOST_LONG) for e in errors], pa.int64()),
                        pa.array([digests[dim]] * rows.num_rows, pa.string()),
                    ],
                    names=[*keep, "code", "error", "codebooks_sha256"],
                )

    return run


def _replaced(books: Books, sums: DataFrame) -> Books:
    """The codebooks with every entry that has parts replaced by their mean, rounded down."""
    entries = {dim: [b.astype(object) for b in own] for dim, own in books.entries.items()}
    totals = [F.sum(F.get("sums", F.lit(i))) for i in range(SLICE)]
    # as many rows as the codebooks have slices, however many vectors there are
    for dim, part, entry, s, n, values in sums.groupBy("dim", "part", "entry", "slice").agg(F.sum("n"), F.array(*totals)).collect():
        book = entries[dim][part]
        for i in range(s * SLICE, min((s + 1) * SLICE, book.shape[1])):
            book[entry, i] = int(values[i - s * SLICE]) // n
    return Books({dim: [_compact(b) for b in own] for dim, own in entries.items()}, books.parts, books.scale)


def _compact(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(v) < 2**62 for v in book.ravel()) else book


def encode_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """A code of ``parts`` entry numbers for each vector, with codebooks of ``entries`` (256 at most) entries.

    A codebook starts as the parts of the vectors with the smallest ids. Returns vec_id, code string (two hex digits for each
    part), error long (squared distance from the coded vector), label_error long (error summed over equal labels, nulls
    together), codebooks_sha256 string, label.

    Nulls and odd rows: vectors that are null or hold null or non-finite components are dropped; zero vectors are like others,
    and an empty vector has empty parts, entry 0 in all. Every row is coded, also where rows repeat or share an id; the
    codebooks start from distinct ids, the smallest vector of each, a null id last. Fewer ids than ``entries`` make smaller
    codebooks. Vectors of different lengths have codebooks of their own; a length that ``parts`` does not divide is cut into
    parts that differ by one. Components beyond 2**90 once scaled count as 2**90, and errors beyond 64 bits as the largest
    long. An empty table gives an empty result. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part: at most 256 entries")
    spark = vectors.sparkSession
    work = Workspace(spark, "vector-codes")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    kept = rows.where(finite(F.col("embedding"))).withColumn("dim", F.size("embedding"))
    kind = kept.schema
    coded_schema = f"vec_id {kind['vec_id'].dataType.simpleString()}, label {kind['label'].dataType.simpleString()}, code string, error long, codebooks_sha256 string"

    first = F.row_number().over(Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last()))
    ids = kept.select("dim", "vec_id").distinct().withColumn("turn", first).where(F.col("turn") <= entries)
    ids = work.save(ids.select(F.col("dim").alias("_dim"), F.col("vec_id").alias("_id"), "turn"), "ids")
    # bounded: ``entries`` ids for each length
    seeds = kept.join(F.broadcast(ids), (F.col("dim") == F.col("_dim")) & F.col("vec_id").eqNullSafe(F.col("_id")))
    seeds = work.save(seeds.groupBy("dim", "turn").agg(F.min("embedding").alias("embedding")), "seeds")

    coded = []
    lengths = sorted(r.dim for r in seeds.select("dim").distinct().collect())
    while lengths:
        some = [lengths.pop(0)]
        while lengths and entries * (sum(some) + lengths[0]) <= BOOK_COMPONENTS:
            some.append(lengths.pop(0))
        books: dict[int, list[np.ndarray]] = {}
        for dim in some:
            own = [r.embedding for r in seeds.where(F.col("dim") == dim).orderBy("turn").collect()]  # ``entries`` rows at most
            at = cuts(dim, parts)
            x = whole_numbers(np.array(own, dtype=np.float64).reshape(len(own), dim), scale, max(b - a for a, b in zip(at, at[1:])))
            books[dim] = [x[:, a:b] for a, b in zip(at, at[1:])]
        current = Books(books, parts, scale)
        of_these = kept.where(F.col("dim").isin(some))
        for number in range(rounds):
            sent = spark.sparkContext.broadcast(current)
            sums = of_these.select("dim", "embedding").mapInArrow(_sums(sent), SUMS)
            current = _replaced(current, sums)
            sent.unpersist()
        sent = spark.sparkContext.broadcast(current)
        coded.append(work.save(of_these.mapInArrow(_codes(sent), coded_schema), f"coded-{some[0]}"))
    if not coded:
        coded.append(spark.createDataFrame([], coded_schema))
    out = coded[0]
    for other in coded[1:]:
        out = out.unionByName(other)
    by_label = out.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n"))
    by_label = work.save(by_label.select("label", F.least("sum", F.lit(MOST_LONG)).cast("long").alias("label_error"), "n"), "labels")
    return looked_up(out, by_label, ["label"], out.count()).select("vec_id", "code", "error", "label_error", "codebooks_sha256", "label")


def _round_sql(before: str, after: str) -> str:
    return f"""
a{after} AS (SELECT vec_id, p, e, d FROM (SELECT x.vec_id, x.p, b.e, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b{before} b ON b.p = x.p AND b.i = x.i GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1),
m{after} AS (SELECT x.p, a.e, x.i, sum(x.c)::HUGEINT AS s, count(*)::HUGEINT AS n FROM x JOIN a{after} a ON a.vec_id = x.vec_id AND a.p = x.p GROUP BY ALL),
b{after} AS (SELECT b.p, b.e, b.i, CASE WHEN m.n IS NULL THEN b.c ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END::BIGINT AS c
  FROM b{before} b LEFT JOIN m{after} m ON m.p = b.p AND m.e = b.e AND m.i = b.i),"""


#: What ``encode_vectors`` gives over ``embeddings`` in DuckDB's SQL, where ids are unique and vectors of one length.
CODES_SQL = f"""
WITH k AS (SELECT vec_id, label, embedding, len(embedding) AS dim FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS (SELECT vec_id, (i * {PARTS} // dim) AS p, i % (dim // {PARTS}) AS i, floor({SCALE} * v::DOUBLE)::BIGINT AS c
  FROM (SELECT vec_id, dim, unnest(range(dim)) AS i, unnest(embedding) AS v FROM k)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < {ENTRIES}),
b0 AS (SELECT x.p, s.e, x.i, x.c FROM x JOIN s USING (vec_id)),
{"".join(_round_sql(str(r), str(r + 1)) for r in range(ROUNDS))}
f AS (SELECT vec_id, p, e, d FROM (SELECT x.vec_id, x.p, b.e, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b{ROUNDS} b ON b.p = x.p AND b.i = x.i GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1),
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f GROUP BY vec_id),
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256, label FROM c JOIN k USING (vec_id), h
"""
