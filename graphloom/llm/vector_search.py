"""Nearest neighbours by a block matrix join.

Candidates and queries are packed into blocks of int8 codes. A tile is the product of a query block and a candidate
block: it gives every distance with an error bound from the lengths of what the rounding left over. Pairs whose lower
bound lies above the k-th smallest upper bound cannot be among the nearest; the others are recomputed in double
precision from the original components, and a heap for each query keeps the k best over the tiles of a task. A last
window merges the tasks' heaps. The result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .embedding_dedup import usable
from .shared import Workspace, shuffle_width

PACKED = "dim int, ids binary, codes binary, scales binary, rest binary, vectors binary"
#: Components whose int8 products a float32 sum still holds exactly: 1024 * 127 * 127 < 2**24.
EXACT_DIMS = 1024
#: Squares below this may have lost digits; it is added to the error bounds.
TINY = 1e-290


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of the rows. Where squares overflow or vanish, the largest component is taken out first."""
    with np.errstate(all="ignore"):
        squares = (x * x).sum(axis=1)
        found = np.sqrt(squares)
        odd = np.flatnonzero(~((squares > TINY) & (squares < np.inf)))
        top = np.abs(x[odd]).max(axis=1, initial=0)
        rest = x[odd] / top[:, None]
        found[odd] = np.where((top > 0) & (top < np.inf), top * np.sqrt((rest * rest).sum(axis=1)), top)
    return found


def _pack(block_rows: int):
    """Packs the vectors of a partition into blocks of at most ``block_rows``, by dimension."""

    def block(dim: int, ids: list, rows: list) -> pa.RecordBatch:
        x = np.concatenate(rows)
        scale = np.abs(x).max(axis=1) / 127
        scale[scale < TINY] = 0  # such vectors are all rest
        codes = np.rint(np.divide(x, scale[:, None], out=np.zeros_like(x), where=scale[:, None] > 0))
        rest = lengths(x - codes * scale[:, None])
        values = (np.concatenate(ids), codes.astype(np.int8), scale, rest, x)
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)],
            names=["dim", "ids", "codes", "scales", "rest", "vectors"],
        )

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = table.filter(pa.array(dims == dim))
                flat = part.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                x, ids = flat.astype(np.float64).reshape(-1, dim), part.column("vec_id").to_numpy()
                for at in range(0, len(x), block_rows):
                    own_ids, own = held.setdefault(dim, ([], []))
                    own_ids.append(ids[at : at + block_rows])
                    own.append(x[at : at + block_rows])
                    if sum(map(len, own)) >= block_rows:
                        yield block(dim, *held.pop(dim))
        for dim, (own_ids, own) in held.items():
            yield block(dim, own_ids, own)

    return run


def _tiles(k: int):
    def unpack(row: dict, side: str):
        dim = row["dim"]
        return (
            np.frombuffer(row[f"{side}_ids"], np.int64),
            np.frombuffer(row[f"{side}_codes"], np.int8).reshape(-1, dim).astype(np.float32),
            np.frombuffer(row[f"{side}_scales"]),
            np.frombuffer(row[f"{side}_rest"]),
            np.frombuffer(row[f"{side}_vectors"]).reshape(-1, dim),
        )

    def tile(row: dict, heaps: dict[tuple, list]) -> None:
        q_ids, q_codes, q_scale, q_rest, q = unpack(row, "q")
        c_ids, c_codes, c_scale, c_rest, c = unpack(row, "c")
        product = np.zeros((len(q), len(c)))
        for at in range(0, row["dim"], EXACT_DIMS):
            product += q_codes[:, at : at + EXACT_DIMS] @ c_codes[:, at : at + EXACT_DIMS].T
        with np.errstate(all="ignore"):
            product *= q_scale[:, None] * c_scale[None, :]
            q_norm, c_norm = lengths(q), lengths(c)
            # |x.y - x^.y^| <= |x - x^||y| + |x^||y - y^|, and a little for the rounding of these sums themselves
            error = q_rest[:, None] * c_norm[None, :] + (q_norm + q_rest)[:, None] * c_rest[None, :]
            whole = (q_norm**2)[:, None] + (c_norm**2)[None, :]
            margin = 2 * error + 1e-9 * whole + TINY
            lower, upper = whole - 2 * product - margin, whole - 2 * product + margin
        # sums that overflow bound nothing: such pairs are recomputed
        own = q_ids[:, None] == c_ids[None, :]
        lower[np.isnan(lower)] = -np.inf
        upper[np.isnan(upper) | own] = np.inf
        for i in range(len(q)):
            heap = heaps.setdefault((q_ids[i].item(), row["q_block"], i), [])
            bound = np.partition(upper[i], k - 1)[k - 1] if len(c) > k else np.inf
            if len(heap) == k:
                bound = min(bound, heap[0][0] * heap[0][0] * (1 + 1e-9) + TINY)
            keep = np.flatnonzero((lower[i] <= bound) & ~own[i])
            with np.errstate(all="ignore"):
                exact = lengths(c[keep] - q[i])
            for j in np.lexsort((c_ids[keep], exact))[:k]:
                entry = (-exact[j].item(), -c_ids[keep[j]].item())
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                else:
                    break

    def out(heaps: dict[tuple, list]) -> pa.RecordBatch:
        found = [(*query, -d, -v) for query, heap in heaps.items() for d, v in heap]
        columns = list(zip(*found)) or [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["query_id", "q_block", "q_row", "score", "vec_id"])

    def run(batches):
        heaps: dict[tuple, list] = {}
        block = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n_i)[i].as_py() for n_i, n in enumerate(batch.schema.names)}
                if row["q_block"] != block and heaps:  # rows come sorted by query block: only its heaps are held
                    yield out(heaps)
                    heaps = {}
                block = row["q_block"]
                tile(row, heaps)
        yield out(heaps)

    return run


def nearest_vectors(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    candidate_rows: int = 4096,
    query_rows: int = 512,
) -> DataFrame:
    """The ``k`` candidates of ``vectors`` with the smallest Euclidean distance to each row of ``queries``.

    Returns query_id long, rank int from 1, vec_id long, score double (the distance in double precision). Nearest first,
    ties to the smaller vec_id. A query is not its own candidate.

    Nulls and odd rows: rows with a null id, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part on either side. Every row is a candidate, also where rows share an id, but no row that has the
    query's own id. Equal query rows (id and vector) are one query; different ones with one id get a list each. Vectors are
    compared with those of their own length only. Fewer candidates than ``k`` give fewer rows; empty tables give none.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "vector-search")

    def packed(df: DataFrame, rows: int, name: str, distinct: bool) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
        df = df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("dim", F.size("embedding"))
        df = df.distinct() if distinct else df
        df = work.save(df.mapInArrow(_pack(rows), PACKED), name)
        # blocks are numbered once written, so that a task that runs again finds the same numbers
        return work.save(df.withColumn("block", F.monotonically_increasing_id()), f"{name}_numbered")

    c, q = packed(vectors, candidate_rows, "candidates", False), packed(queries, query_rows, "queries", True)
    stripes = min(shuffle_width(spark), max(1, c.count()))
    names = ("block", "ids", "codes", "scales", "rest", "vectors")
    c = c.select("dim", F.pmod(F.xxhash64("block"), F.lit(stripes)).alias("stripe"), *(F.col(n).alias(f"c_{n}") for n in names))
    q = q.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))).alias("stripe"), *(F.col(n).alias(f"q_{n}") for n in names))
    # every query block meets every candidate block once: the stated query set against all rows, in blocks
    pairs = q.join(c.hint("shuffle_hash"), ["dim", "stripe"]).sortWithinPartitions("q_block")
    found = pairs.mapInArrow(_tiles(k), "query_id long, q_block long, q_row int, score double, vec_id long")
    best = F.row_number().over(Window.partitionBy("query_id", "q_block", "q_row").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

