"""Helpers that the training-data operators share: written tables, sorted groups, components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode, where that is unset, one of its own.

    On a cluster an unset folder is an error: a machine's own folder would lose what other machines wrote.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return "file://" + _own_dir


class Workspace:
    """Tables of one operator run, written as Parquet in the shared folder.

    A written table cuts the lineage: it survives lost executors, and is computed once. Results read the tables as long as the
    application lives; when the driver ends, its folder goes.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that later steps no longer read."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: F.Column, use) -> F.Column:
    """``use(value)`` with the value computed once. Inside a lambda, a plain expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Yields ``(key, rows)`` for each run of equal keys in sorted batches; one group at a time is in memory."""
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, dtype=bool)
        changed[0] = True
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(changed)
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(c[start].item() for c in columns)
            if key != held_key and held:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(start, end - start))
    if held:
        yield held_key, pa.Table.from_batches(held)


def min_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and pairs (left, right), the smallest node that each can reach."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def sums_before(work: Workspace, df: DataFrame, order: list[F.Column], sums: dict[str, str], name: str) -> DataFrame:
    """``df`` with, for each ``new: column`` of ``sums``, the sum of the column over all rows that come earlier in ``order``.

    Rows are dealt out by ranges of ``order``, which should be unique; each range adds up its own rows, and only the ranges'
    totals, as few as there are shuffle partitions, meet in one task.
    """
    ranges = df.repartitionByRange(shuffle_width(work.spark), *order).withColumn("_range", F.spark_partition_id())
    ranges = work.save(ranges, name)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("_range").agg(*(F.sum(c).alias(f"_{new}") for new, c in sums.items()))
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_{new}").over(earlier), F.lit(0)).alias(f"_{new}") for new in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.join(F.broadcast(starts), "_range")  # bounded: a row for each shuffle partition
    return out.withColumns({new: F.col(f"_{new}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for new, c in sums.items()}).drop(
        "_range", *(f"_{new}" for new in sums)
    )


def most_before(work: Workspace, df: DataFrame, order: list[F.Column], value: F.Column, new: str, name: str) -> DataFrame:
    """``df`` with ``new``, the greatest ``value`` of all rows that come earlier in ``order``, by ranges as in ``sums_before``."""
    ranges = df.withColumn("_value", value).repartitionByRange(shuffle_width(work.spark), *order).withColumn("_range", F.spark_partition_id())
    ranges = work.save(ranges, name)
    tops = ranges.groupBy("_range").agg(F.max("_value").alias("_top"))
    tops = tops.select("_range", F.max("_top").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.join(F.broadcast(tops), "_range")  # bounded: a row for each shuffle partition
    return out.withColumn(new, F.greatest("_start", F.max("_value").over(inside))).drop("_range", "_start", "_value")


#: A node with more edges than MOST_EDGES, and than its share of all edges if there were HUBS such nodes, is a hub.
MOST_EDGES, HUBS = 256, 10_000


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``rows``, ``n`` of them, with the columns of ``table``, which has one row for each of their keys; nulls are equal.

    The table's column ``n`` is the number of rows with that key, and goes. No key is a hot one: the keys of very many rows,
    fewer than HUBS, are joined by broadcast, the others by a shuffle.
    """
    most = max(MOST_EDGES, n // HUBS)
    values = [c for c in table.columns if c not in (*keys, "n")]
    same = lambda a, b: reduce(and_, (F.col(a + k).eqNullSafe(F.col(b + k)) for k in keys))
    renamed = table.select(*(F.col(k).alias("_hub_" + k) for k in keys), *(F.col(v).alias("_hub_" + v) for v in values), F.lit(True).alias("_hub"), F.col("n").alias("_hub_n"))
    marked = rows.join(F.broadcast(renamed.where(F.col("_hub_n") > most).drop("_hub_n")), same("", "_hub_"), "left")
    kept = rows.columns
    hubs = marked.where("_hub").select(*kept, *(F.col("_hub_" + v).alias(v) for v in values))
    others = marked.where("_hub is null").select(*kept).join(renamed.where(F.col("_hub_n") <= most), same("", "_hub_"))
    return hubs.unionByName(others.select(*kept, *(F.col("_hub_" + v).alias(v) for v in values)))


def _with_lowest(edges: DataFrame, n: int) -> DataFrame:
    """(a, b, low): each of the ``n`` edges with the smallest b of its a.

    Nodes with very many edges are no hot keys: there are fewer than HUBS of them, so they are joined by broadcast.
    """
    lowest = edges.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
    most = max(MOST_EDGES, n // HUBS)
    hubs = lowest.where(F.col("n") > most).select("a", F.col("low").alias("_low"))
    marked = edges.join(F.broadcast(hubs), "a", "left")
    others = marked.where("_low is null").drop("_low").join(lowest.where(F.col("n") <= most).select("a", "low"), "a")
    return marked.where("_low is not null").select("a", "b", F.col("_low").alias("low")).unionByName(others)


def components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (a long, b long), as ``(node, component)`` with the smallest node as name.

    Alternates the large-star and small-star steps until every node has one edge, to its component's name. Every step is a
    grouped minimum (combined before the shuffle) and a join in which no node is a hot key. Self loops and nulls are
    ignored; nodes without edges are not in the result.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = work.save(down, f"{name}-0")
    step = 0
    while True:
        n = current.count()
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = _with_lowest(both, 2 * n).where("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b"))
        large = work.save(lowest.distinct(), f"{name}-{step}-large")
        small = _with_lowest(large, large.count())
        small = small.select("a", F.col("low").alias("b")).unionByName(
            small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        step += 1
        after = work.save(small.where("a <> b").distinct(), f"{name}-{step}")
        work.drop(f"{name}-{step - 1}", f"{name}-{step - 1}-large")
        current = after
        ends = after.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("named")).unionByName(
            after.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("named"))
        )
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("named").alias("named"))
        if ends.where("up > 1 or up = 1 and named = 1").isEmpty():
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
