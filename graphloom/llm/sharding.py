"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has a fixed number of segments; the hash of a row's key names its segment and its place there. Virtual nodes sit
at segment ends, and a segment belongs to the next virtual node clockwise. A shard takes no more rows than its bound: what
a full shard cannot take continues clockwise to the next shard that still has room. Since the bounds add up to at least the
number of rows, every row finds a shard after as many rounds as there are shards. Rounds work on the segments' row counts
only, never on rows: the table that says which ranks of a segment go where has about as many rows as the ring has segments.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, shuffle_width, sums_before

#: Equal rows of which one task makes slots.
EQUAL_ROWS = 100_000


def ring_preferences(shards: int, virtual_nodes: int, segments: int) -> list[list[int]]:
    """For each segment, all shards in the order in which a walk clockwise first meets them."""
    nodes = []
    for shard in range(shards):
        for node in range(virtual_nodes):
            place = int.from_bytes(hashlib.md5(f"shard {shard} node {node}".encode()).digest()[:8], "big")
            nodes.append((place * segments >> 64, place, shard))
    nodes.sort()
    preferences: list[list[int]] = []
    start = 0
    for segment in range(segments):
        while start < len(nodes) and nodes[start][0] < segment:
            start += 1
        order: dict[int, None] = {}
        for step in range(len(nodes)):
            order.setdefault(nodes[(start + step) % len(nodes)][2])
            if len(order) == shards:
                break
        preferences.append(list(order))
    return preferences


def bounded_flows(counts: list[int], preferences: list[list[int]], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(segment, first rank, end rank, shard, first slot) for all rows of all segments.

    In round r every segment offers what it has left to the r-th shard of its walk; segments are served in ring order.
    """
    left, room, used, flows = list(counts), list(bounds), [0] * len(bounds), []
    for number in range(len(bounds)):
        for segment, order in enumerate(preferences):
            shard = order[number]
            take = min(left[segment], room[shard])
            if take:
                first = counts[segment] - left[segment]
                flows.append((segment, first, first + take, shard, used[shard]))
                left[segment] -= take
                room[shard] -= take
                used[shard] += take
    return flows


def shard_rows(
    docs: DataFrame,
    shards: int = 8,
    virtual_nodes: int = 64,
    segments: int = 4096,
    load: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Puts every row into one of ``shards`` shards, the law being ``rows``.

    A shard holds at most ``load`` times its equal share of the rows; at 1.0 the counts are at most one apart.

    Returns doc_id, size long (UTF-8 bytes of the text plus 1), text_crc32 long, law string, shard int, slot long (gapless
    from 0 in each shard), grown_shard int (null: this law has none).

    Nulls and odd rows: a null text has no bytes, a null id hashes like any other value. Equal rows (same id and text) are
    counted together before they are dealt out and get slots of their own. An empty table gives an empty result. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    place = F.xxhash64(F.lit("ring"), "doc_id")
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("rows")).withColumn("place", place)
    bits = segments.bit_length() - 1
    if 1 << bits != segments:
        raise ValueError("segments must be a power of two")
    rows = rows.withColumn("segment", F.shiftrightunsigned("place", 64 - bits).cast("int"))
    order = [F.col(c) for c in ("segment", "place", "doc_id", "text_crc32", "size")]
    rows = sums_before(work, work.save(rows, "rows"), order, {"before": "rows"}, "ranked")
    counts = [0] * segments
    for x in work.spark.read.parquet(work.path("rows")).groupBy("segment").agg(F.sum("rows").alias("n")).collect():  # a row for each segment
        counts[x["segment"]] = x["n"]
    n = sum(counts)
    bounds = [max(n // shards + (s < n % shards), math.ceil(load * n / shards) if load > 1 else 0) for s in range(shards)]
    starts = [0, *itertools.accumulate(counts)]
    flows = bounded_flows(counts, ring_preferences(shards, virtual_nodes, segments), bounds)
    flows = [(segment, starts[segment] + first, starts[segment] + end, shard, slot) for segment, first, end, shard, slot in flows]
    names = ("segment", "first", "end", "shard", "slot")
    told = json.dumps([dict(zip(names, flow)) for flow in flows])  # a literal, so that no Python worker is needed for it
    dealt = spark.range(1).select(F.inline(F.from_json(F.lit(told), "array<struct<segment:int,first:long,end:long,shard:int,slot:long>>")))
    ranges = rows.join(F.broadcast(dealt), "segment")  # bounded by the ring: its segments and the shards' bounds
    ranges = ranges.withColumns({"from": F.greatest("before", "first"), "to": F.least(F.col("before") + F.col("rows"), "end")})
    ranges = ranges.where("from < to").select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - F.col("first")).alias("shift"), "from", "to")
    # very many equal rows are cut into pieces that other tasks take over
    steps = F.sequence(F.col("from"), F.col("to") - 1, F.lit(EQUAL_ROWS))
    many = ranges.where(F.col("to") - F.col("from") > EQUAL_ROWS).withColumn("from", F.explode(steps))
    many = many.withColumn("to", F.least("to", F.col("from") + EQUAL_ROWS)).repartition(shuffle_width(spark), "from")
    pieces = ranges.where(F.col("to") - F.col("from") <= EQUAL_ROWS).unionByName(many)
    return pieces.withColumn("rank", F.explode(F.sequence(F.col("from"), F.col("to") - 1))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank") + F.col("shift")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
