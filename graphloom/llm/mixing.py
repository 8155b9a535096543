"""Mixes sources to target weights, cut at each source's exact budget.

Every document gets a key that is random but fixed by its id. Within a source, documents are in key order. Equal ranges of
keys are the buckets of a distributed prefix sum: token counts are summed for each source and bucket, bucket sums run along
the source, and only the bucket in which the budget ends is sorted row by row. The cut is then one small row for each
source: whole epochs, the document at which the last epoch ends, and how many of its words are still taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, sums_before

#: What words are: runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the key; 15 fit a long.
KEY_DIGITS = 15
#: Bits that name equal ranges of keys: sums are kept for each source and range, then for as many parts of the range with the cut.
BUCKET_BITS = 12


def mix_key(id_col: F.Column, seed: str) -> F.Column:
    hashed = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(hashed, 1, KEY_DIGITS), 16, 10).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        mix_key(F.col(id_col), seed).alias("key"),
    )


def source_targets(work: Workspace, sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(source, source_size, target double): the total shared by weight, no source above ``max_epochs`` times its size.

    Sources are in code-point order, null last, and get ``weights`` in turn. Sources that reach their limit are those whose
    limit for each unit of weight is smallest; the rest share what remains. ``sizes`` has a row for each source.
    """
    by_name = F.col("source").asc_nulls_last()
    s = sums_before(work, sizes.withColumn("one", F.lit(1)), [by_name], {"turn": "one"}, "sources")
    weight = F.element_at(F.lit(list(weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("double")
    s = s.withColumn("weight", weight).withColumn("limit", F.col("source_size").cast("double") * max_epochs)
    s = work.save(s.withColumn("unit", F.col("limit") / F.col("weight")).drop("turn", "one"), "weighed")
    total, all_weights = s.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    s = sums_before(work, s, [F.col("unit"), by_name], {"full": "limit", "heavy": "weight"}, "by_limit")
    level = (F.lit(total) - F.col("full")) / (F.lit(all_weights) - F.col("heavy"))
    fits = F.struct("unit", F.col("source").isNull().alias("last"), "source", level.alias("level"))
    found = s.where(level <= F.col("unit")).agg(F.min(fits).alias("x")).first()["x"]
    target = F.col("limit") if found is None else F.least("limit", F.lit(found["level"]) * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def _edge(sums: DataFrame, rests: DataFrame, number: str) -> DataFrame:
    """(_s, number, rest): the range of keys in which each source's budget ends, and what is left of the budget there.

    ``sums`` has the words (size) of ranges by source and number, ``rests`` (_s, rest) the budgets.
    """
    along = Window.partitionBy("source").orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("end", F.sum("size").over(along)).join(rests, F.col("source").eqNullSafe(F.col("_s")))
    ends = ends.where((F.col("end") - F.col("size") <= F.col("rest")) & (F.col("rest") < F.col("end")))
    return ends.select("_s", F.col(number).alias("_number"), (F.col("rest") - F.col("end") + F.col("size")).alias("rest"))


def _cuts(work: Workspace, sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """A row for each source: source_size, target, epochs, and the cut (cut_key, cut_id, cut_size, cut_words)."""
    bits = 4 * KEY_DIGITS - BUCKET_BITS
    bucket = F.shiftright("key", bits).cast("int")
    part = F.pmod(F.shiftright("key", bits - BUCKET_BITS), F.lit(1 << BUCKET_BITS)).cast("int")
    sums = work.save(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size")), "sums")
    targets = source_targets(work, sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    budget = F.round("target").cast("long")
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    targets = work.save(targets.withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "targets")
    # the range in which the budget ends, then the part of that range, and only there row by row
    edge = _edge(sums, targets.select(F.col("source").alias("_s"), "rest"), "bucket")
    rows = sized.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (bucket == F.col("_number"))).select("source", "doc_id", "key", "size", "rest")
    rows = work.save(rows.withColumn("part", part), "edge")
    edge = _edge(rows.groupBy("source", "part").agg(F.sum("size").alias("size")), rows.select(F.col("source").alias("_s"), "rest").distinct(), "part")
    rows = rows.drop("rest").join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_number")))
    # equal rows are one step, so that a cut falls on all of them alike
    rows = rows.groupBy("_s", "rest", "key", "doc_id", "size").agg(F.count("*").alias("rows"))
    inside = Window.partitionBy("_s").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.col("size") * F.col("rows")
    cut = (
        rows.withColumn("end", F.sum(weight).over(inside))
        .where((F.col("end") - weight <= F.col("rest")) & (F.col("rest") < F.col("end")))
        .select(
            "_s",
            F.col("key").alias("cut_key"),
            F.col("doc_id").alias("cut_id"),
            F.col("size").alias("cut_size"),
            F.floor((F.col("rest") - F.col("end") + weight) / F.col("rows")).cast("long").alias("cut_words"),
        )
    )
    return work.save(
        targets.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            F.col("source").alias("_s"), "source_size", "target", "epochs", "rest", "cut_key", "cut_id", "cut_size", "cut_words"
        ),
        "cuts",
    )


def _taken() -> F.Column:
    mine = F.struct("key", "doc_id", "size")
    cut = F.struct(F.col("cut_key").alias("key"), F.col("cut_id").alias("doc_id"), F.col("cut_size").alias("size"))
    last = F.when(F.col("cut_key").isNull() | (mine > cut), F.lit(0)).when(mine < cut, F.col("size")).otherwise(F.col("cut_words"))
    return F.col("epochs") * F.col("size") + last


def _with_taken(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    return sized.join(cuts, F.col("source").eqNullSafe(F.col("_s"))).withColumn("taken", _taken())


def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """What a mix of all words takes of each document.

    Returns doc_id, size long (words of the text), source_size long, target double (of its source), taken long (words
    taken, repeats counted). The words taken of a source are its target, rounded. The same rows give the same mix.

    Nulls and odd rows: a null text has no words, a null source is a source of its own and comes last. Sources without
    words take nothing. Equal rows (id and size) on the cut share what is left there equally, rounded down; so a null id
    is no trouble. An empty table gives an empty result. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "mixing")
    sized = work.save(_sized(docs, id_col, text_col, source_col, seed), "sized")
    cuts = _cuts(work, sized, weights, max_epochs)
    return _with_taken(sized, cuts).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: a row for each time a document is taken, with the columns of ``docs``.

    A document that the cut splits comes last with its first words only, and ``n_chars`` (where there is one) to match.

    Nulls and odd rows: null and blank texts have no words and are not taken. A null source is a source of its own, a null id
    an id like any other. Repeated rows are taken alike; those on the cut share what is left. An empty table gives an empty
    result. All other columns pass through under any name.
    """
    work = Workspace(docs.sparkSession, "mixing")
    sized = work.save(_sized(docs, "doc_id", "text", "source", seed), "sized")
    cuts = _cuts(work, sized, weights, max_epochs)
    text = F.col("_row.text")
    # the document travels as one struct, so that its other columns can have any names
    own = docs.select(
        F.struct("*").alias("_row"),
        F.struct(mix_key(F.col("doc_id"), seed).alias("key"), "doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")).alias("_mine"),
    )
    named = cuts.select(F.struct("*").alias("_cut"))
    own = own.join(named, F.col("_row.source").eqNullSafe(F.col("_cut._s"))).where("_mine.size > 0")
    mine = F.col("_mine")
    cut = F.struct(F.col("_cut.cut_key").alias("key"), F.col("_cut.cut_id").alias("doc_id"), F.col("_cut.cut_size").alias("size"))
    part = F.coalesce(F.when(mine == cut, F.col("_cut.cut_words")), F.lit(0))
    whole = F.col("_cut.epochs") + F.coalesce(F.when(mine < cut, 1), F.lit(0))
    words = F.array_repeat(F.lit(-1).cast("long"), whole.cast("int"))
    words = F.when(part > 0, F.concat(words, F.array(part))).otherwise(words)
    own = own.select("_row", F.explode(words).alias("_words"))
    first_words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), 0), F.lit(1), F.col("_words").cast("int")), "")
    new = {"text": F.when(F.col("_words") < 0, text).otherwise(first_words)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_words") < 0, F.col("_row.n_chars")).otherwise(F.length(new["text"]).cast("long"))
    return own.select(*(new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))


#: The plan of ``mix_plan`` over ``documents`` in DuckDB's SQL.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight, source_size * 3.0::DOUBLE AS lim FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(lim) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS lev,
             row_number() OVER (ORDER BY lim / weight, source ASC NULLS LAST) AS turn
      FROM w WINDOW b AS (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size,
             coalesce(least(lim, (SELECT arg_min(lev, turn) FROM l WHERE lev <= lim / weight) * weight), lim) AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0
        ELSE (round(target)::BIGINT // source_size) * size
             + least(size, greatest(0, round(target)::BIGINT % source_size - before)) END)::BIGINT AS taken
FROM r
"""
