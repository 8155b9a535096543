"""Removes repeated passages by overlapping three-line windows, in DataFrame operations.

Every three consecutive lines are one window, known by a 128-bit hash. A window that occurs more than once in the corpus
keeps its first occurrence, by document id and position; the lines that later occurrences cover are merged and removed. A
removed line always stays somewhere: at the first occurrence, or, where that one is itself covered, at an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, let

WINDOW = 3
#: What is cut from both ends of a line before it is hashed.
BLANKS = " \t\r"
#: Columns of the result besides those of the documents.
ADDED = ("n_lines", "n_removed")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated three-line passages removed from the text; adds n_lines long and n_removed long.

    Lines end at line feeds and are compared without blanks around them; windows of blank lines only do not count.

    Nulls and odd rows: a null text stays null and has no lines; texts of fewer than three lines stay as they are. Rows with
    the same id and text are one document and are treated alike; a null id comes first in order. A document whose lines all
    repeat is left with an empty text. An empty table gives an empty result. Other columns pass through, but
    for those named n_lines or n_removed, which are replaced.
    """
    work = Workspace(docs.sparkSession, "line-dedup")
    lines = F.split(F.col(text_col), "\n", -1)
    trimmed = F.transform(lines, lambda x: F.trim(x, F.lit(BLANKS)))
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), trimmed.alias("lines"))

    def window(i):
        three = [F.element_at("lines", i + k) for k in range(1, WINDOW + 1)]
        blank = F.length(F.concat(*three)) == 0
        return F.when(~blank, F.struct(i.alias("at"), F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit("second"), *three).alias("h2")))

    starts = F.when(F.size("lines") >= WINDOW, F.sequence(F.lit(0), F.size("lines") - WINDOW))
    windows = own.select("doc_id", "text_key", F.explode(F.transform(starts, window)).alias("w")).where("w is not null")
    windows = work.save(windows.select("w.h1", "w.h2", F.struct("doc_id", "text_key", "w.at").alias("place")), "windows")
    firsts = windows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    # both joins are by shuffle at every size, so that small inputs show what large ones cost
    later = windows.join(firsts.hint("shuffle_hash"), ["h1", "h2"]).where(~F.col("place").eqNullSafe(F.col("first")))
    covered = work.save(
        later.groupBy(F.col("place.doc_id").alias("_id"), F.col("place.text_key").alias("_key")).agg(F.collect_set("place.at").alias("_at")), "covered"
    )
    text = F.col("_row").getField(text_col)
    text_lines = F.split(text, "\n", -1)
    everything = F.sequence(F.lit(0), F.size(text_lines) - 1)
    merged = F.array_distinct(F.flatten(F.transform("_at", lambda p: F.sequence(p, p + (WINDOW - 1)))))
    left = let(text_lines, lambda lines: F.transform(F.array_except(everything, merged), lambda i: F.element_at(lines, i + 1)))
    # the document travels as one struct, so that its other columns can have any names
    whole = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_own_id"), F.xxhash64(text_col).alias("_own_key"))
    joined = whole.join(covered.hint("shuffle_hash"), F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_key") == F.col("_key")), "left")
    new_text = F.when(F.col("_at").isNull(), text).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *(new_text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ADDED),
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(text_lines)).cast("long").alias("n_lines"),
        F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.size(merged)).cast("long").alias("n_removed"),
    )


#: What ``dedup_lines`` gives over ``documents`` (doc_id, n_lines, n_removed, text) in DuckDB's SQL.
DEDUP_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line FROM d),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS x FROM l),
w AS (SELECT doc_id, pos, x AS a, lead(x, 1) OVER p AS b, lead(x, 2) OVER p AS c FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS turn FROM w WHERE c IS NOT NULL AND a || b || c <> ''),
g AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM r WHERE turn > 1),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text, count(*)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_removed
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
