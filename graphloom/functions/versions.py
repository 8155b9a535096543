"""Version order: dot segments, numbers before words, missing segments as zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ver_key(version: Column | str) -> Column:
    """A key that orders as versions do: ``array<struct<k, n, s>>`` without trailing zero segments; null for null.

    Numbers compare as numbers and come before words; ``1`` equals ``1.0``.
    """
    column = F.col(version) if isinstance(version, str) else version
    number = F.struct(F.lit(0).alias("k"), F.lit(0).cast("decimal(38,0)").alias("n"), F.lit("").alias("s"))

    def segment(x):
        digits = F.struct(F.lit(0).alias("k"), x.try_cast("decimal(38,0)").alias("n"), F.lit("").alias("s"))
        word = F.struct(F.lit(1).alias("k"), F.lit(0).cast("decimal(38,0)").alias("n"), x.alias("s"))
        return F.when(x.rlike(r"^[0-9]{1,38}$"), digits).otherwise(word)

    parts = F.transform(F.split(column, r"\.", -1), segment)
    last = F.array_max(F.transform(parts, lambda x, i: F.when(x == number, F.lit(0)).otherwise(i + 1)))
    return F.slice(parts, F.lit(1), last)
