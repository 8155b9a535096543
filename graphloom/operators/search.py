"""An index for substring search: the letter runs of the names, as a table that prunes before the exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import matches

#: Letters of a run; a search for fewer letters than LENGTHS[0] scans.
LENGTHS = (2, 3)


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def letter_runs(text: Column, lengths: tuple[int, ...] = LENGTHS) -> Column:
    """All distinct runs of so many letters, in lower case."""
    low = F.lower(text)
    runs = [F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(0), F.length(low) - n), lambda i: F.substring(low, i + 1, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in lengths]  # noqa: B023
    return F.array_distinct(F.coalesce(F.concat(*runs), F.array().cast("array<string>")))


def build_index(objects: DataFrame, path: str, buckets: int = 64) -> None:
    """Writes (gram, id) of id, name and Chinese name of all objects, in folders by a hash of the gram and sorted by it."""
    # versions of an object come together before its runs are told apart: the runs, a hundred times as many, are not compared again
    own = objects.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set(F.array("name", "name_zh")))).alias("names"))
    grams = F.array_distinct(F.flatten(F.transform(F.concat(F.array("id"), "names"), lambda x: letter_runs(x))))
    rows = own.select("id", F.explode(grams).alias("gram")).withColumn("bucket", _bucket(F.col("gram"), buckets))
    # a common run may have very many ids: those of one bucket go to several tasks
    placed = rows.repartition(2 * buckets, "bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "gram")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def candidates(spark: SparkSession, path: str, q: str, buckets: int = 64) -> DataFrame | None:
    """(id) of the objects that have all runs of the search text; None where it is too short for the index.

    Only the folders of these runs are read, and of their files what the sorted runs' statistics let pass.
    """
    needle = q.strip().lower()
    length = max((n for n in LENGTHS if n <= len(needle)), default=0)
    if not length:
        return None
    grams = sorted({needle[i : i + length] for i in range(len(needle) - length + 1)})
    where = spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"), buckets).alias("bucket")).distinct()
    own = [r.bucket for r in where.collect()]  # as many as the search text has runs
    rows = spark.read.schema("gram string, id string, bucket int").parquet(path).where(F.col("bucket").isin(own) & F.col("gram").isin(grams))
    return rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")


def search(objects: DataFrame, path: str, q: str, buckets: int = 64) -> DataFrame:
    """The objects that ``graph.matches`` finds: candidates of the index first, then the exact test on them only."""
    found = candidates(objects.sparkSession, path, q, buckets)
    return objects.where(matches(q)) if found is None else objects.join(found, "id", "left_semi").where(matches(q))
