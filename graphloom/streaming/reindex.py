"""Documents as a stream of files, merged into the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.maintenance import changed_files
from ..sources import storage
from ..sources.bundles import admit, to_edges, to_objects
from ..sources.files import file_times, listing, read_files
from ..sources.tables import Store

NOTED = "path string, mtime double"


def note_files(spark: SparkSession, root: str, noted: str) -> None:
    """Adds (path, mtime) of the Markdown files below ``root`` that are new or changed since they were last noted."""
    found = listing(spark, root, "*.md").select("path", "mtime")
    if storage.exists(spark, noted):
        found = found.join(spark.read.schema(NOTED).parquet(noted), ["path", "mtime"], "left_anti")
    found.repartition(1).write.mode("append").parquet(noted)


def read_documents(spark: SparkSession, root: str, noted: str) -> DataFrame:
    """Noted files as they come, opened by the tasks: (source_path, raw_md, mtime).

    Spark's own stream of a folder's files lists every one of them on the driver, and again with a task each.
    """
    return read_files(spark.readStream.schema(NOTED).parquet(noted), root).select(F.col("path").alias("source_path"), F.col("content").cast("string").alias("raw_md"), "mtime")


def reindex(spark: SparkSession, root: str, store: Store, registry: DataFrame, checkpoint: str):
    """Merges every batch of files into the store, of one node the file that was changed last, then stops."""
    noted = checkpoint.rstrip("/") + "-noted"
    note_files(spark, root, noted)

    def merge(batch: DataFrame, _: int) -> None:
        admitted = admit(batch, registry)
        newest = Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc("source_path"))
        admitted = admitted.withColumn("_n", F.row_number().over(newest)).where("_n = 1 and warning is null").drop("_n").persist()
        store.merge(to_objects(admitted), to_edges(admitted))
        admitted.unpersist()

    return read_documents(spark, root, noted).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remove_deleted(spark: SparkSession, root: str, store: Store) -> None:
    """A file stream never tells of deletions: compares the folder with the store and removes what is gone."""
    gone = changed_files(file_times(spark, root), store.objects()).where("change = 'deleted'").select("source_path")
    if not gone.isEmpty():
        store.remove(gone)
