"""Counts over objects by type, layer, network function, version and business domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import ui_layer_of


def count_by_type(objects: DataFrame) -> DataFrame:
    return objects.groupBy("type").agg(F.count("*").alias("n"))


def layer_rollup(objects: DataFrame) -> DataFrame:
    """(level, ui_layer, nf, version, n): per layer, per layer and nf, per layer, nf and version, in one pass.

    Rows without nf count for their layer only, rows without version not in the last level.
    """
    own = objects.select(ui_layer_of(F.col("layer")).alias("ui_layer"), F.nullif("nf", F.lit("")).alias("nf"), F.nullif("version", F.lit("")).alias("version"))
    sets = own.groupingSets([("ui_layer",), ("ui_layer", "nf"), ("ui_layer", "nf", "version")], "ui_layer", "nf", "version")
    rolled = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "layer").when(F.col("g") == 1, "nf").otherwise("version")
    return rolled.withColumn("level", level).where("level = 'layer' or nf is not null and (level = 'nf' or version is not null)").drop("g")


def domain_rollup(objects: DataFrame) -> DataFrame:
    """(level, domain, scenario, n): per domain, and per domain and scenario."""
    own = objects.select(F.nullif("domain", F.lit("")).alias("domain"), F.nullif("scenario", F.lit("")).alias("scenario")).where("domain is not null")
    rolled = own.groupingSets([("domain",), ("domain", "scenario")], "domain", "scenario").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return rolled.withColumn("level", F.when(F.col("g") == 1, "domain").otherwise("scenario")).where("level = 'domain' or scenario is not null").drop("g")


def percent_of_max(counts: DataFrame, value: str = "n") -> DataFrame:
    """Adds pct: the value as a rounded percentage of the largest."""
    most = counts.agg(F.max(value).alias("_most"))
    return counts.crossJoin(F.broadcast(most)).withColumn("pct", F.round(100.0 * F.col(value) / F.col("_most")).cast("long")).drop("_most")  # one row


def existing_layers(objects: DataFrame) -> DataFrame:
    """(nf, version, has_command, has_config, has_feature, has_license): which assets each version has."""
    has = lambda layer: F.bool_or(F.col("layer") == layer)
    return (
        objects.where("nf is not null and version is not null")
        .groupBy("nf", "version")
        .agg(has("Command").alias("has_command"), has("ConfigObject").alias("has_config"), has("Feature").alias("has_feature"), has("License").alias("has_license"))
    )


def distinct_values(objects: DataFrame, column: str) -> DataFrame:
    """The values that a column has, each once; null and empty ones are none."""
    return objects.where(F.coalesce(F.col(column), F.lit("")) != "").select(column).distinct()


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, n, is_empty) of tables, one row each."""
    found = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", (F.col("n") == 0).alias("is_empty"))
        found = one if found is None else found.unionByName(one)
    return found
