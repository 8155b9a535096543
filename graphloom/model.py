"""Schemas, object types and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

OBJECTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "version", "type", "layer", "scope", "nf", "domain", "scenario", "name", "name_zh")]
    + [T.StructField(n, T.StringType()) for n in ("frontmatter_json", "body_md", "raw_md", "source_path")]
    + [T.StructField("mtime", T.DoubleType())]
)
EDGES = T.StructType([T.StructField(n, T.StringType()) for n in ("from_id", "from_version", "relation", "to_id")])
TELEMETRY = T.StructType(
    [T.StructField("seq", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("ts", "level", "caller", "endpoint", "obj_id", "obj_type", "user", "operator")]
)
REGISTRY = "type string, layer string, scope string, id_segments int, path_fields array<string>, frontmatter_required array<string>"

# The object types with their layers, scopes and required fields.
DEFAULT_TYPES = {
    "MMLCommand": ("Command", "nf", 3, [], ["id", "type", "name", "nf", "version", "source", "status"]),
    "ConfigObject": ("ConfigObject", "nf", 3, [], ["id", "type", "name", "nf", "version", "object_kind", "source", "status"]),
    "Feature": ("Feature", "nf", 3, [], ["id", "type", "nf", "version"]),
    "License": ("License", "nf", 3, [], ["id", "type", "nf", "version"]),
    "Task": ("Task", "task", 3, [], ["id", "type", "nf"]),
    "AtomTask": ("Task", "task", 3, [], ["id", "type", "nf"]),
    "CompoundTask": ("Task", "task", 3, [], ["id", "type", "nf"]),
    "FeatureTask": ("Task", "task", 3, [], ["id", "type", "nf"]),
    "BusinessDomain": ("Business", "cross", 2, ["domain"], ["id", "type", "domain"]),
    "NetworkScenario": ("Business", "cross", 2, ["domain", "scenario"], ["id", "type", "domain", "scenario"]),
    "ConfigurationSolution": ("Business", "cross", 2, ["domain", "scenario"], ["id", "type", "domain", "scenario"]),
}
# The layers that users see, and what they hold.
UI_LAYERS = {
    "Command": "命令层",
    "ConfigObject": "命令层",
    "Feature": "特性层",
    "License": "特性层",
    "Task": "任务层",
    "Business": "业务层",
}
UI_ORDER = ["命令层", "特性层", "任务层", "业务层"]


def types_in_ui_layer(ui_layer: str) -> list[str]:
    """Types that a UI layer shows; an unknown layer shows none."""
    return [t for t, spec in DEFAULT_TYPES.items() if UI_LAYERS[spec[0]] == ui_layer]


def default_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, *spec) for t, spec in DEFAULT_TYPES.items()], REGISTRY)
