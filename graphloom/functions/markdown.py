"""Front matter: YAML read and written in Arrow batches; everything else is a column expression."""

from __future__ import annotations

import json

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

from .text import normal_newlines, split_document

_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def _load(block: str | None) -> dict | None:
    try:
        value = yaml.load(block or "", Loader=_LOADER) or {}
    except yaml.YAMLError:
        return None
    return value if isinstance(value, dict) else None


def _text(value) -> str:
    return ",".join(map(str, value)) if isinstance(value, list) else str(value)


@F.pandas_udf(StructType().add("json", StringType()).add("fields", MapType(StringType(), StringType())))
def yaml_fields(blocks: pd.Series) -> pd.DataFrame:
    """A YAML mapping, read once: as JSON (dates and the like as text; null where it is no mapping), and its fields as text,
    lists joined by commas, null values left out."""
    found = [_load(b) for b in blocks]
    return pd.DataFrame(
        {
            "json": [None if v is None else json.dumps(v, ensure_ascii=False, default=str) for v in found],
            "fields": [{str(k): _text(x) for k, x in (v or {}).items() if x is not None} for v in found],
        }
    )


def parse_documents(df: DataFrame) -> DataFrame:
    """Adds frontmatter_json, fields map<string,string>, body_md and edge_section to rows with raw_md."""
    parts = df.withColumn("_d", split_document(F.col("raw_md"))).withColumn("_y", yaml_fields("_d.front"))
    return parts.withColumns(
        {"frontmatter_json": F.col("_y.json"), "fields": F.col("_y.fields"), "body_md": F.col("_d.body"), "edge_section": F.col("_d.edges")}
    ).drop("_d", "_y")


@F.pandas_udf(StringType())
def _with_fields(fronts: pd.Series, fields: pd.Series) -> pd.Series:
    """Blocks with fields set, or removed where the value is null."""

    def one(block, changes):
        found = _load(block) or {}
        for k, v in dict(changes if changes is not None else {}).items():
            if v is None:
                found.pop(k, None)
            else:
                found[k] = v
        return "---\n" + yaml.dump(found, allow_unicode=True, sort_keys=False).strip() + "\n---\n"

    return pd.Series([one(b, c) for b, c in zip(fronts, fields)], dtype=object)


def set_fields(raw_md: Column, fields: Column) -> Column:
    """The document with the fields of a map<string,string> set, or removed where the value is null; the text below stays as it is."""
    text = normal_newlines(raw_md)
    pattern = r"(?s)\A---\s*\n(.*?)\n---\s*\n?(.*)\z"
    has = text.rlike(pattern)
    front = _with_fields(F.when(has, F.regexp_extract(text, pattern, 1)).otherwise(""), fields)
    return F.concat(front, F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text))


def rewrite_front_matter(raw_md: Column, overrides: dict[str, str | None]) -> Column:
    """``set_fields`` with the same fields for all documents."""
    pairs = [x for k, v in overrides.items() for x in (F.lit(k), F.lit(v).cast("string"))]
    return set_fields(raw_md, F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))


def front_matter(fields: list[tuple[str, Column]]) -> Column:
    """A front-matter block of text columns, quoted; arrays become lists."""
    quote = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = [F.concat(F.lit(f"{name}: "), F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(quote(value))) for name, value in fields]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))
