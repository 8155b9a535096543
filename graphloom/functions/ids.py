"""Logical ids (``nf@Type@local`` or ``Type@slug``), layers and paths as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import UI_LAYERS


def segment_count(id_: Column) -> Column:
    return F.size(F.split(id_, "@", -1))


def is_nf_scoped(id_: Column) -> Column:
    return segment_count(id_) == 3


def split_id(id_: Column) -> Column:
    """struct(nf, type, local); null for ids of other than two or three segments."""
    parts = F.split(id_, "@", -1)
    three = F.struct(parts[0].alias("nf"), parts[1].alias("type"), parts[2].alias("local"))
    two = F.struct(F.lit(None).cast("string").alias("nf"), parts[0].alias("type"), parts[1].alias("local"))
    return F.when(F.size(parts) == 3, three).when(F.size(parts) == 2, two)


def split_logical_id(id_: Column) -> Column:
    """struct(nf, type, local) where the local part may itself hold separators; null for fewer than three parts."""
    parts = F.split(id_, "@", 3)
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("nf"), parts[1].alias("type"), parts[2].alias("local")))


def ui_layer_of(layer: Column) -> Column:
    """The UI layer; unknown layers pass through, null is empty."""
    names = F.create_map(*(F.lit(x) for x in chain.from_iterable(UI_LAYERS.items())))
    return F.coalesce(F.try_element_at(names, layer), layer, F.lit(""))


def classify(id_: Column, scope: Column, layer: Column, path_fields: Column, fields: Column) -> Column:
    """struct(path, warning): where an object's file belongs, or why it cannot be placed.

    ``fields`` is the front matter as ``map<string,string>``; ``scope``, ``layer`` and ``path_fields`` come from the registry.
    """
    own = split_id(id_)
    values = F.transform(path_fields, lambda f: F.coalesce(F.try_element_at(fields, f), F.lit("")))
    version = F.coalesce(F.try_element_at(fields, F.lit("version")), F.lit(""))
    missing = F.filter(path_fields, lambda f: F.coalesce(F.try_element_at(fields, f), F.lit("")) == "")
    warning = (
        F.when(own.isNull(), F.concat(F.lit("bad id "), F.coalesce(id_, F.lit(""))))
        .when(scope.isNull(), F.concat(F.lit("unknown type "), own["type"]))
        .when((scope == "nf") & (version == ""), F.concat(F.lit("no version: "), id_))
        .when((scope == "cross") & (F.size(missing) > 0), F.concat(F.lit("no "), missing[0], F.lit(": "), id_))
    )
    folder = (
        F.when(scope == "nf", F.concat_ws("/", layer, own["nf"], version))
        .when(scope == "task", F.concat_ws("/", own["type"], own["nf"]))
        .otherwise(F.concat_ws("/", layer, F.array_join(values, "/")))
    )
    return F.struct(F.when(warning.isNull(), F.concat(folder, F.lit("/"), id_, F.lit(".md"))).alias("path"), warning.alias("warning"))
