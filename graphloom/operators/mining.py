"""Asset mining: commands, configuration objects, features and licences with their edges, from product pages.

Dimensions (command names, configuration objects, feature and licence codes) come first, from headings and paths; then every
layer is one pass. Pages are rows (path, md).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X


def command_pages(pages: DataFrame) -> DataFrame:
    """Pages that describe a command: adds name_zh, name, verb, object."""
    titled = pages.withColumn("_t", X.command_title(F.col("md"))).where("_t.name <> ''")
    return titled.select(*pages.columns, "_t.name_zh", "_t.name", X.verb_of(F.col("_t.name")).alias("verb"), X.object_of(F.col("_t.name")).alias("object"))


_WORD = re.compile("[A-Z0-9_]+")
MATCHES = "key string, line_no int, line long, at int, last int, name string"


def word_trie(names) -> dict:
    """Names as a trie of words: a dictionary for each word that can follow, and under None the name that ends there."""
    trie: dict = {}
    for name in names:
        node = trie
        for word in name.split(" "):
            node = node.setdefault(word, {})
        node[None] = name
    return trie


def longest_names(line: str, trie: dict):
    """(first word's place, last word's place, name) of the longest name that begins at each word of the line, words counted from 0."""
    words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(line)]
    for at, (word, _, end) in enumerate(words):
        node, last, found = trie.get(word), at, None
        while node is not None:
            if None in node:
                found = last, node[None]
            last += 1
            if last == len(words) or words[last][1] != end + 1 or line[end] != " ":
                break
            node, end = node.get(words[last][0]), words[last][2]
        if found:
            yield at, *found


def scan_names(docs: DataFrame, names: DataFrame, part_bytes: int = 32 << 20) -> DataFrame:
    """(key, name): the known names that the lines of each document hold, as distinct rows.

    ``docs`` is (key, md), ``names`` (name): upper-case words with single blanks, any number of them. Names stand on
    word borders, the longest wins, matches do not overlap; fenced code and contents lines do not count. The names go to the
    tasks as a trie of words, along which each line is walked once from the left. Names of more than ``part_bytes`` are cut into
    parts by a hash; each part has its own walk, and a line's matches of all parts meet and are taken from the left there.
    """
    spark = docs.sparkSession
    known = names.select("name").where("name is not null and name <> ''").distinct()
    size = known.agg(F.sum(F.length(F.col("name").cast("binary")) + 16)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    texts = docs.select("key", X.prose(F.col("md")).alias("md"))
    kind = texts.schema["key"].dataType.simpleString()

    def table(rows, batch, names):
        kinds = {"key": batch.column(0).type, "line_no": pa.int32(), "line": pa.int64(), "at": pa.int32(), "last": pa.int32(), "name": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)], names=list(names))

    def alone(trie):
        def walk(batches):
            for batch in batches:
                rows = []
                for key, md in zip(*(c.to_pylist() for c in batch.columns)):
                    found: dict[str, None] = {}
                    for line in (md or "").split("\n"):
                        end = -1
                        for at, last, name in longest_names(line, trie.value):
                            if at > end:
                                end, found[name] = last, None
                    rows += [(key, name) for name in found]
                yield table(rows, batch, ("key", "name"))

        return walk

    def one_of(trie):
        def walk(batches):
            for batch in batches:
                texts = zip(*(c.to_pylist() for c in batch.columns))
                rows = [(key, n, zlib.crc32(line.encode()), *match) for key, md in texts for n, line in enumerate((md or "").split("\n")) for match in longest_names(line, trie.value)]
                yield table(rows, batch, ("key", "line_no", "line", "at", "last", "name"))

        return walk

    def trie_of(rows: DataFrame):
        return spark.sparkContext.broadcast(word_trie(r[0] for r in rows.collect()))  # about part_bytes of names

    if parts == 1:
        return texts.mapInArrow(alone(trie_of(known)), f"key {kind}, name string").distinct()
    found = None
    for part in range(parts):
        own = known.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part)
        rows = texts.mapInArrow(one_of(trie_of(own)), MATCHES.replace("key string", f"key {kind}"))
        found = rows if found is None else found.unionByName(rows)
    # documents may share a key, so that a line is told by its text too
    ordered = found.groupBy("key", "line_no", "line").agg(F.array_sort(F.collect_set(F.struct("at", (-F.col("last")).alias("minus_last"), "name"))).alias("m"))
    nothing = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("names"))

    def take(acc, m):
        return F.when(m["at"] > acc["end"], F.struct((-m["minus_last"]).alias("end"), F.concat(acc["names"], F.array(m["name"])).alias("names"))).otherwise(acc)

    taken = F.aggregate("m", nothing, take)["names"]
    return ordered.select("key", F.explode(taken).alias("name")).distinct()


def config_objects(commands: DataFrame) -> DataFrame:
    """(object): those that some configuring command has."""
    return commands.where(F.col("verb").isin(*X.CONFIG_VERBS) & (F.col("object") != "")).select("object").distinct()


def config_edges(commands: DataFrame, nf: str) -> DataFrame:
    """Command to configuration object: whatever the verb, where the object exists."""
    known = commands.join(config_objects(commands), "object", "left_semi")
    return known.select(_command_id(nf, "name").alias("from_id"), F.lit("操作配置对象").alias("relation"), F.concat(F.lit(f"{nf}@ConfigObject@"), "object").alias("to_id")).distinct()


def reference_edges(commands: DataFrame, nf: str) -> DataFrame:
    """Command to every other command that its page names."""
    found = scan_names(commands.select(F.col("name").alias("key"), "md"), commands)
    return found.where("name <> key").select(_command_id(nf, "key").alias("from_id"), F.lit("参见").alias("relation"), _command_id(nf, "name").alias("to_id"))


def external_edges(commands: DataFrame, links: DataFrame, nf: str) -> DataFrame:
    """Edges of an outside list (name, refs array<string>) for the commands that exist."""
    own = links.join(commands.select("name").distinct(), "name", "left_semi").select("name", F.explode("refs").alias("ref"))
    good = own.where((F.col("ref") != "") & (F.col("ref") != F.col("name"))).distinct()
    return good.select(_command_id(nf, "name").alias("from_id"), F.lit("参数引用").alias("relation"), _command_id(nf, "ref").alias("to_id"))


def _command_id(nf: str, column: str) -> Column:
    return F.concat(F.lit(f"{nf}@MMLCommand@"), F.col(column))


def families(commands: DataFrame) -> DataFrame:
    """Configuration objects: object, verbs, n_commands, object_kind, name_zh, description, members (names in page order).

    Only families with a configuring command count. The description is the function section of the first ADD page, else of the
    first configuring one; the Chinese name is that of the first ADD command, else of the first one, without its verb.
    """
    with_object = commands.where("object <> ''")
    config = F.col("verb").isin(*X.CONFIG_VERBS)
    first = lambda c, cond: F.min_by(F.when(cond, F.col(c)), F.when(cond, F.col("path")))
    grouped = with_object.groupBy("object").agg(
        F.array_sort(F.collect_set("verb")).alias("verbs"),
        F.count("*").alias("n_commands"),
        F.transform(F.array_sort(F.collect_list(F.struct("path", "name"))), lambda x: x["name"]).alias("members"),
        F.coalesce(first("name_zh", F.col("verb") == "ADD"), F.min_by("name_zh", "path")).alias("_zh"),
        F.coalesce(first("md", F.col("verb") == "ADD"), first("md", config)).alias("_md"),
        F.bool_or(config).alias("_config"),
    )
    kept = grouped.where("_config")
    zh = X.strip_zh_verb(F.col("_zh"))
    return kept.select(
        "object",
        "verbs",
        "n_commands",
        X.object_kind(F.col("verbs")).alias("object_kind"),
        F.when(zh != "", zh).otherwise(F.col("object")).alias("name_zh"),
        X.section(F.col("_md"), X.FUNCTION_SECTION).alias("description"),
        "members",
    )


def feature_documents(pages: DataFrame) -> DataFrame:
    """Pages of features: adds code (deepest on the path), filename, doc_type, title, is_overview, slug.

    The overview is the first page whose file name says so, else the first that is named after the feature alone. Slugs that
    clash within a feature get their folder's name in front, and a number where that does not help.
    """
    docs = pages.withColumn("code", X.deepest_code(F.col("path"))).where("code <> ''")
    docs = docs.withColumns(
        {
            "filename": F.regexp_extract("path", r"([^/]*)$", 1),
            "_parent": F.regexp_extract("path", r"([^/]+)/[^/]*$", 1),
            "doc_type": X.doc_type(F.col("path")),
            "title": X.first_heading(F.col("md")),
        }
    ).withColumn("slug", X.slug(F.col("filename")))
    words = "|".join(w for w, _ in X.DOC_TYPES)
    named = F.col("slug").startswith(F.col("code")) & (F.trim(F.replace("slug", F.col("code"), F.lit(""))) != "") & ~F.col("filename").rlike(words)
    rank = F.when(F.contains("filename", F.lit("特性概述")), 0).when(named, 1)
    best = F.row_number().over(Window.partitionBy("code").orderBy(F.col("_rank").asc_nulls_last(), "filename", "path"))
    docs = docs.withColumn("_rank", rank).withColumn("is_overview", (best == 1) & F.col("_rank").isNotNull()).drop("_rank")
    for _ in range(2):  # first with the folder in front, then with a number
        clash = F.count("*").over(Window.partitionBy("code", "is_overview", "slug")) > 1
        turn = F.row_number().over(Window.partitionBy("code", "is_overview", "slug").orderBy("filename", "path"))
        longer = F.when(F.col("_parent") != "", F.concat("_parent", F.lit("-"), "slug")).otherwise(F.col("slug")) if _ == 0 else F.concat("slug", F.lit("-"), turn.cast("string"))
        docs = docs.withColumn("slug", F.when(clash & ~F.col("is_overview"), longer).otherwise(F.col("slug")))
    return docs.drop("_parent")


def feature_ids(docs: DataFrame, nf: str) -> DataFrame:
    own = F.concat(F.lit(f"{nf}@Feature@"), "code")
    return docs.withColumn("id", F.when(F.col("is_overview"), own).otherwise(F.concat(own, F.lit("-"), "slug")))


def overview_counts(docs: DataFrame) -> DataFrame:
    """(code, n_overviews) of features without an overview page or with several."""
    named = F.count_if(F.contains("filename", F.lit("特性概述")))
    counts = docs.groupBy("code").agg(named.alias("n_overviews"), F.bool_or("is_overview").alias("_has"))
    return counts.where("n_overviews > 1 or not _has").select("code", "n_overviews")


def known_codes(found: DataFrame, valid: DataFrame, code: str = "code") -> DataFrame:
    """Rows of ``found`` whose code is valid (code)."""
    return found.join(valid.select(F.col("code").alias(code)).distinct(), code, "left_semi")


def unknown_codes(found: DataFrame, valid: DataFrame, code: str = "code") -> DataFrame:
    """Rows of ``found`` whose code is not valid (code)."""
    return found.join(valid.select(F.col("code").alias(code)).distinct(), code, "left_anti")


def all_codes(found: DataFrame, built: DataFrame) -> DataFrame:
    """Codes of either table, once."""
    return found.select("code").unionByName(built.select("code")).distinct()


def feature_edges(docs: DataFrame, nf: str, license_codes: DataFrame, feature_codes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, dropped (kind, n)): dependencies, licences and parts of the overview; parts point back at it.

    Codes are collected over all pages of a feature and kept where they exist; ``license_codes`` and ``feature_codes`` are (code).
    """
    docs = feature_ids(docs, nf)
    own = F.concat(F.lit(f"{nf}@Feature@"), "code")
    known = docs.select("code").distinct() if feature_codes is None else all_codes(feature_codes, docs)

    def candidates(pattern, exclude):
        return docs.select("code", F.explode(X.codes_in(F.col("md"), pattern, exclude)).alias("target")).distinct()

    deps, lics = candidates(X.FEATURE_CODE, F.col("code")), candidates(X.LICENSE_CODE, None)
    gone = lambda c, valid, kind: unknown_codes(c, valid, "target").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    with_overview = docs.where("is_overview").select("code")
    deps_in, lics_in = (x.join(with_overview, "code", "left_semi") for x in (known_codes(deps, known, "target"), known_codes(lics, license_codes, "target")))
    parts = docs.where("not is_overview")
    edges = (
        deps_in.select(own.alias("from_id"), F.lit("依赖特性").alias("relation"), F.concat(F.lit(f"{nf}@Feature@"), "target").alias("to_id"))
        .unionByName(lics_in.select(own.alias("from_id"), F.lit("所需License").alias("relation"), F.concat(F.lit(f"{nf}@License@"), "target").alias("to_id")))
        .unionByName(parts.join(with_overview, "code", "left_semi").select(own.alias("from_id"), F.lit("包含子文档").alias("relation"), F.col("id").alias("to_id")))
        .unionByName(parts.select(F.col("id").alias("from_id"), F.lit("属于特性").alias("relation"), own.alias("to_id")))
    )
    return edges.distinct(), gone(deps, known, "feature").unionByName(gone(lics, license_codes, "license"))


def licenses(pages: DataFrame) -> DataFrame:
    """Licences, one for each code (the last section by path and place wins): code, control_id, name, item_type, applicable_nf, body."""
    cut = pages.select("path", F.posexplode(X.license_sections(F.col("md"))).alias("at", "s"))
    last = F.row_number().over(Window.partitionBy("s.code").orderBy(F.desc("path"), F.desc("at")))
    kind = X.control_item_type(F.regexp_extract("path", r"([^/]*)$", 1))
    return cut.withColumn("_n", last).where("_n = 1").select(
        "s.code", "s.control_id", "s.name", F.when(kind == "", "未分类").otherwise(kind).alias("item_type"), X.license_nf(F.col("s.body")).alias("applicable_nf"), "s.body"
    )


def license_edges(found: DataFrame, feature_codes: DataFrame, nf: str) -> DataFrame:
    """Licence to the features that its text names and that exist."""
    named = found.select("code", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(X.FEATURE_CODE), 0))).alias("feature"))
    known = named.join(feature_codes.select(F.col("code").alias("feature")).distinct(), "feature", "left_semi")
    return known.select(F.concat(F.lit(f"{nf}@License@"), "code").alias("from_id"), F.lit("对应特性").alias("relation"), F.concat(F.lit(f"{nf}@Feature@"), "feature").alias("to_id"))


def rewrite_references(docs: DataFrame, nf: str, commands: DataFrame, sources: DataFrame, feature_codes: DataFrame) -> DataFrame:
    """(key, md, n_resolved, n_stripped, commands array): links of (key, md) turned into logical references.

    In turn: a command named in full-width brackets of the file name or label, or by the bare label; the exact source file
    (sources: filename, id); a feature code in the file name; else only the label stays. External links and anchors stay whole.
    Links are exploded, resolved by three joins and put back in their places.
    """
    link = r"(?<!!)\[([^\]]*)\]\(([^)]*)\)"
    whole = F.regexp_extract_all("md", F.lit(link), 0)
    texts = docs.select("key", F.split("md", link, -1).alias("between"), whole.alias("links"), F.regexp_extract_all("md", F.lit(link), 1).alias("labels"), F.regexp_extract_all("md", F.lit(link), 2).alias("inners"))
    rows = texts.select("key", F.posexplode(F.arrays_zip("links", "labels", "inners")).alias("at", "l"))
    url = X.link_target(F.col("l.inners"))
    leaf = F.regexp_extract(F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url), r"([^/]*)$", 1)
    named = F.trim(F.regexp_extract(leaf, "（([^（）()]+)）", 1))
    labelled = F.trim(F.regexp_extract("l.labels", "（([^（）()]+)）", 1))
    bare = F.btrim(F.trim("l.labels"), F.lit("* "))
    rows = rows.select(
        "key",
        "at",
        F.col("l.links").alias("link"),
        F.col("l.labels").alias("label"),
        url.rlike(r"^(https?://|//|mailto:|tel:|data:|#)|^$").alias("stays"),
        leaf.alias("leaf"),
        F.when(named != "", named).when(labelled != "", labelled).otherwise(bare).alias("command"),
        F.regexp_extract(leaf, f"({X.FEATURE_CODE})", 1).alias("code"),
    )
    found = (
        rows.join(commands.select(F.col("name").alias("command"), F.lit(True).alias("is_command")).distinct(), "command", "left")
        .join(sources.groupBy(F.col("filename").alias("leaf")).agg(F.min("id").alias("source_id")), "leaf", "left")
        .join(feature_codes.select("code", F.lit(True).alias("is_feature")).distinct(), "code", "left")
    )
    target = (
        F.when(F.col("is_command"), F.concat(F.lit(f"{nf}@MMLCommand@"), "command"))
        .when(F.col("source_id").isNotNull(), F.col("source_id"))
        .when(F.col("is_feature"), F.concat(F.lit(f"{nf}@Feature@"), "code"))
    )
    text = F.when(F.col("stays"), F.col("link")).when(target.isNotNull(), F.concat(F.lit("[["), target, F.lit("]]"))).otherwise(F.col("label"))
    solved = found.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("at", text.alias("text")))).alias("texts"),
        F.count_if(~F.col("stays") & target.isNotNull()).alias("n_resolved"),
        F.count_if(~F.col("stays") & target.isNull()).alias("n_stripped"),
        F.array_sort(F.collect_set(F.when(~F.col("stays") & F.col("is_command"), F.col("command")))).alias("commands"),
    )
    both = texts.join(solved, "key", "left")
    pieces = F.transform("between", lambda b, i: F.concat(b, F.coalesce(F.try_element_at(F.col("texts"), i + 1)["text"], F.lit(""))))
    return both.select(
        "key",
        F.array_join(pieces, "").alias("md"),
        F.coalesce("n_resolved", F.lit(0)).alias("n_resolved"),
        F.coalesce("n_stripped", F.lit(0)).alias("n_stripped"),
        F.coalesce("commands", F.array().cast("array<string>")).alias("commands"),
    )


def category_path(pages: DataFrame, folders: list[str]) -> DataFrame:
    """Adds category array<string>: the folders below the first of ``folders`` that holds the page."""
    rest = None
    for folder in folders:
        prefix = folder.rstrip("/") + "/"
        under = F.col("path").startswith(prefix)
        own = F.substring("path", F.lit(len(prefix) + 1), F.length("path"))
        rest = F.when(under, own) if rest is None else rest.when(under, own)
    parts = F.split(rest.otherwise(F.lit(None)) if rest is not None else F.lit(None).cast("string"), "/", -1)
    return pages.withColumn("category", F.when(parts.isNotNull(), F.slice(parts, F.lit(1), F.size(parts) - 1)))


def locate_folders(folders: DataFrame, keywords: DataFrame, nf: str, most: int = 30) -> DataFrame:
    """(role, path, strict, rank): for each role's keyword, folders whose name holds it, at most ``most``, shallow ones first.

    Where some also name the network function, only those count. Cases do not matter. Keywords are few: a broadcast.
    """
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    pairs = folders.join(F.broadcast(keywords), F.contains(name, F.lower("keyword")))
    pairs = pairs.withColumn("strict", F.contains(F.lower("path"), F.lit(nf.lower())))
    by_role = Window.partitionBy("role")
    pairs = pairs.withColumn("_any", F.max("strict").over(by_role)).where("strict = _any")
    depth = F.size(F.split("path", "/", -1))
    rank = F.row_number().over(by_role.orderBy(depth, "path"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most).select("role", "path", "strict", "rank")


class Builder(NamedTuple):
    """What builds a layer: the layers that it needs, and the roles of the folders that it reads."""

    layer: str
    needs: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()


class Mode(NamedTuple):
    """A kind of product documentation: key words of its folders by role, its builders in order."""

    name: str
    keywords: dict[str, tuple[str, ...]]
    builders: tuple[Builder, ...]
    two_pass: bool = False


# The folder names and building order of the one kind of documentation that comes with the library.
MODES: dict[str, Mode] = {
    "5gc": Mode(
        "5GC产品文档",
        {"mml": ("MML命令", "MML 命令", "命令参考"), "feature": ("特性指南",), "license": ("License描述", "License 控制", "License控制")},
        (
            Builder("Command", (), ("mml",)),
            Builder("ConfigObject", ("Command",)),
            Builder("License", (), ("license", "feature")),
            Builder("Feature", ("Command", "License"), ("feature",)),
        ),
        two_pass=True,
    )
}


def register_mode(key: str, mode: Mode) -> None:
    """Adds a kind of documentation. Every builder's needs must come before it."""
    seen: set[str] = set()
    for builder in mode.builders:
        if missing := [x for x in builder.needs if x not in seen]:
            raise ValueError(f"{builder.layer} is built before {missing}")
        seen.add(builder.layer)
    MODES[key] = mode


def list_modes(spark: SparkSession) -> DataFrame:
    """(id, name, layers array<string> in building order, two_pass) of the kinds that are registered."""
    rows = [(key, m.name, [b.layer for b in m.builders], m.two_pass) for key, m in MODES.items()]
    return spark.createDataFrame(rows, "id string, name string, layers array<string>, two_pass boolean")


def mode_keywords(spark: SparkSession, mode: str) -> DataFrame:
    """(role, keyword) of a kind of documentation, for ``locate_folders``."""
    rows = [(role, word) for role, words in MODES[mode].keywords.items() for word in words]
    return spark.createDataFrame(rows, "role string, keyword string")


def scope_closure(scope: list[str], existing: set[str], mode: str = "5gc") -> tuple[list[str], list[str]]:
    """(layers to build in order, notes): what a scope needs and does not find is added. Unknown layers are refused."""
    builders = MODES[mode].builders
    if unknown := [x for x in scope if x not in {b.layer for b in builders}]:
        raise ValueError(f"unknown layers: {unknown}")
    chosen, notes = set(scope), []
    for builder in builders:
        if builder.layer in scope:
            for need in builder.needs:
                if need not in chosen and need not in existing:
                    chosen.add(need)
                    notes.append(f"{builder.layer} needs {need}")
    return [b.layer for b in builders if b.layer in chosen], notes


def building_steps(scope: list[str], mode: str = "5gc") -> list[str]:
    """The layers in the order of their runs: where features are built along with commands, the commands' layers run again,
    since their references to features can only be kept once there are features."""
    steps = [b.layer for b in MODES[mode].builders if b.layer in scope]
    again = [x for x in steps if x in ("Command", "ConfigObject")] if MODES[mode].two_pass and {"Command", "Feature"} <= set(scope) else []
    return steps + again


def manifest(assets: DataFrame) -> DataFrame:
    """One JSON row of the number of assets of each type: (manifest)."""
    counts = assets.groupBy("type").agg(F.count("*").alias("count"))
    return counts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "count"))))).alias("manifest"))


def _counted(layer: str, rows: DataFrame, **counts: Column) -> DataFrame:
    found = rows.agg(*(c.alias(name) for name, c in counts.items()))
    return found.select(F.lit(layer).alias("layer"), F.to_json(F.struct(*counts)).alias("manifest"))


def command_manifest(commands: DataFrame) -> DataFrame:
    """(layer, manifest): commands, dangerous ones, configuration objects that they name."""
    objects = F.count_distinct(F.when(F.col("object") != "", F.col("object")))
    return _counted("Command", commands, commands=F.count("*"), dangerous=F.count_if(X.is_dangerous(F.col("md"))), objects=objects)


def object_manifest(found: DataFrame) -> DataFrame:
    """(layer, manifest) of ``families``: objects, and those of each kind."""
    kinds = {k: F.count_if(F.col("object_kind") == k) for k in ("entity", "global_setting", "query_target")}
    return _counted("ConfigObject", found, objects=F.count("*"), **kinds)


def license_manifest(found: DataFrame, dropped: DataFrame) -> DataFrame:
    """(layer, manifest) of ``licenses``: licences, and references to features that do not exist (rows of ``dropped``)."""
    both = found.select(F.lit(1).alias("mine"), F.lit(0).alias("gone")).unionByName(dropped.select(F.lit(0).alias("mine"), F.lit(1).alias("gone")))
    return _counted("License", both, licenses=F.coalesce(F.sum("mine"), F.lit(0)), dangling=F.coalesce(F.sum("gone"), F.lit(0)))


def feature_manifest(docs: DataFrame) -> DataFrame:
    """(layer, manifest) of ``feature_documents``: features, documents, overviews."""
    return _counted("Feature", docs, features=F.count_distinct("code"), documents=F.count("*"), overviews=F.count_if("is_overview"))


def extracted_edges(commands: DataFrame, nf: str, extractors: list[Callable[[str, str], Iterable[tuple[str, str]]]]) -> DataFrame:
    """Edges (from_id, relation, to_id) of plug-ins that give (relation, ``Type@local``) for a command's page (md, name).

    The plug-ins run in Arrow batches on the executors. One that fails costs its own edges of that page only.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for name, md in zip(pdf["name"], pdf["md"]):
                for extract in extractors:
                    try:
                        rows += [(name, relation, target) for relation, target in extract(md or "", name)]
                    except Exception:  # noqa: BLE001  a plug-in may fail in any way
                        continue
            yield pd.DataFrame(rows, columns=["name", "relation", "target"])

    found = commands.select("name", "md").mapInPandas(run, "name string, relation string, target string").distinct()
    return found.select(_command_id(nf, "name").alias("from_id"), "relation", F.concat(F.lit(f"{nf}@"), "target").alias("to_id"))
