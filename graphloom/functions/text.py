"""Text rules of the document layers as column expressions: titles, sections, codes, tables, slugs, edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, words and names of the document layers.
FEATURE_CODE = r"[A-Z]{2,5}FD-\d{6}"
LICENSE_CODE = r"LKV[A-Z0-9]{6,}"
TOC_LINE = r"(?m)^[^\S\n]*-\s+\[.+?\]\(#.+?\)[^\S\n]*$"
CONFIG_VERBS = ("ADD", "MOD", "DEL", "RMV", "SET")
DANGEROUS = ("高危", "谨慎使用", "严重影响", "破坏性")
ZH_VERBS = ("增加", "添加", "修改", "删除", "查询", "显示", "设置", "配置", "激活", "清除", "刷新", "加载", "去激活")
DOC_TYPES = (
    ("特性概述", "概述"),
    ("去激活", "去激活"),
    ("激活", "激活"),
    ("调测", "调测"),
    ("参考信息", "参考信息"),
    ("影响", "影响"),
    ("原理", "原理"),
    ("配置", "配置"),
    ("部署", "部署"),
    ("术语", "术语"),
)
FOLDER_TYPES = {"实现原理": "原理", "原理": "原理", "特性配置": "配置", "配置": "配置", "参考信息": "参考信息", "调测": "调测"}
PARAM_HEADS = ("参数标识", "Parameter", "参数", "名称")
FUNCTION_SECTION, PARAM_SECTION, EDGE_HEADING, NO_EDGES = "命令功能", "参数说明", "## 边", "（暂无）"


def normal_newlines(text: Column) -> Column:
    """Any run of carriage returns before a line feed, and any left over, as one line feed."""
    return F.replace(F.regexp_replace(text, r"\r+\n", "\n"), F.lit("\r"), F.lit("\n"))


def without_table_gaps(text: Column) -> Column:
    """Blank lines between two rows of a pipe table are removed; others stay."""
    row = r"[^\S\n]*\|[^\n]*\|[^\S\n]*"
    return F.regexp_replace(text, rf"(?m)^({row})\n(?:[^\S\n]*\n)++(?={row}(?:\n|\z))", "$1\n")


def split_document(text: Column) -> Column:
    """struct(front, body, edges): the YAML block, the text, and the trailing edge section (empty where there is none)."""
    text = normal_newlines(text)
    pattern = r"(?s)\A---\s*\n(.*?)\n---\s*\n?(.*)\z"
    has = text.rlike(pattern)
    front = F.when(has, F.regexp_extract(text, pattern, 1)).otherwise("")
    body = without_table_gaps(F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text))
    body = F.concat(F.lit("\n"), body)
    cut = F.regexp_instr(body, F.lit(r"\n##\s*边\s*\n"))
    return F.struct(
        front.alias("front"),
        F.when(cut > 0, F.regexp_replace(F.left(body, cut - 1), r"\n+\z", "")).otherwise(F.substring(body, F.lit(2), F.length(body))).alias("body"),
        F.when(cut > 0, F.regexp_replace(F.substring(body, cut, F.length(body)), r"\A\n+", "")).otherwise("").alias("edges"),
    )


def edge_links(section: Column) -> Column:
    """array<struct<relation, to_id>> of an edge section, first of repeats kept, in order.

    A line is ``- relation: [[target]]`` with any number of targets; the colon is ASCII.
    """
    line = r"^\s*-\s*([^:]+?):\s*(.+?)\s*$"
    lines = F.filter(F.split(section, "\n", -1), lambda x: x.rlike(line))

    def links(x):
        targets = F.regexp_extract_all(F.regexp_extract(x, line, 2), F.lit(r"\[\[([^\]]+)\]\]"), 1)
        relation = F.trim(F.regexp_extract(x, line, 1))
        return F.transform(targets, lambda t: F.struct(relation.alias("relation"), F.trim(t).alias("to_id")))

    return F.array_distinct(F.flatten(F.transform(lines, links)))


def edge_section(edges: Column) -> Column:
    """The edge section of an ``array<struct<relation, to_id>>``."""
    lines = F.transform(edges, lambda e: F.concat(F.lit("- "), e["relation"], F.lit(": [["), e["to_id"], F.lit("]]")))
    return F.concat(F.lit(EDGE_HEADING + "\n"), F.when(F.size(edges) > 0, F.array_join(lines, "\n")).otherwise(NO_EDGES))


def first_heading(md: Column) -> Column:
    return F.regexp_extract(md, r"(?m)^\s*#\s+(.+?)\s*$", 1)


def command_title(md: Column, strict: bool = True) -> Column:
    """struct(name_zh, name) of a heading ``中文（VERB OBJECT）``; both empty where the page is no command.

    The loose form takes any heading; without brackets the whole of it is the name.
    """
    title = F.regexp_extract(md, r"(?m)^#\s+(.+?)\s*$", 1)
    pattern = r"^(.+?)[（(]\s*([^（）()]+?)\s*[）)]\s*$"
    zh, name = F.trim(F.regexp_extract(title, pattern, 1)), F.trim(F.regexp_extract(title, pattern, 2))
    if strict:
        good = name.rlike(r"^[A-Z][A-Z0-9_]{1,}(?:\s+[A-Z0-9][A-Z0-9_]*)*$")
        return F.struct(F.when(good, zh).otherwise("").alias("name_zh"), F.when(good, name).otherwise("").alias("name"))
    return F.struct(zh.alias("name_zh"), F.when(name != "", name).otherwise(title).alias("name"))


def section(md: Column, name: str) -> Column:
    """Text below the first heading of that name up to the next heading; empty where there is none."""
    lines = F.split(md, r"\r?\n", -1)

    def heading(x):
        bare = F.regexp_replace(F.regexp_replace(x, r"^#+\s*", ""), r"\([^)]*\)", "")
        return F.when(x.startswith("#"), F.btrim(bare, F.lit(" []　")))

    start = F.array_position(F.transform(lines, heading), F.lit(name)).cast("int")
    rest = F.slice(lines, start + 1, F.size(lines))
    stop = F.array_position(F.transform(rest, lambda x: x.startswith("#")), F.lit(True)).cast("int")
    body = F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest)
    return F.when(start > 0, F.regexp_replace(F.array_join(body, "\n"), r"(?U)\A\s+|\s+\z", "")).otherwise("")


def split_names(raw: Column) -> Column:
    parts = F.transform(F.split(raw, "[、,，/]", -1), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def applicable_nf(function_text: Column) -> Column:
    raw = F.regexp_extract(function_text, r"适用NF\s*[：:]\s*([^\n]+)", 1)
    return split_names(F.btrim(F.trim(raw), F.lit("* ")))


def effect_mode(notes: Column) -> Column:
    """The first rule that fits decides."""
    return (
        F.when(F.contains(notes, F.lit("立即生效")), "立即生效")
        .when(F.contains(notes, F.lit("对新流")), "对新流生效")
        .when(F.contains(notes, F.lit("对新用户")), "对新用户生效")
        .when(F.contains(notes, F.lit("延迟")) | F.contains(notes, F.lit("重启")), "延迟生效")
        .otherwise("")
    )


def is_dangerous(text: Column) -> Column:
    return F.coalesce(text.rlike("|".join(DANGEROUS)), F.lit(False))


def verb_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^\s*(\S+)", 1)


def object_of(name: Column) -> Column:
    """The second word of a command; empty where there is none."""
    return F.regexp_extract(name, r"^\s*\S+\s+(\S+)", 1)


def object_kind(verbs: Column) -> Column:
    """What a configuration object is, from the verbs that its commands have."""
    has = lambda *v: F.arrays_overlap(verbs, F.array(*(F.lit(x) for x in v)))
    only_queries = (F.size(verbs) > 0) & (F.size(F.array_except(verbs, F.array(F.lit("LST"), F.lit("DSP")))) == 0)
    return F.when(has("ADD", "MOD", "DEL", "RMV"), "entity").when(has("SET"), "global_setting").when(only_queries, "query_target").otherwise("entity")


def strip_zh_verb(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, f"^(?:{'|'.join(ZH_VERBS)})", ""))


def param_rows(md: Column) -> Column:
    """array<struct<id, name, text>> of the parameter table, without its head and rule."""
    lines = F.filter(F.split(section(md, PARAM_SECTION), "\n", -1), lambda x: F.trim(x).startswith("|"))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.btrim(F.trim(x), F.lit("|")), r"\|", -1), lambda c: F.trim(c)))
    good = F.filter(cells, lambda c: (F.size(c) >= 3) & ~c[0].isin(*PARAM_HEADS) & ~c[0].rlike(r"^[- :]*$"))
    return F.transform(good, lambda c: F.struct(c[0].alias("id"), c[1].alias("name"), c[2].alias("text")))


def clean_markdown(md: Column) -> Column:
    """Without table-of-contents lines and heading anchors; at most one blank line in a row."""
    lines = F.filter(F.split(md, r"\r?\n", -1), lambda x: ~x.rlike(r"^\s*-\s+\[.+?\]\(#.+?\)\s*$"))
    plain = F.transform(lines, lambda x: F.when(x.startswith("#"), F.translate(F.regexp_replace(x, r"\]\(#.*?\)", "]"), "[]", "")).otherwise(x))
    return F.regexp_replace(F.regexp_replace(F.array_join(plain, "\n"), r"\n{3,}", "\n\n"), r"(?U)\A\s+|\s+\z", "")


def prose(md: Column) -> Column:
    """Without fenced code (an open fence runs to the end) and table-of-contents lines."""
    return F.regexp_replace(F.regexp_replace(md, r"(?ms)^[^\S\n]*```.*?(?:^[^\S\n]*```[^\n]*$|\z)", ""), TOC_LINE, "")


def codes_in(md: Column, pattern: str, exclude: Column | None = None) -> Column:
    """Distinct codes of a text outside code and contents, without the text's own."""
    found = F.array_distinct(F.regexp_extract_all(prose(md), F.lit(pattern), 0))
    return found if exclude is None else F.filter(found, lambda x: x != exclude)


def deepest_code(path: Column) -> Column:
    """The last feature code on a path; empty where there is none. A path segment counts with its first code."""
    per_segment = F.transform(F.split(path, "[/\\\\]", -1), lambda s: F.regexp_extract(s, f"({FEATURE_CODE})", 1))
    return F.coalesce(F.try_element_at(F.filter(per_segment, lambda x: x != ""), F.lit(-1)), F.lit(""))


def doc_type(path: Column) -> Column:
    """Kind of a document by its file name's key words, else by its deepest telling folder."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    found = None
    for word, kind in DOC_TYPES:
        hit = F.contains(name, F.lit(word))
        found = F.when(hit, kind) if found is None else found.when(hit, kind)
    folders = F.create_map(*(F.lit(x) for pair in FOLDER_TYPES.items() for x in pair))
    telling = F.filter(F.transform(F.split(path, "/", -1), lambda s: F.try_element_at(folders, s)), lambda x: x.isNotNull())
    return found.otherwise(F.coalesce(F.try_element_at(telling, F.lit(-1)), F.lit("其它")))


def slug(filename: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(filename, r"(?i)_\d+\.md$", ""), r"(?i)\.md$", "")
    bare = F.trim(F.regexp_replace(bare, r'[\\/:*?"<>|]', ""))
    return F.when(bare == "", "正文").otherwise(bare)


def license_sections(md: Column) -> Column:
    """array<struct<control_id, code, name, body>>: a licence page cut at its licence headings."""
    head = r"(?m)^[^\S\n]*####\s*\[\s*([A-Z0-9]+)\s+(LKV[A-Z0-9]{6,})\s+(.+?)\s*\][^\n]*$"
    part = lambda g: F.regexp_extract_all(md, F.lit(head), g)
    trimmed = lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")
    # the arrays are arguments, not parts of the function, so that each is computed once
    rows = F.transform(
        F.arrays_zip(part(1).alias("control_id"), part(2).alias("code"), part(3).alias("name"), F.slice(F.split(md, head, -1), F.lit(2), F.lit(1_000_000_000)).alias("body")),
        lambda r: F.struct(r["control_id"].alias("control_id"), r["code"].alias("code"), F.trim(r["name"]).alias("name"), trimmed(r["body"]).alias("body")),
    )
    return F.when(md.rlike(head), rows).otherwise(F.array().cast("array<struct<control_id:string,code:string,name:string,body:string>>"))


def license_nf(body: Column) -> Column:
    return split_names(F.btrim(F.trim(F.regexp_extract(body, r"归属NF\s*\|\s*([^|\n]+)", 1)), F.lit("| ")))


def control_item_type(filename: Column) -> Column:
    return F.when(F.contains(filename, F.lit("功能控制项")), "功能").when(F.contains(filename, F.lit("资源控制项")), "资源").otherwise("")


def link_target(inner: Column) -> Column:
    """URL inside link brackets: without title and fragment."""
    return F.trim(F.regexp_extract(F.regexp_extract(F.trim(inner), r'^([^"]*)', 1), r"^([^#]*)", 1))


def safe_filename(name: Column, longest: int = 80) -> Column:
    """Without characters that file systems refuse; long names are cut and end in a hash."""
    clean = F.trim(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', "_"))
    cut = F.concat(F.left(clean, F.lit(longest - 9)), F.lit("_"), F.left(F.md5(clean), F.lit(8)))
    return F.when(F.length(clean) > longest, cut).when(clean == "", "untitled").otherwise(clean)


def version_in(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+\.\d+(?:\.\d+)*)", 1)


def version_matches(text: Column, stated: Column) -> Column:
    """Whether a name's version is the stated one; a name without a version agrees with any."""
    found = version_in(text)
    return (found == "") | (found == stated)


def valid_bundle_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.-]{0,31}\z"), F.lit(False))


def unsafe_member(name: Column) -> Column:
    """Archive members that would leave the folder: absolute, with a drive letter or with parent steps."""
    return name.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")


def file_type(path: Column) -> Column:
    """``folder``, ``md``, ``image`` or ``other`` by a name's suffix; a name without one is a folder."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix == "", "folder").when(suffix == "md", "md").when(suffix.isin("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg"), "image").otherwise("other")


def safe_relative(path: Column) -> Column:
    """A path whose every part is a safe file name; empty and dot parts go."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), lambda x: ~F.trim(x).isin("", ".", ".."))
    return F.array_join(F.transform(parts, lambda x: safe_filename(x)), "/")


def type_in_filename(path: Column) -> Column:
    """The object type in a file name that is an id (``nf@Type@local.md`` or ``Type@slug.md``)."""
    parts = F.split(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?i)\.md$", ""), "@", -1)
    return F.when(F.size(parts) == 3, parts[1]).when(F.size(parts) == 2, parts[0]).otherwise("")


def encoded_links(md: Column) -> Column:
    """Blanks in the targets of links become %20, so that a reader sees whole links."""
    return F.regexp_replace(md, r"(?<=\]\([^()\n]{0,500}) (?=[^()\n]{0,500}\))", "%20")


def with_image_root(md: Column, root: str) -> Column:
    """Image sources that are relative get ``root`` in front."""
    return F.regexp_replace(md, r"(!\[[^\]]*\]\()(?!https?://|/|data:)", f"$1{root.rstrip('/')}/")


def wikilinks(md: Column) -> Column:
    """Distinct targets of ``[[target]]`` in a text, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(md, F.lit(r"\[\[([^\]]+)\]\]"), 1), lambda x: F.trim(x)))


def short_label(id_: Column) -> Column:
    return F.element_at(F.split(id_, "@", -1), -1)


def problems(md: Column) -> Column:
    """array<struct<description, attribution, objects>> of a review's problem blocks."""
    blocks = F.split(md, r"###\s*问题(?U:\b)", -1)
    blocks = F.slice(blocks, F.lit(2), F.size(blocks))

    def field(block, name):
        return F.regexp_extract(block, rf"(?m)^\s*[-*]\s*{name}\s*[:：]\s*(.+?)\s*$", 1)

    def one(block):
        lines = F.transform(F.split(block, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r")))
        # without a description, the first line that is no heading and no field; that may be what follows in the heading itself
        plain = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.rlike(r"^[-*] .*[:：]"))
        fallback = F.coalesce(F.try_element_at(plain, F.lit(1)), F.lit(""))
        description = field(block, "描述")
        parts = F.filter(F.transform(F.split(field(block, "归因"), "[,，、]", -1), lambda x: F.trim(x)), lambda x: x != "")
        objects = F.transform(F.regexp_extract_all(field(block, "涉及对象"), F.lit(r"\[\[([^\]]+)\]\]"), 1), lambda x: F.trim(x))
        return F.struct(F.when(description != "", description).otherwise(fallback).alias("description"), parts.alias("attribution"), objects.alias("objects"))

    return F.transform(blocks, one)
