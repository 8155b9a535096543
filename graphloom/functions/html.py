"""HTML pages to Markdown: a document tree, rendered block by block, inside an Arrow batch function."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_SKIP = {"script", "style", "nav", "head", "noscript", "template"}
_BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "figure", "figcaption", "dl", "dt", "dd", "details", "summary", "blockquote", "aside", "caption"}
_OTHER_BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "table", "pre", "hr"}
#: Blocks whose text may stand behind the label of a list item, or as a line of a table cell.
_TEXT_BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "aside", "li"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CELLS = {"td", "th", "tr", "tbody", "thead", "tfoot", "table"}
#: Elements that a start tag ends, and between what they stay open.
_ENDED_BY = {"li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "p": {"p"}, "head": {"body"}}
_HOLDS = {"li": ("ul", "ol", "table"), "td": ("table",), "th": ("table",), "tr": ("table",), "dt": ("dl", "table"), "dd": ("dl", "table"), "p": ("li", "td", "th", "div", "section", "blockquote", "dd", "figure"), "head": ()}
#: For each start tag, the elements that it ends, in their order.
_ENDS = {tag: [closed for closed, ends in _ENDED_BY.items() if tag in ends] for tag in {t for ends in _ENDED_BY.values() for t in ends}}
#: Elements that lie deeper are read as if they stood in the last one that does not.
MOST_DEPTH = 150
_WRAP = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
# What stands over the blocks of a class, in this order.
_ADVICE = {"note": "说明", "warning": "警告", "caution": "注意", "tip": "提示"}
# Classes of a block's title, and the steps of Roman numerals.
_TITLES = ("notetitle", "warningtitle", "cautiontitle", "tiptitle")
_ROMAN = ((10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
_ADDRESS = re.compile(r"""(?i)\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def list_label(number: int, kind: str) -> str:
    """The label of an item of a numbered list: ``a``, ``A``, ``i``, ``I`` or a plain number."""
    if kind in ("a", "A") and 1 <= number <= 26:
        return chr(ord(kind) + number - 1) + "."
    if kind in ("i", "I") and number > 0:
        text = ""
        for value, letters in _ROMAN:
            text += letters * (number // value)
            number %= value
        return (text.upper() if kind == "I" else text) + "."
    return f"{number}."


def url_kind(url: str) -> str:
    """``empty``, ``anchor``, ``remote`` or ``local``."""
    url = url.strip()
    if not url:
        return "empty"
    if url.startswith("#"):
        return "anchor"
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", url)
    return "remote" if url.startswith("//") or scheme and scheme[1].lower() != "file" else "local"


def local_target(url: str, page: str) -> tuple[str, str] | None:
    """(path, anchor) of a local address on a page, both below the same root; None for other addresses."""
    if url_kind(url) != "local":
        return None
    path, _, anchor = url.strip().partition("#")
    path = unquote(path.partition("?")[0].removeprefix("file:"))
    return (posixpath.normpath(posixpath.join(posixpath.dirname(page), path)), anchor) if path else None


def rewritten(url: str, page: str, targets: dict[str, str]) -> str:
    """An address with a local page replaced by the path of its document, relative to the document of ``page``."""
    found = local_target(url, page)
    if found is None or found[0] not in targets:
        return url
    own = posixpath.dirname(targets.get(page, page)) or "."
    return posixpath.relpath(targets[found[0]], own) + (f"#{found[1]}" if found[1] else "")


@dataclass
class Node:
    """An element with its attributes and what it holds: elements and texts."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    block: bool | None = None  # what ``_Renderer.is_block`` has found

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").lower().split()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else c.text() for c in self.children)

    def first(self, fits) -> Node | None:
        """The first element below, in reading order, that fits; advisory blocks within are left out."""
        for child in self.children:
            if isinstance(child, Node):
                found = child if fits(child) else None if advice_of(child) else child.first(fits)
                if found:
                    return found
        return None


class _Tree(HTMLParser):
    """Builds the document's tree. End tags that are left out are filled in; an end tag closes nothing outside its table cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open: list[tuple[str, Node]] = [("", self.root)]  # the tags that are open, and where their children go

    def handle_starttag(self, tag, attrs):
        for closed in _ENDS.get(tag, ()):
            self.end(closed, _HOLDS[closed])
        node = Node(tag, {k: v or "" for k, v in attrs})
        top = self.open[-1][1]
        if len(self.open) < MOST_DEPTH or tag in _VOID:
            top.children.append(node)
        else:
            node = top  # what lies deeper is read as if it stood here
        if tag not in _VOID:
            self.open.append((tag, node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.end(tag, ())

    def handle_endtag(self, tag):
        self.end(tag, () if tag in _CELLS else ("td", "th"))

    def end(self, tag: str, within: tuple[str, ...]) -> None:
        """Closes the innermost open ``tag`` and all in it, unless one of ``within`` stands between."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                return
            if self.open[at][0] in within:
                return

    def handle_data(self, data):
        self.open[-1][1].children.append(data)


def advice_of(node: Node) -> str | None:
    """The label of an advisory block."""
    if node.tag not in _BLOCK or "class" not in node.attrs:
        return None
    classes = node.classes()
    if any(c.startswith("mml") or c in _TITLES for c in classes):
        return None
    return next((label for word, label in _ADVICE.items() if any(word in c and not c.endswith("body") for c in classes)), None)


class _Renderer:
    """Renders a tree: ``blocks`` gives the blocks of an element, which hold those of the elements in it."""

    def __init__(self, links: dict[str, str], page: str):
        self.links, self.page = links, page

    def is_block(self, node) -> bool:
        """Whether an element is a block, or has one in it."""
        if isinstance(node, str) or node.tag in _SKIP:
            return False
        if node.block is None:
            node.block = node.tag in _BLOCK or node.tag in _OTHER_BLOCKS or any(map(self.is_block, node.children))
        return node.block

    def inline(self, node) -> str:
        """Text with marks, its white space as it is; a line break is a zero character until ``clean``."""
        if isinstance(node, str):
            return node.replace("\0", "")
        if node.tag in _SKIP:
            return ""
        if node.tag == "br":
            return "\0"
        if node.tag == "img":
            return f"![{node.attrs.get('alt', '')}]({rewritten(node.attrs['src'], self.page, self.links)})" if node.attrs.get("src") else node.attrs.get("alt", "")
        inner = "".join(map(self.inline, node.children))
        if node.tag in _WRAP:
            mark = _WRAP[node.tag]
            return mark + inner + mark if inner.strip() else inner
        if node.tag == "a" and node.attrs.get("href"):
            href = rewritten(node.attrs["href"], self.page, self.links)
            return f"[{inner if inner.strip() else node.attrs['href']}]({href})"
        if node.tag in ("sup", "sub"):
            return f"<{node.tag}>{inner}</{node.tag}>" if inner.strip() else inner
        return inner

    def blocks(self, node: Node, title: Node | None = None) -> list[str]:
        """The blocks that an element holds, its own texts among them; ``title`` is told elsewhere."""
        out, run = [], []
        for child in node.children:
            if child is title:
                continue
            if self.is_block(child):
                out += self.paragraph(run)
                run = []
                out += self.block(child)
            else:
                run.append(self.inline(child))
        return out + self.paragraph(run)

    @staticmethod
    def paragraph(run: list[str]) -> list[str]:
        text = clean("".join(run))
        return [text] if text else []

    def block(self, node: Node) -> list[str]:
        """An element that is a block, as blocks."""
        tag = node.tag
        if label := advice_of(node):
            return self.advice(node, label)
        if re.fullmatch(r"h[1-6]", tag):
            text = clean(self.inline(node)).replace("\n", " ")
            return ["#" * int(tag[1]) + " " + text] if text else []
        if tag in ("ul", "ol"):
            return self.list_of(node)
        if tag == "table":
            return self.table(node)
        if tag == "pre":
            return self.code(node)
        if tag == "hr":
            return ["---"]
        if tag == "blockquote":
            return quoted("\n\n".join(self.blocks(node)).split("\n"))
        if tag == "dl":
            return self.definitions(node)
        if tag in ("figcaption", "summary", "caption"):
            mark, text = "**" if tag == "summary" else "*", clean(self.inline(node))
            return [mark + text + mark] if text else []
        if tag == "div" and any("fignone" in c for c in node.classes()):
            return self.vendor_figure(node)
        return self.blocks(node)

    def advice(self, node: Node, label: str) -> list[str]:
        title = node.first(lambda n: any(c in _TITLES for c in n.classes()))
        named = " ".join(title.text().split()) if title else ""
        inner = self.blocks(self.without(node, title) if title else node)
        return quoted([f"**{named or label}**", *"\n\n".join(inner).split("\n")]) if inner else []

    def without(self, node: Node, gone: Node) -> Node:
        """A copy of the tree without one element."""
        return Node(node.tag, node.attrs, [c if isinstance(c, str) else self.without(c, gone) for c in node.children if c is not gone])

    def vendor_figure(self, node: Node) -> list[str]:
        """A figure whose caption is an element of class ``figcap``: the caption comes first."""
        caption = next((c for c in node.children if isinstance(c, Node) and any("figcap" in x for x in c.classes())), None)
        return (self.paragraph([self.inline(caption)]) if caption else []) + self.blocks(node, caption)

    def list_of(self, node: Node) -> list[str]:
        """A list as one block: an item's first text behind its label, its other blocks below, moved in."""
        items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
        if not items:
            return self.blocks(node)
        ordered, kind = node.tag == "ol", node.attrs.get("type", "").strip()
        number = int(node.attrs["start"]) if re.fullmatch(r"\d{1,18}", node.attrs.get("start", "")) else 1
        lines: list[str] = []
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li":
                label = list_label(number, kind) if ordered else "-"
                number += 1
                first, below = self.item(child)
                lines.append(f"{label} {first}".rstrip())
            else:  # a list or a text between the items belongs to the one before
                below = self.block(child) if self.is_block(child) else self.paragraph([self.inline(child)])
            lines += [moved_in(b) for b in below]
        return ["\n".join(lines)]

    def item(self, node: Node) -> tuple[str, list[str]]:
        """The first text of a list item, and the blocks below it."""
        inside = self.blocks(node)
        starts_with_text = True
        for child in node.children:
            if isinstance(child, str) and not child.strip() or isinstance(child, Node) and not self.is_block(child) and not clean(self.inline(child)):
                continue
            starts_with_text = not self.is_block(child) or child.tag in _TEXT_BLOCKS and not advice_of(child)
            while starts_with_text and self.is_block(child):  # what a paragraph or a section begins with
                child = next((c for c in child.children if not isinstance(c, str) or c.strip()), "")
                starts_with_text = not self.is_block(child) or child.tag in _TEXT_BLOCKS and not advice_of(child)
            break
        return (inside[0], inside[1:]) if inside and starts_with_text else ("", inside)

    def definitions(self, node: Node) -> list[str]:
        lines: list[str] = []
        for child in node.children:
            if isinstance(child, Node) and child.tag == "dt":
                if text := clean(self.inline(child)):
                    lines.append(f"- **{text}**")
            elif isinstance(child, Node) and child.tag == "dd":
                lines += [moved_in(b) for b in self.blocks(child)]
            else:
                lines += self.block(child) if self.is_block(child) else self.paragraph([self.inline(child)])
        return ["\n".join(lines)] if lines else []

    @staticmethod
    def code(node: Node) -> list[str]:
        own = next((c for c in node.children if isinstance(c, Node) and c.tag == "code"), None)
        text = re.sub(r"\n{3,}", "\n\n", node.text().removeprefix("\n").rstrip())
        language = next((m[1] for n in (own, node) if n for c in n.classes() if (m := re.fullmatch(r"lang(?:uage)?-(\S+)", c))), "")
        fence = "`" * max(3, 1 + max(map(len, re.findall("`+", text)), default=0))
        return [f"{fence}{language}\n{text}\n{fence}"]

    def table(self, node: Node) -> list[str]:
        rows, captions = [], []

        def collect(inside: Node) -> None:
            for child in inside.children:
                if not isinstance(child, Node):
                    continue
                if child.tag == "tr":
                    cells = [c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th")]
                    rows.append([{"text": self.cell(c), "rows": span(c, "rowspan"), "cols": span(c, "colspan")} for c in cells])
                elif child.tag in ("td", "th"):  # a cell outside a row
                    if not rows:
                        rows.append([])
                    rows[-1].append({"text": self.cell(child), "rows": span(child, "rowspan"), "cols": span(child, "colspan")})
                elif child.tag == "caption":
                    captions.extend(self.block(child))
                elif child.tag != "table":
                    collect(child)

        collect(node)
        text = table_text(rows)
        return [re.sub(r"\s+", " ", c) for c in captions] + [text] if text else []

    def cell(self, node: Node) -> list[str]:
        """The lines of a table cell."""
        if any(isinstance(c, Node) and advice_of(c) for c in node.children) or any(map(self.is_block, node.children)):
            out, run = [], []
            for child in node.children:
                if not self.is_block(child):
                    run.append(self.inline(child))
                    continue
                out += self.paragraph(run)
                run = []
                if advice_of(child):
                    title = child.first(lambda n: any(c in _TITLES for c in n.classes()))
                    inner = self.cell(self.without(child, title) if title else child)
                    out.append(" ".join([*([" ".join(title.text().split())] if title else []), "<br>".join(inner)]).strip())
                elif child.tag == "pre":
                    text = " ".join(child.text().split())
                    out += [f"``{text}``" if "`" in text else f"`{text}`"] if text else []
                elif child.tag in _TEXT_BLOCKS or child.tag not in _OTHER_BLOCKS:
                    out += self.cell(child)
                else:
                    out += self.block(child)
            return out + self.paragraph(run)
        return self.paragraph([self.inline(node)])


def span(cell: Node, name: str) -> int:
    value = cell.attrs.get(name, "").strip()
    return int(value) if value.isdigit() and int(value) else 1


def clean(raw: str) -> str:
    """White space as single blanks, a line break as a line feed without blanks around it."""
    text = re.sub(r"\s+", " ", raw.replace("\xa0", " "))
    return re.sub(r" *\0 *", "\n", text).strip()


def quoted(lines: list[str]) -> list[str]:
    return ["\n".join(f"> {x}" if x.strip() else ">" for x in lines)] if any(x.strip() for x in lines) else []


def moved_in(block: str) -> str:
    return "\n".join("  " + x if x.strip() else x for x in block.split("\n"))


def table_text(rows: list[list[dict]]) -> str:
    """A pipe table; cells that span rows or columns are repeated in all their places, as many as the page says."""
    grid: list[dict[int, str]] = []
    for y, row in enumerate(rows):
        while len(grid) <= y:
            grid.append({})
        x = 0
        for cell in row:
            while x in grid[y]:
                x += 1
            text = "<br>".join(cell["text"]).replace("|", "\\|").replace("\n", "<br>")
            for dy in range(min(cell["rows"], len(rows) - y)):
                while len(grid) <= y + dy:
                    grid.append({})
                for dx in range(cell["cols"]):
                    grid[y + dy].setdefault(x + dx, text)
            x += cell["cols"]
    width = max((max(r, default=-1) + 1 for r in grid), default=0)
    lines = ["| " + " | ".join(r.get(x, "") for x in range(width)) + " |" for r in grid if r]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) if lines and width else ""


def to_markdown(html: str | None, links: dict[str, str] | None = None, page: str = "") -> str | None:
    """Markdown of a page; ``links`` maps the paths of pages to those of the documents that they become, ``page`` is its own path."""
    if html is None:
        return None
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return "\n\n".join(_Renderer(links or {}, page).blocks(tree.root))


@F.pandas_udf(StringType())
def html_to_markdown(pages: pd.Series) -> pd.Series:
    """One page after the other in Python, in Arrow batches: the parser is a state machine that no built-in function has."""
    return pages.map(to_markdown)


@F.pandas_udf(StringType())
def linked_markdown(pages: pd.Series, paths: pd.Series, links: pd.Series) -> pd.Series:
    return pd.Series([to_markdown(h, dict(m if m is not None else {}), p or "") for h, p, m in zip(pages, paths, links)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def local_links(pages: pd.Series, paths: pd.Series) -> pd.Series:
    """The local pages and files that a page names, as paths below the root of its own path."""

    def one(html, page):
        urls = [a or b for a, b in _ADDRESS.findall(html or "")]
        return sorted({found[0] for url in urls if (found := local_target(unescape(url), page or "")) is not None})

    return pd.Series([one(h, p) for h, p in zip(pages, paths)], dtype=object)


def convert_pages(pages: DataFrame, suffix: str = ".md") -> DataFrame:
    """(path, md_path, md) of pages (path, html): Markdown whose links to other pages lead to their documents.

    Links are exploded and joined with the pages; a page gets the targets of its own links only.
    """
    target = F.concat(F.regexp_replace("path", r"(?i)\.html?$", ""), F.lit(suffix))
    pages = pages.select("path", "html", target.alias("md_path"))
    named = pages.select("path", F.explode(F.array_union(local_links("html", "path"), F.array("path"))).alias("link"))
    known = named.join(pages.select(F.col("path").alias("link"), F.col("md_path").alias("to")), "link")
    links = known.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("link", "to"))).alias("links"))
    both = pages.join(links, "path", "left")
    return both.select("path", "md_path", linked_markdown("html", "path", "links").alias("md"))


def is_meaningful(html: Column) -> Column:
    """Whether a page holds structure (tables, lists, images, code) or 20 characters besides titles and copyright lines."""
    body = F.regexp_replace(html, r"(?is)<(script|style|title|head|nav|h[1-6])\b.*?</\1\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"(?im)^.*(copyright|版权所有|©).*$", " ")
    return F.coalesce(body.rlike(r"(?i)<(table|ul|ol|img|pre|figure)\b") | (F.length(F.regexp_replace(text, r"(?U)\s+", "")) >= 20), F.lit(False))
