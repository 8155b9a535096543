import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from graphloom.functions import encoding, html, ids, markdown, text
from graphloom.functions.versions import ver_key
from graphloom.model import DEFAULT_TYPES, default_registry


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def plain(row):
    """Rows and lists of rows as tuples."""
    if isinstance(row, list):
        return [plain(r) for r in row]
    return tuple(plain(x) for x in row) if isinstance(row, tuple) else row


@pytest.mark.parametrize(
    "versions, latest",
    [
        (["20.15.2", "20.15.1"], "20.15.2"),
        (["20.9.10", "20.15.2"], "20.15.2"),
        (["20.15.2", "20.16.0", "20.15.10"], "20.16.0"),
        (["r1", "r2"], "r2"),
        (["20.2.0", "20.10.0"], "20.10.0"),
        (["1", "1.0.1"], "1.0.1"),
        (["9", "x"], "x"),
    ],
)
def test_latest_version(spark, versions, latest):
    df = spark.createDataFrame([(v,) for v in versions], "v string")
    assert df.agg(F.max_by("v", ver_key("v"))).first()[0] == latest


def test_version_key_like_padded_comparison(spark):
    def key(v):
        return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in v.split(".")]

    versions = [".".join(p) for n in (1, 2, 3) for p in product(["0", "1", "10", "a"], repeat=n)]
    df = spark.createDataFrame([(a, b) for a in versions for b in versions[::7]], "a string, b string")
    for a, b, less in df.select("a", "b", ver_key("a") < ver_key("b")).collect():
        x, y = key(a), key(b)
        width = max(len(x), len(y))
        x, y = (k + [(0, 0, "")] * (width - len(k)) for k in (x, y))
        assert less == (x < y), (a, b)


def test_split_ids(spark):
    assert plain(value(spark, ids.split_id(F.lit("UDG@MMLCommand@ADD URR")))) == ("UDG", "MMLCommand", "ADD URR")
    assert plain(value(spark, ids.split_id(F.lit("BusinessDomain@demo")))) == (None, "BusinessDomain", "demo")
    assert value(spark, ids.split_id(F.lit("one"))) is None
    assert value(spark, ids.split_id(F.lit("a@b@c@d"))) is None


@pytest.mark.parametrize(
    "id_, fields, path",
    [
        ("UDG@MMLCommand@ADD URR", {"version": "1"}, "Command/UDG/1/UDG@MMLCommand@ADD URR.md"),
        ("UDG@AtomTask@x", {}, "AtomTask/UDG/UDG@AtomTask@x.md"),
        ("BusinessDomain@d", {"domain": "d"}, "Business/d/BusinessDomain@d.md"),
        ("NetworkScenario@s", {"domain": "d", "scenario": "s"}, "Business/d/s/NetworkScenario@s.md"),
        ("UDG@MMLCommand@ADD URR", {}, None),
        ("NetworkScenario@s", {"domain": "d"}, None),
        ("X@Nope@y", {"version": "1"}, None),
        ("bad", {}, None),
    ],
)
def test_classify(spark, id_, fields, path):
    row = spark.createDataFrame([(id_, fields, id_.split("@")[-2] if "@" in id_ else "")], "id string, fields map<string,string>, type string")
    row = row.join(default_registry(spark), "type", "left")
    got = row.select(ids.classify(F.col("id"), F.col("scope"), F.col("layer"), F.col("path_fields"), F.col("fields")).alias("x")).first()["x"]
    assert got["path"] == path and (got["warning"] is None) == (path is not None)


def test_ui_layers(spark):
    got = [value(spark, ids.ui_layer_of(F.lit(x).cast("string"))) for x in ("Command", "License", "Own", None)]
    assert got == ["命令层", "特性层", "Own", ""] and len(DEFAULT_TYPES) == 11


DOC = "---\r\nid: A@B@C\r\nversion: 1.0\r\ntags: [a, b]\r\n---\r\n# T\r\r\n\r\n| a | b |\r\n\r\n| - | - |\r\n\r\nx\r\n\r\n## 边\r\n- 参见: [[X]], [[Y]] and [[X]]\r\n- no link\r\n- 全角：[[Z]]\r\n"


def test_parse_document(spark):
    df = markdown.parse_documents(spark.createDataFrame([(DOC,)], "raw_md string"))
    row = df.select("*", text.edge_links(F.col("edge_section")).alias("e")).first()
    assert row["fields"] == {"id": "A@B@C", "version": "1.0", "tags": "a,b"}
    # the line feed that stands for the text's beginning stays where an edge section is cut off
    assert row["body_md"] == "\n# T\n\n| a | b |\n| - | - |\n\nx"
    assert row["edge_section"].startswith("## 边\n")
    assert plain(row["e"]) == [("参见", "X"), ("参见", "Y")]


@pytest.mark.parametrize("doc, body, edges", [("plain", "plain", ""), ("a\n## 边", "a\n## 边", ""), ("", "", ""), ("---\n: : x\n[\n---\nb", "b", ""), ("## 边\n- a: [[b]]\n", "", "## 边\n- a: [[b]]\n")])
def test_parse_odd_documents(spark, doc, body, edges):
    row = markdown.parse_documents(spark.createDataFrame([(doc,)], "raw_md string")).first()
    assert (row["body_md"], row["edge_section"]) == (body, edges)


def test_table_gaps_only_inside_tables(spark):
    got = value(spark, text.without_table_gaps(F.lit("a\n\nb\n\n| x |\n\n\n| y |\n\n| z |\n\nc")))
    assert got == "a\n\nb\n\n| x |\n| y |\n| z |\n\nc"


def test_rewrite_front_matter(spark):
    got = value(spark, markdown.rewrite_front_matter(F.lit("---\na: 1\nb: 2\n---\nbody\n"), {"a": None, "c": "新"}))
    assert got == "---\nb: 2\nc: 新\n---\nbody\n"


def test_edge_section_round_trip(spark):
    edges = F.array(F.struct(F.lit("参见").alias("relation"), F.lit("A@B@C D").alias("to_id")))
    assert plain(value(spark, text.edge_links(text.edge_section(edges)))) == [("参见", "A@B@C D")]
    assert value(spark, text.edge_section(F.array().cast("array<struct<relation:string,to_id:string>>"))) == "## 边\n（暂无）"


def test_command_title(spark):
    assert plain(value(spark, text.command_title(F.lit("x\n# 增加URR（ADD URR）\n")))) == ("增加URR", "ADD URR")
    assert plain(value(spark, text.command_title(F.lit("# 概念（concept）")))) == ("", "")
    assert plain(value(spark, text.command_title(F.lit("# Only"), strict=False))) == ("", "Only")


def test_section_and_its_rules(spark):
    md = F.lit("# T\n#### [命令功能](#a)\n 适用NF：UDG、UNC\n该操作谨慎使用，立即生效\n#### 参数说明\n| 参数标识 | 参数名称 | 说明 |\n| --- | --- | --- |\n| A | b | c |\n| D |\n")
    assert value(spark, text.applicable_nf(text.section(md, "命令功能"))) == ["UDG", "UNC"]
    assert value(spark, text.effect_mode(md)) == "立即生效" and value(spark, text.is_dangerous(md))
    assert plain(value(spark, text.param_rows(md))) == [("A", "b", "c")]
    assert value(spark, text.section(md, "没有")) == ""


def test_codes_outside_code_and_contents(spark):
    md = F.lit("GWFD-000001\n```\nGWFD-000002\n```\n- [x](#GWFD-000003)\n[y](../GWFD-000004 z/a.md) GWFD-000009\n```\nGWFD-000005")
    assert value(spark, text.codes_in(md, text.FEATURE_CODE, F.lit("GWFD-000009"))) == ["GWFD-000001", "GWFD-000004"]


def test_paths_and_slugs(spark):
    assert value(spark, text.deepest_code(F.lit("GWFD-000001 a/GWFD-000002 b/x.md"))) == "GWFD-000002"
    assert value(spark, text.doc_type(F.lit("a/去激活特性_1.md"))) == "去激活"
    assert value(spark, text.doc_type(F.lit("原理/other/x.md"))) == "原理" and value(spark, text.doc_type(F.lit("a/x.md"))) == "其它"
    assert value(spark, text.slug(F.lit('a:b 特性_0123.md'))) == "ab 特性" and value(spark, text.slug(F.lit(".md"))) == "正文"
    assert value(spark, text.version_in(F.lit("UDG 20.15.2 doc"))) == "20.15.2"


def test_license_sections(spark):
    md = F.lit("intro\n#### [81203214 LKV100001 名一](#a)\n归属NF | UDG、UNC |\nGWFD-000001\n#### [82200CKP LKV2000022 two](#b)\nz")
    got = value(spark, text.license_sections(md))
    assert [r[:3] for r in plain(got)] == [("81203214", "LKV100001", "名一"), ("82200CKP", "LKV2000022", "two")]
    assert value(spark, text.license_nf(F.lit(got[0]["body"]))) == ["UDG", "UNC"]


def test_problems(spark):
    md = F.lit("x\n### 问题 1\n- 描述: 慢\n- 归因：a，b、c\n- 涉及对象: [[A@B@C]] [[D]]\n### 问题 2\nonly text\n### 问题3\n- 描述: no\n### 问题\n# h\n- 归因: x\nlast\n### 问题 4\ny")
    # a digit right after the word makes no heading; the rest of a heading is its first line
    assert plain(value(spark, text.problems(md))) == [("慢", ["a", "b", "c"], ["A@B@C", "D"]), ("no", [], []), ("last", ["x"], []), ("4", [], [])]


def test_names_and_members(spark):
    assert [value(spark, text.valid_bundle_name(F.lit(n))) for n in ("UDG_20.1", "-x", "a" * 33, "a b")] == [True, False, False, False]
    assert [value(spark, text.unsafe_member(F.lit(n))) for n in ("a/b", "/a", "a/../b", "C:x", "a..b")] == [False, True, True, True, False]
    assert value(spark, text.strip_zh_verb(F.lit("增加URR"))) == "URR"
    kinds = [value(spark, text.object_kind(F.array(*(F.lit(v) for v in vs)))) for vs in (["ADD"], ["SET"], ["LST", "DSP"], ["ACT"])]
    assert kinds == ["entity", "global_setting", "query_target", "entity"]


@pytest.mark.parametrize(
    "data, charset",
    [("中文".encode(), "utf-8"), ("中文".encode("utf-8-sig"), "utf-8-sig"), ("中文".encode("utf-16"), "utf-16"), ("中文".encode("gbk"), "gb18030"), (b'<meta charset="gbk">' + "中文".encode("gbk"), "gbk")],
)
def test_charsets(data, charset):
    got, name = encoding.decode_page(data)
    assert got.endswith("中文") and name == charset


def test_mojibake(spark):
    wrong = ("知识图谱平台支持多版本对象和边的查询以及文档挖掘功能" * 4).encode("utf-8").decode("gbk", "ignore")
    rows = spark.createDataFrame([(1, wrong), (2, "正常的中文文档内容，没有问题。" * 20), (3, "�" * 9), (4, None)], "id int, text string")
    kinds = {r["id"]: r["kind"] for r in encoding.mojibake(rows).collect()}
    assert kinds[2] is None and kinds[3] == "replacement-chars" and kinds[4] is None


def test_mojibake_after_a_clean_head(spark):
    """A text is judged whole: what is garbled after its first 8192 characters counts."""
    head = "plain words " * 700
    wrong = "知识图谱".encode("utf-8").decode("gbk")
    texts = [head + wrong * 4000, head + "ææåå x " * 10, head + "x" * 9000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: (r["kind"], r["segments"]) for r in encoding.mojibake(rows).collect()}
    assert got[1][0] == "latin-misread" and got[2] == (None, 0)
    assert got[0][1] == sum(len(re.sub("[^一-鿿]", "", texts[0][at : at + 4096])) >= 20 for at in range(0, len(texts[0]), 4096)) > 2


def test_html_to_markdown():
    page = """<html><head><title>t</title></head><body><nav>x</nav><h2>Head</h2><p>a <b>b</b> <a href="x.html">l</a><br>c</p>
    <ul><li>one</li><li>two<ol start="3"><li>in</li></ol></li></ul><pre class="language-sql">SELECT
  1</pre><table><tr><th rowspan="2">A</th><th>B|C</th></tr><tr><td>d</td></tr></table><script>no</script></body></html>"""
    got = html.to_markdown(page, {"x.html": "y.md"})
    assert got == "## Head\n\na **b** [l](y.md)\nc\n\n- one\n- two\n  3. in\n\n```sql\nSELECT\n  1\n```\n\n| A | B\\|C |\n| --- | --- |\n| A | d |"
    assert html.to_markdown(None) is None and html.to_markdown("") == ""


def test_html_blocks():
    page = """<div class="warning"><span class="warningtitle">Mind</span><p>one</p><ul><li>two</li></ul></div><table><caption>Cap <b>x</b></caption><tr><th>a<th>b</tr>
    <tr><td><ul><li>p</li><li>q</li></ul></td><td><table><tr><td>in</td></tr></table></td></tr></table><figure><img src="../i.png" alt="z"><figcaption>fig</figcaption></figure>
    <details><summary>More</summary><p>hidden</p></details><dl><dt>t</dt><dd>d</dd></dl><ol type="I" start="9"><li>nine</li><li>ten</li></ol>"""
    got = html.to_markdown(page, {"d/e.html": "d/e.md"}, "d/p.html").split("\n\n")
    assert got[0] == "> **Mind**\n> one\n>\n> - two" and got[1] == "*Cap **x***"
    assert got[2].startswith("| a | b |\n| --- | --- |\n| ") and got[3:] == ["![z](../i.png)", "*fig*", "**More**", "hidden", "- **t**\n  d", "IX. nine\nX. ten"]


def test_addresses():
    assert [html.url_kind(x) for x in ("", " ", "#a", "//h/x", "mailto:x", "HTTPS://x", "file:/a", "a/b.html", "a:b")] == ["empty", "empty", "anchor", "remote", "remote", "remote", "local", "local", "remote"]
    targets = {"a/b.html": "a/b.md", "c.html": "x/c.md"}
    assert html.rewritten("../c.html#s", "a/b.html", targets) == "../x/c.md#s" and html.rewritten("nope.html", "a/b.html", targets) == "nope.html"
    assert html.rewritten("b%2Ehtml?q=1", "a/x.html", targets) == "b.md"
    assert [html.list_label(n, k) for n, k in ((1, "a"), (26, "A"), (27, "a"), (4, "i"), (19, "I"), (3, ""))] == ["a.", "Z.", "27.", "iv.", "XIX.", "3."]


def test_meaningful_pages(spark):
    got = [value(spark, html.is_meaningful(F.lit(x))) for x in ("<h1>T</h1>", "<h1>T</h1><table></table>", "<p>twenty characters of text here</p>", "<p>Copyright of a very long company name</p>")]
    assert got == [False, True, True, False]


def test_html_trees():
    show = html.to_markdown
    assert show("<ul><li>a<p>b</p></li></ul>") == "- a\n  b"
    assert show("<ul><li><p>a</p><p>b</p><table><tr><td>x</table><pre>c\n d</pre></li><li>z</ul>after") == "- a\n  b\n  | x |\n  | --- |\n  ```\n  c\n   d\n  ```\n- z\n\nafter"
    assert show("<ul><li><ul><li>deep</li></ul></li><li><div><p>text</p><ul><li>q</ul></div></ul>") == "-\n  - deep\n- text\n  - q"
    assert show("<ul><li>a</li><ul><li>b</li></ul></ul>") == "- a\n  - b" and show("<ul>no items<p>x</ul>") == "no items\n\nx"
    assert show("<div class='fignone'><span class='figcap'>Fig <b>1</b></span><img src='a.png' alt='x'><p>legend</p></div>") == "Fig **1**\n\n![x](a.png)\n\nlegend"
    assert show("<blockquote>q<p>r</p></blockquote><hr><pre>a```b</pre>") == "> q\n>\n> r\n\n---\n\n````\na```b\n````"
    assert show("<div class='mml note'>plain</div>") == "plain" and show("<p class='tip'>x</p>") == "> **提示**\n> x"
    assert show("<table><tr><td colspan=1500>a</td></tr></table>").count("---") == 1500
    assert show("<table><tr><td rowspan='2000'>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == "| a | b |\n| --- | --- |\n| a | c |"
    assert show("<div>" * 5000 + "x" + "</div>" * 5000 + "<p>y</p>") == "x\n\ny"
    assert show("<td>a</td>") == "a" and show("<table></table>") == "" and show("</p></div>x") == "x" and show("<p>a<p>b<ul><li>c</ul>d") == "a\n\nb\n\n- c\n\nd"
    assert show("<table><tr><td><p>a</div></p></td><td>b</td></tr></table>") == "| a | b |\n| --- | --- |"


def test_charsets_wherever_they_are_stated():
    assert encoding.decode_page(b"caf\xe9 ok") == ("café ok", "windows-1252")
    late = b"<p>" + b" " * 5000 + b"<meta charset=big5>" + "設定".encode("big5")
    assert encoding.decode_page(late)[1] == "big5" and encoding.decode_page(late)[0].endswith("設定")
    assert encoding.decode_page(b"<?xml charset='gb2312'?>" + "镕".encode("gbk")) == ("<?xml charset='gb2312'?>镕", "gb2312")
    assert encoding.decode_page(b"\x81") == ("\x81", "iso-8859-1") and encoding.decode_page(b"") == ("", "utf-8") and encoding.decode_page(None) is None


def test_charsets_by_statistics(spark):
    """Trained on some texts, held against others: short pages (about ten letters) and long ones."""
    import random

    rng = random.Random(5)
    zh = "配置参数说明增加对象删除查询显示设置激活清除刷新加载用户会话策略规则网络接口地址端口服务质量计费"
    tw = "設定參數說明增加物件刪除查詢顯示設置啟動清除重新載入用戶會話策略規則網路介面位址埠服務品質計費"
    fr = ["élève", "où", "ça", "être", "déjà", "le", "la", "forêt", "garçon", "très", "été", "Noël", "sur", "naïve"]
    make = {"gb18030": lambda n: "".join(rng.choices(zh, k=n)), "big5": lambda n: "".join(rng.choices(tw, k=n)), "windows-1252": lambda n: " ".join(rng.choices(fr, k=n))}
    model = encoding.train_charsets(spark.createDataFrame([(f(200),) for f in make.values() for _ in range(20)] + [(None,), ("plain",)], "text string"))
    for size, least in ((8, 0.97), (200, 1.0)):
        pages = [(charset, t) for charset, f in make.items() for t in (f(size) for _ in range(200)) if not t.isascii()]
        right = sum(encoding.decode_page(t.encode(charset), model)[0] == t for charset, t in pages)
        assert right / len(pages) >= least
    assert model.detect(b"plain") is None


def test_charsets_of_odd_latin_words(spark):
    """Letters of the samples in pairs that none of them has lose neither to unknown lead bytes nor to a set of few samples."""
    import random

    rng = random.Random(0)
    ends = ["al", "ción", "ñor", "mente", "és", "für", "öhe", "ça", "té", "väl", "er", "un", "den", "oír", "la", "so"]
    latin = [" ".join("".join(rng.choices(ends, k=2)) for _ in range(20)) for _ in range(400)]
    latin = [t.upper().replace(" ", "!! ") if rng.random() < 0.1 else t for t in latin]
    zh, tw = "配置参数说明：增加对象 ", "設定參數說明：增加物件 "
    model = encoding.train_charsets(spark.createDataFrame([(t,) for t in latin + [zh + "ALPHA。", tw + "BETA。"] * 50], "text string"))
    for t in ("COÍBO!! MENTECO!! ASÍÍCO!! " * 5, "stpf. Äen enge", "ENÊLE!! ÉMENT!! UNE!!"):
        assert encoding.decode_page(t.encode("windows-1252"), model) == (t, "windows-1252")
    for t, charset in ((zh + "Äen", "gb18030"), (tw + "GAMMA。", "big5")):
        assert encoding.decode_page(t.encode(charset), model) == (t, charset)
