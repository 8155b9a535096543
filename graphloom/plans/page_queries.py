"""Queries that put known structures and bytes into pages and read them back."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..functions import encoding, html
from ..operators import images
from ..sources import archives, files
from . import fixtures as X
from .registry import query, scratch


@query("""SELECT src, concat_ws(chr(10), '# T' || src, '', '1. first ' || src, '  more', '  > **注意**', '  > mind', '  - in', '    - deep', '2. second', '  | a |', '  | --- |', '  | ' || src || ' |', '  ```', '  x', '   y', '  ```',
    '', 'Fig **' || src || '**', '', '![alt](i/' || src || '.png)', '', 'legend', '', '![](f.png)', '', '*cap*', '', '> said', '>', '> - q', '', '| a<br>b<br>- p<br>- q<br>N. body | c |', '| --- | --- |') AS md FROM p""")
def html_nested(spark, sf):
    """Blocks in list items, advisory blocks and tables in them, figures of both kinds, mixed cells."""
    src = F.col("src").cast("string")
    page = F.concat(
        F.lit("<h1>T"), src, F.lit("</h1><ol><li>first "), src,
        F.lit("<p>more</p><div class='caution'><div class='cautionbody'>mind</div></div><ul><li>in<ul><li>deep</ul></ul><li><p>second</p><table><tr><td>a<tr><td>"), src,
        F.lit("</table><pre>x\n y</pre></ol><div class='fignone'><span class='figcap'>Fig <b>"), src, F.lit("</b></span><br><img src='i/"), src,
        F.lit(".png' alt='alt'><p>legend</p></div><figure><img src='f.png'><figcaption>cap</figcaption></figure><blockquote>said<ul><li>q</ul></blockquote>"
              "<table><tr><td>a<p>b</p><ul><li>p<li>q</ul><div class='note'><span class='notetitle'>N.</span><div class='notebody'>body</div></div></td><td>c</td></tr></table>"),
    )
    return X.dealt(X.parts(spark, sf), "src").select("src", html.html_to_markdown(page).alias("md"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 1500 ELSE page_id % 4 END AS n_columns FROM pages")
def wide_spans(spark, sf):
    """Tables with one cell that spans many columns."""
    wide = F.when(F.col("page_id") % 4 == 0, 1500).otherwise(F.col("page_id") % 4)
    page = F.concat(F.lit("<table><tr><td colspan='"), wide, F.lit("'>x</td></tr></table>"))
    md = html.html_to_markdown(page)
    return X.dealt(X.read(spark, sf, "pages").select("page_id"), "page_id").select("page_id", md.alias("md")).select("page_id", F.regexp_count("md", F.lit("---")).alias("n_columns"))


_ZH, _TW = "配置参数说明：增加对象 ", "設定參數說明：增加物件 "


@query(f"""SELECT 'd' || doc_id AS id, CASE WHEN strlen(text) = length(text) THEN 'utf-8' ELSE 'windows-1252' END AS charset, md5(text) AS digest FROM documents WHERE text IS NOT NULL AND text <> ''
  UNION ALL SELECT 'c' || src, CASE WHEN src % 2 = 0 THEN 'gb18030' ELSE 'big5' END, md5(CASE WHEN src % 2 = 0 THEN '{_ZH}' ELSE '{_TW}' END || local || '。') FROM p""")
def charset_pages(spark, sf):
    """Pages that do not state their character set, told apart by the statistics of a fifth of them."""
    docs = X.read(spark, sf, "documents").where("text is not null and text <> ''").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text", F.lit("windows-1252").alias("own"))
    even = F.col("src") % 2 == 0
    parts = X.parts(spark, sf).select(F.concat(F.lit("c"), "src").alias("id"), F.concat(F.when(even, _ZH).otherwise(_TW), "local", F.lit("。")).alias("text"), F.when(even, "gb18030").otherwise("big5").alias("own"))
    texts = docs.unionByName(X.dealt(parts, "id"))
    model = encoding.train_charsets(texts.where(F.pmod(F.xxhash64("id"), F.lit(5)) == 0))
    root = scratch(spark, "pages")

    def written(batches):
        for pdf in batches:
            pdf["path"] = [f"{zlib.crc32(i.encode()) % 1024}/{i}.html" for i in pdf["id"]]  # no folder holds all
            pdf["content"] = [t.encode(own) for t, own in zip(pdf["text"], pdf["own"])]
            yield pdf[["path", "content"]]

    archives.write_files(texts.mapInPandas(written, "path string, content binary"), root)
    found = files.read_pages(spark, root, model)
    return found.select(F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("id"), "charset", F.md5("text").alias("digest"))


_SHOWN = """, shown AS (SELECT src, 'd' || src % 7 || '/p' || lpad(src::VARCHAR, 8, '0') || '.md' AS path, 's' || src % 3 AS slug, 'pic ' || src % 5 || '.png' AS base, src % 401 AS content FROM p),
firsts AS (SELECT content, min(path) AS path, arg_min(base, path) AS base, arg_min(slug, path) AS slug FROM shown WHERE src % 10 <> 0 GROUP BY content),
ranked AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path) AS n FROM firsts),
clashes AS (SELECT *, row_number() OVER (PARTITION BY base, slug ORDER BY path) AS m FROM ranked WHERE n > 1),
named AS (SELECT content, base AS asset FROM ranked WHERE n = 1 UNION ALL SELECT content, slug || '_' || CASE WHEN m > 1 THEN m || '_' ELSE '' END || base FROM clashes)
"""


def _shown(spark, sf):
    """Pages that show an image each, and the images: equal names with other contents, equal contents under several paths."""
    src = F.col("src")
    base = F.concat(F.lit("pic "), src % 5, F.lit(".png"))
    pages = X.parts(spark, sf).select(
        F.concat(F.lit("d"), src % 7, F.lit("/p"), F.lpad(src.cast("string"), 8, "0"), F.lit(".md")).alias("path"),
        F.concat(F.lit("s"), src % 3).alias("slug"),
        F.concat(F.lit("a ![x](../img/./"), src, F.lit("/no/../"), F.replace(base, F.lit(" "), F.lit("%20")), F.lit(' "title") b ![](http://e.org/x.png) c ![gone](no.png)')).alias("md"),
    )
    images = X.parts(spark, sf).where(src % 10 != 0).select(F.concat(F.lit("img/"), src, F.lit("/"), base).alias("path"), F.md5((src % 401).cast("string").cast("binary")).alias("hash"))
    return pages, images


@query(_SHOWN + """SELECT s.path, 'a ' || CASE WHEN src % 10 <> 0 THEN '![x](assets/' || asset || ')' ELSE '![x](../img/./' || src || '/no/../' || replace(base, ' ', '%20') || ' "title")' END || ' b ![](http://e.org/x.png) c ![gone](no.png)' AS md,
  CASE WHEN src % 10 <> 0 THEN 1 ELSE 0 END AS n_images FROM shown s LEFT JOIN named n ON n.content = s.content""")
def image_pages(spark, sf):
    return images.register_images(*_shown(spark, sf), scratch(spark, "images"))[0]


@query(_SHOWN + "SELECT md5(n.content::VARCHAR) AS hash, asset FROM named n")
def image_names(spark, sf):
    return images.register_images(*_shown(spark, sf), scratch(spark, "images"))[1].select("hash", "asset")
