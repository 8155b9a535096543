"""The image registry against a walk over pages and links in order."""

import posixpath
import random
import re
from urllib.parse import unquote

from pyspark.sql import functions as F

from graphloom.operators import images


def brute(pages, files):
    names, hashes, out = {}, {}, {}
    for path, slug, md in sorted(pages):

        def put(m, path=path, slug=slug):
            url = m[2].split('"')[0].split("#")[0].strip()
            target = posixpath.normpath(posixpath.join(posixpath.dirname(path), unquote(url)))
            if not url or re.match("https?://|//|mailto:|tel:|data:", url) or target not in files:
                return m[0]
            h, base = files[target], posixpath.basename(target)
            if h not in hashes:
                name, i = base, 2
                if name in names:
                    name = f"{slug}_{base}"
                    while name in names:
                        name, i = f"{slug}_{i}_{base}", i + 1
                hashes[h] = name
                names[name] = h
            return f"![{m[1]}](assets/{hashes[h]})"

        out[path] = re.sub(r"!\[([^\]]*)\]\(([^)]*)\)", put, md)
    return out, hashes


def test_names_and_links_equal_a_walk_in_order(spark, tmp_path):
    rng = random.Random(4)
    files = {}
    for k in range(300):  # names that are other images' later names among them
        base = rng.choice(["x.png", "s_x.png", "s_2_x.png", "t_x.png", "s_s_x.png", "y z.png", "s_3_x.png"])
        files[f"i/{k}/{base}"] = f"h{rng.randrange(200)}"
    link = lambda: f"![{rng.choice(['', 'a b'])}]({rng.choice(['../', './../', '../d/../'])}{rng.choice(list(files)).replace(' ', '%20')}{rng.choice(['', ' "t"', '#f'])})"
    pages = [(f"p/{k:03}.md", rng.choice("st"), " text ".join([link() for _ in range(rng.randint(0, 5))] + rng.choice([[], ["![](http://x/y.png)"], ["![z](../../i/0.png)"], ["![]()"]]))) for k in range(120)]
    docs, assets = images.register_images(
        spark.createDataFrame(pages, "path string, slug string, md string").repartition(3), spark.createDataFrame(list(files.items()), "path string, hash string"), str(tmp_path)
    )
    expected, hashes = brute(pages, files)
    assert {r.path: r.md for r in docs.collect()} == expected
    assert {r.hash: r.asset for r in assets.collect()} == hashes
    assert len(set(hashes.values())) == len(hashes)


def test_many_images_of_one_name_need_few_rounds(spark, tmp_path):
    contents = spark.range(500).select(F.col("id").cast("string").alias("hash"), F.struct(F.lpad(F.col("id").cast("string"), 5, "0").alias("path"), F.lit(0).alias("at")).alias("place"), F.lit("x.png").alias("base"), F.lit("s").alias("slug"))
    got = {int(r.hash): r.asset for r in images.name_assets(contents, str(tmp_path)).collect()}
    assert got == {0: "x.png", 1: "s_x.png"} | {k: f"s_{k}_x.png" for k in range(2, 500)}
    assert len(list(tmp_path.iterdir())) == 2
