"""The images that documents show: one asset for equal contents, names without clashes, links put back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

IMAGE_LINK = r"!\[([^\]]*)\]\(([^)]*)\)"


def resolved(folder: Column, url: Column) -> Column:
    """The path that a relative address means in a folder; steps above the top stay as ``..``."""
    decoded = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    steps = F.filter(F.split(F.concat(folder, F.lit("/"), decoded), "/", -1), lambda x: ~x.isin("", "."))
    empty = F.array().cast("array<string>")
    up = lambda a, x: (x == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("..")) != "..")
    return F.array_join(F.aggregate(steps, empty, lambda a, x: F.when(up(a, x), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(x)))), "/")


def image_links(pages: DataFrame) -> DataFrame:
    """(path, slug, at, link, label, target) of the images that pages (path, slug, md) show; target is null for remote ones."""
    found = pages.select(
        "path",
        "slug",
        F.posexplode(F.arrays_zip(*(F.regexp_extract_all("md", F.lit(IMAGE_LINK), n).alias(name) for n, name in enumerate(("link", "label", "inner"))))).alias("at", "l"),
    )
    url = X.link_target(F.col("l.inner"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    target = F.when(~url.rlike(r"^(https?://|//|mailto:|tel:|data:|#)|^$"), resolved(folder, url))
    return found.select("path", "slug", "at", F.col("l.link").alias("link"), F.col("l.label").alias("label"), target.alias("target"))


def asset_name(base: Column, slug: Column, turn: Column) -> Column:
    """What an image may be called: its own name, then with the page's slug, then with a number from 2 on."""
    numbered = F.when(turn > 1, F.concat(slug, F.lit("_"), turn, F.lit("_"), base)).otherwise(F.concat(slug, F.lit("_"), base))
    return F.when(turn == 0, base).otherwise(numbered)


def name_assets(contents: DataFrame, folder: str) -> DataFrame:
    """Adds ``asset`` to (hash, place, base, slug): in the order of place, every content takes the first of its names that is free.

    Round by round all contents claim a name, and of each name the earliest claim holds. A content that loses goes on to the
    next of its names; of several that lose in one series (base and slug) the n-th skips n, as those before take one each. A
    claim may still lose in a later round, to an earlier content that has moved there. Every round is a table in ``folder``.
    """
    spark = contents.sparkSession
    current = contents.withColumn("turn", F.lit(0))
    number = 0
    while True:
        claims = current.withColumn("asset", asset_name(F.col("base"), F.col("slug"), F.col("turn")))
        holders = claims.groupBy("asset").agg(F.min(F.struct("place", "hash")).alias("holder"))
        held = claims.join(holders, "asset").withColumn("holds", F.col("holder.hash") == F.col("hash")).drop("holder")
        held.write.parquet(f"{folder}/round-{number}")
        held = spark.read.schema(held.schema).parquet(f"{folder}/round-{number}")
        losing = held.where(~F.col("holds"))
        if losing.isEmpty():
            return held.select(*contents.columns, "asset")
        later = F.row_number().over(Window.partitionBy("base", "slug", "turn").orderBy("place", "hash"))
        moved = losing.withColumn("turn", F.col("turn") + later)
        current = held.where("holds").select(*contents.columns, "turn").unionByName(moved.select(*contents.columns, "turn"))
        number += 1


def register_images(pages: DataFrame, images: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents (path, md, n_images), assets (hash, asset, source)) of pages (path, slug, md) and images (path, hash).

    Pages are taken in the order of their paths, links in that of the text. Links to images that are there lead to
    ``assets/<name>``; remote ones, and such to images that are not there, stay. Pages that show nothing stay as they are.
    """
    links = image_links(pages)
    known = links.where("target is not null").join(images.groupBy(F.col("path").alias("target")).agg(F.min("hash").alias("hash")), "target")
    known.select("path", "slug", "at", "label", "target", "hash").write.parquet(f"{folder}/known")
    known = pages.sparkSession.read.parquet(f"{folder}/known")
    base = F.regexp_extract("target", r"([^/]*)$", 1)
    first = known.groupBy("hash").agg(F.min(F.struct("path", "at", base.alias("base"), "slug", "target")).alias("f"))
    first = first.select("hash", F.struct("f.path", "f.at").alias("place"), "f.base", "f.slug", F.col("f.target").alias("source"))
    assets = name_assets(first, folder)
    named = known.join(assets.select("hash", "asset"), "hash")
    new = F.struct("at", F.concat(F.lit("!["), "label", F.lit("](assets/"), "asset", F.lit(")")).alias("link"))
    put = named.groupBy("path").agg(F.map_from_entries(F.collect_list(new)).alias("_new"))  # the links of one page
    whole = pages.join(put, "path", "left")
    between, old = F.split("md", IMAGE_LINK, -1), F.regexp_extract_all("md", F.lit(IMAGE_LINK), 0)
    whole = whole.withColumns({"_between": between, "_old": old})
    pieces = F.transform("_between", lambda b, i: F.concat(b, F.coalesce(F.try_element_at(F.col("_new"), i), F.try_element_at(F.col("_old"), i + 1), F.lit(""))))
    text = F.when(F.col("_new").isNull(), F.col("md")).otherwise(F.array_join(pieces, ""))
    return whole.select("path", text.alias("md"), F.coalesce(F.size("_new"), F.lit(0)).alias("n_images")), assets.select("hash", "asset", "source")
