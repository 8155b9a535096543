"""Files of any file system that Spark knows, by path: small writes, moves and removals on the driver.

These are for single files and folders (a bundle's description, a moved folder); tables go through DataFrames.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _open(spark, path)
    return fs.exists(place)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a file beside its place under a hidden name, then moves it there in one step: readers see the old one or the new one, also after a crash."""
    fs, place = _open(spark, path)
    place = fs.makeQualified(place)
    fs.mkdirs(place.getParent())
    front, slash, name = path.rpartition("/")
    _, part = _open(spark, f"{front}{slash}.{name}.{uuid.uuid4().hex[:8]}.part")  # Spark lists no hidden files
    part = fs.makeQualified(part)
    out = fs.create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, place, how)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def make_folder(spark: SparkSession, path: str) -> None:
    fs, place = _open(spark, path)
    fs.mkdirs(place)


def make_temporary(spark: SparkSession, path: str) -> None:
    """Makes a folder that goes when the driver ends."""
    fs, place = _open(spark, path)
    fs.mkdirs(place)
    fs.deleteOnExit(place)


def delete(spark: SparkSession, path: str, top: str | None = None) -> bool:
    """Deletes a file or folder, then the folders above it that are left empty, up to ``top``."""
    fs, place = _open(spark, path)
    gone = fs.delete(place, True)
    if top is not None:
        above, (_, end) = place.getParent(), _open(spark, top)
        while above is not None and above.toUri().getPath().startswith(end.toUri().getPath() + "/") and fs.exists(above) and not len(fs.listStatus(above)):
            fs.delete(above, False)
            above = above.getParent()
    return gone


def move(spark: SparkSession, old: str, new: str) -> None:
    """Moves a file or folder; a place that is taken is an error."""
    fs, target = _open(spark, new)
    if not exists(spark, old):
        raise FileNotFoundError(old)
    if fs.exists(target):
        raise FileExistsError(new)
    fs.mkdirs(target.getParent())
    if not fs.rename(_open(spark, old)[1], target):
        raise OSError(f"{old} could not be moved to {new}")


def replace_folder(spark: SparkSession, new: str, target: str, trash: str) -> None:
    """Puts the folder ``new`` at ``target``; what was there goes to ``trash``, and comes back if the move fails."""
    had = exists(spark, target)
    if had:
        move(spark, target, trash)
    try:
        move(spark, new, target)
    except Exception:
        if had:
            move(spark, trash, target)
        raise


def entries(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds."""
    fs, place = _open(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []
