"""Archives by ranges, files written by tasks, and listings that open nothing."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.sources import archives, bundles, files, runs


def members_of(rows):
    return sorted((r["name"], bytes(r["content"])) for r in rows.collect())


def test_ranges_equal_the_whole_reader(spark, tmp_path):
    data = {f"d{i % 3}/{i}.md": os.urandom(i * 37 % 5000) for i in range(200)} | {"empty.txt": b"", "日本.txt": "語".encode()}
    for name, how in (("stored", zipfile.ZIP_STORED), ("deflated", zipfile.ZIP_DEFLATED), ("bzip", zipfile.ZIP_BZIP2)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", how) as z:
            z.writestr("folder/", "")
            for k, v in data.items():
                z.writestr(k, v)
            z.writestr("d0/0.md", b"again")
        path = str(tmp_path / f"{name}.zip")
        rows = archives.read_archives(spark, path, range_bytes=20_000)
        assert rows.rdd.getNumPartitions() > (5 if how == zipfile.ZIP_STORED else 1)
        old = bundles.members(spark.read.format("binaryFile").load(path).select("path", "content"))
        assert sorted((r.idx, r.name, bytes(r.content)) for r in rows.collect()) == sorted((r.idx, r.name, bytes(r.content)) for r in old.collect())
    assert archives.read_archives(spark, str(tmp_path)).count() == 3 * (len(data) + 1)
    assert archives.read_archives(spark, f"file://{tmp_path}/[sb]*.zip").select("archive").distinct().count() == 2
    some = bundles.read_members(spark, str(tmp_path / "stored.zip"), (".TXT",))
    assert {r.name for r in some.collect()} == {"empty.txt", "日本.txt"}
    (tmp_path / "none").mkdir()
    assert archives.read_archives(spark, str(tmp_path / "none")).collect() == []


def test_an_archive_beyond_two_gigabytes(spark, tmp_path):
    path = str(tmp_path / "big.zip")
    with open(path, "wb") as f:
        f.truncate(2_700_000_000)  # a hole before the members: their places need more than 31 bits
    with zipfile.ZipFile(path, "a") as z:
        for i in range(100):
            z.writestr(f"{i}.bin", bytes([i]) * 1000)
    rows = archives.read_archives(spark, path, range_bytes=10_000)
    assert rows.rdd.getNumPartitions() == 10 and members_of(rows) == sorted((f"{i}.bin", bytes([i]) * 1000) for i in range(100))


def test_what_is_wrong_with_an_archive(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("gut.txt", b"0123456789" * 10)
        z.writestr(zipfile.ZipInfo("中文.txt"), b"x")
        z.writestr("../out.txt", b"x")
    whole = path.read_bytes()
    path.write_bytes(whole.replace(b"0123456789" * 10, b"0123456780" * 10))
    with pytest.raises(Exception, match="checksum"):
        archives.read_archives(spark, str(path)).collect()
    listed = archives.read_archives(spark, str(path), contents=False)  # nothing is inflated, so nothing fails
    assert {(r.name, r.size, r.content) for r in listed.collect()} == {("gut.txt", 100, None), ("中文.txt", 1, None), ("../out.txt", 1, None)}
    with pytest.raises(Exception, match="unsafe archive member"):
        bundles.safe(listed).collect()
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xx.md", b"x")
    (tmp_path / "gbk.zip").write_bytes(data.getvalue().replace(b"xx.md", "中.md".encode("gbk")))  # not marked as UTF-8
    assert [r.name for r in archives.read_archives(spark, str(tmp_path / "gbk.zip")).collect()] == ["中.md"]
    (tmp_path / "no.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="zip"):
        archives.read_archives(spark, str(tmp_path / "no.zip")).collect()


def test_archives_are_written_by_tasks(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 4).select(F.concat(F.lit("a/"), "id", F.lit(".md")).alias("name"), F.concat(F.lit("é"), "id").cast("binary").alias("content"))
    for _ in range(2):  # the second write replaces the first
        archives.write_archives(rows, str(tmp_path / "out"), 100)
    found = archives.read_archives(spark, str(tmp_path / "out"))
    assert members_of(found) == sorted((f"a/{i}.md", f"é{i}".encode()) for i in range(1000))
    assert len(list((tmp_path / "out").iterdir())) == 12  # 250 rows a task
    broken = rows.select("name", F.when(F.expr("substr(name, 3, 3) = '999'"), F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.col("content")).alias("content"))
    with pytest.raises(Exception, match="stop"):
        archives.write_archives(broken, str(tmp_path / "out"), 100)
    assert archives.read_archives(spark, str(tmp_path / "out")).count() == 1000 and len(list((tmp_path / "out").glob("part-*.zip"))) == 12
    archives.write_archives(rows.where("false"), str(tmp_path / "out"))
    assert archives.read_archives(spark, str(tmp_path / "out")).count() == 0


def test_files_are_written_by_tasks(spark, tmp_path):
    rows = spark.range(50).select(F.concat((F.col("id") % 5).cast("string"), F.lit("/x y é"), "id", F.lit(".TXT")).alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    archives.write_files(rows, str(tmp_path))
    archives.write_files(rows, str(tmp_path))
    assert {r.path: r.text for r in files.read_preview(spark, str(tmp_path)).collect()} == {f"{i % 5}/x y é{i}.TXT": str(i) for i in range(50)}
    with pytest.raises(Exception, match="not below"):
        archives.write_files(spark.createDataFrame([("../x", bytearray(b""))], "path string, content binary"), str(tmp_path / "in"))


def test_files_that_are_not_chosen_stay_closed(spark, tmp_path):
    for name in ("a.PNG", "b.txt", "c.bin", "d.md"):
        (tmp_path / name).write_bytes(b"x" * 10)
    assert {os.path.basename(f) for f in spark.read.format("binaryFile").option("pathGlobFilter", files.named(files.IMAGE_SUFFIXES)).load(str(tmp_path)).inputFiles()} == {"a.PNG"}
    assert [r.path for r in files.read_images(spark, str(tmp_path)).collect()] == ["a.PNG"]
    listed = files.listing(spark, str(tmp_path))
    assert {(r.path, r.size) for r in listed.collect()} == {(n, 10) for n in ("a.PNG", "b.txt", "c.bin", "d.md")}
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_runs_go_in_and_out(spark, tmp_path):
    def packed(name, members):
        with zipfile.ZipFile(tmp_path / f"in/{name}", "w") as z:
            for k, v in members.items():
                z.writestr(k, v)

    (tmp_path / "in").mkdir()
    packed("a.zip", {"log.txt": "1", "sub\\x.txt": "2", "../no.txt": "3", "/no.txt": "4", "reviews/R1.md": "r"})
    packed("b.zip", {"Run@b.md": "---\nid: Run@b\nstatus: open\nmine: x\n---\nbody\n", "out.bin": b"\xff"})
    packed("c.zip", {"x": "x"})
    uploads = [("a.zip", "TestCase@1", "Run@a", "A run", None), ("b.zip", "TestCase@1", "Run@b", None, "ann"), ("c.zip", "TestCase@9", "Run@c", None, None)]
    root = str(tmp_path / "root")
    (tmp_path / "root").mkdir()
    refused = runs.upload_runs(spark, str(tmp_path / "in"), spark.createDataFrame(uploads, "archive string, case string, id string, name string, runner string"), spark.createDataFrame([("TestCase@1",)], "id string"), root, "2026-01-01")
    assert [r.id for r in refused.collect()] == ["Run@c"]
    top = tmp_path / "root/runs/TestCase@1"
    assert {str(p.relative_to(top)) for p in top.rglob("*") if p.is_file() and not p.name.startswith(".")} == {"Run@a/log.txt", "Run@a/sub/x.txt", "Run@a/reviews/R1.md", "Run@a/Run@a.md", "Run@b/Run@b.md", "Run@b/out.bin"}
    assert (top / "Run@a/Run@a.md").read_text() == "---\nid: Run@a\ntype: Run\ncase: TestCase@1\nrun_at: '2026-01-01'\nrunner: upload\nstatus: completed\nname: A run\n---\n# A run\n"
    change = "case string, id string, name string, runner string, run_at string, status string, notes string"
    runs.update_runs(spark, root, spark.createDataFrame([("TestCase@1", "Run@b", None, None, None, "done", "n: 1"), ("TestCase@1", "Run@new", None, "bob", None, None, None)], change))
    assert (top / "Run@b/Run@b.md").read_text() == "---\nid: Run@b\nstatus: done\nmine: x\ntype: Run\ncase: TestCase@1\nnotes: 'n: 1'\n---\nbody\n"
    assert (top / "Run@new/Run@new.md").read_text() == "---\nid: Run@new\ntype: Run\ncase: TestCase@1\nrunner: bob\n---\n# Run@new\n"
    runs.download_runs(spark, root, str(tmp_path / "out"), spark.createDataFrame([("Run@a",), ("Run@b",)], "id string"))
    assert sorted(p.name for p in (tmp_path / "out").glob("*")) == ["Run@a.zip", "Run@b.zip"]
    assert sorted(zipfile.ZipFile(tmp_path / "out/Run@a.zip").namelist()) == ["Run@a.md", "log.txt", "reviews/R1.md", "sub/x.txt"]
    assert zipfile.ZipFile(tmp_path / "out/Run@b.zip").read("out.bin") == b"\xff"


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FOLDERS", 8)  # so that some folders are taken with all that is below
    names = [f"a{i % 13}/b {i % 7}/é+%20{i}.{'MD' if i % 2 else 'md'}" for i in range(300)] + ["top.md", "x/y/z/deep.md"]
    for name in [*names, ".no/a.md", "a0/_no/a.md", "a0/.no.md", "a0/_no.md"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "a1/empty.md").write_text("")
    listed = files.listing(spark, str(tmp_path))
    assert "MapInPandas" in (plan := listed._jdf.queryExecution().executedPlan().toString()) and "FileScan" not in plan  # no index of the files on the driver
    assert {(r.path, r.size, r.mtime) for r in listed.collect()} == {(n, len(n.encode()), (tmp_path / n).stat().st_mtime_ns // 1_000_000 / 1000) for n in names}
    assert {r.path for r in files.listing(spark, f"file://{tmp_path}/", "*.md").collect()} == {n for n in names if n.endswith(".md")}
    assert {r.path for r in files.listing(spark, str(tmp_path), files.named(("md",))).collect()} == set(names)
    assert {(r.path, r.text) for r in files.read_preview(spark, str(tmp_path)).collect()} == {(n, n) for n in names}
    monkeypatch.setattr(files, "BATCH_BYTES", 50)
    assert {(r.path, bytes(r.content)) for r in files.read_binary(spark, str(tmp_path), ("md",)).collect()} == {(n, n.encode()) for n in names}


def test_files_are_deleted_and_folders_replaced_by_tasks(spark, tmp_path):
    def rows(names):
        return spark.createDataFrame([(n,) for n in names], "path string")

    def put(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)

    for i in range(20):
        put(f"f/{i % 3}/{i}", "x")
    archives.delete_files(rows([*(f"{i % 3}/{i}" for i in range(0, 20, 2)), "gone"]), str(tmp_path / "f"))
    assert {p.name for p in (tmp_path / "f").rglob("*") if p.is_file()} == {str(i) for i in range(1, 20, 2)}
    with pytest.raises(Exception, match="not below"):
        archives.delete_files(rows(["../f/1/1"]), str(tmp_path / "f/0"))
    for i in range(10):
        put(f"new/b{i}/y", "y")
        if i % 2:
            put(f"root/b{i}/x", "x")
    for _ in range(2):  # what is moved already stays
        archives.replace_folders(rows([f"b{i}" for i in range(10)]), str(tmp_path / "new"), str(tmp_path / "root"), str(tmp_path / "trash"))
        assert {str(p.relative_to(tmp_path)) for p in tmp_path.glob("[rt]*/*/*")} == {f"root/b{i}/y" for i in range(10)} | {f"trash/b{i}/x" for i in range(1, 10, 2)}
    with pytest.raises(Exception, match="none"):
        archives.replace_folders(rows(["none"]), str(tmp_path / "new"), str(tmp_path / "root"), str(tmp_path / "trash"))


def test_small_archives_share_tasks(spark, tmp_path):
    for i in range(200):
        with zipfile.ZipFile(tmp_path / f"{i:03d}.zip", "w") as z:
            z.writestr(f"{i}.txt", str(i))
            z.writestr(f"{i}.md", b"")
    rows = archives.read_archives(spark, str(tmp_path))
    assert spark.sparkContext.defaultParallelism <= rows.rdd.getNumPartitions() <= 40  # not one for each archive
    assert members_of(rows) == sorted([(f"{i}.txt", str(i).encode()) for i in range(200)] + [(f"{i}.md", b"") for i in range(200)])
    some = archives.read_archives(spark, str(tmp_path), (".TXT",), contents=False)
    assert sorted((r.archive, r.idx, r.name, r.size, r.content) for r in some.collect()) == [(f"{tmp_path}/{i:03d}.zip", 0, f"{i}.txt", len(str(i)), None) for i in range(200)]
    found = [(f"{i}", 1 << 20) for i in range(100)]
    assert [len(x.paths) for x in archives.together(found, 10 << 20, 1)] == [9] * 11 + [1]
    assert len(list(archives.together(found, 64 << 20, 50))) == 50


def test_folders_are_deleted_by_tasks(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"f/d{i}/in").mkdir(parents=True)
        (tmp_path / f"f/d{i}/in/x").write_text("x")
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    archives.delete_folders(rows("d0", "d1/in", "d2", "gone"), str(tmp_path / "f"))
    assert {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if not p.is_file()} == {"f", "f/d1"} | {f"f/d{i}{x}" for i in (3, 4, 5) for x in ("", "/in")}
    for path in ("../f", "."):
        with pytest.raises(Exception, match="not below"):
            archives.delete_folders(rows(path), str(tmp_path / "f"))
