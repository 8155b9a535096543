import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.model import TELEMETRY, default_registry
from graphloom.sources import bundles, files, storage, tables
from graphloom.streaming import reindex, telemetry

CMD = "---\nid: UDG@MMLCommand@ADD URR\ntype: MMLCommand\nname: ADD URR\nnf: UDG\nversion: 20.1.0\n---\n# 增加URR（ADD URR）\n\n## 边\n- 操作配置对象: [[UDG@ConfigObject@URR]]\n"
DOM = "---\nid: BusinessDomain@demo\ntype: BusinessDomain\ndomain: demo\n---\nbody\n"


def zipped(entries):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in entries:
            z.writestr(name, content)
    return data.getvalue()


def test_bundle_import_and_export(spark, tmp_path):
    own = "{layer: X, scope: cross, id_segments: 2, path_fields: [domain]}\n"
    data = zipped([("a/cmd.md", CMD), ("dom.md", DOM), ("types/Extra.yaml", own), ("no-type.md", "---\nname: x\n---\n"), ("bad.md", b"\xff\xfe\xff"), ("pic.png", b"1"), ("unknown.md", "---\nid: Nope@x\n---\n")])
    rows = bundles.members(spark.createDataFrame([("b.zip", bytearray(data))], "path string, content binary"))
    assert rows.count() == 7
    assert [r["type"] for r in bundles.extension_types(rows).collect()] == ["Extra"]
    admitted = bundles.admit(bundles.markdown_members(rows), default_registry(spark)).cache()
    assert {r["path"] for r in admitted.collect() if r["path"]} == {"Command/UDG/20.1.0/UDG@MMLCommand@ADD URR.md", "Business/demo/BusinessDomain@demo.md"}
    assert admitted.where("warning is not null").count() == 2
    objects = bundles.to_objects(admitted)
    assert {(r["id"], r["version"]) for r in objects.collect()} == {("UDG@MMLCommand@ADD URR", "20.1.0"), ("BusinessDomain@demo", None)}
    assert bundles.to_edges(admitted).first()["to_id"] == "UDG@ConfigObject@URR"
    out = bundles.export_zip(objects).collect()
    names = [n for r in out for n in zipfile.ZipFile(io.BytesIO(bytes(r["content"]))).namelist()]
    assert sorted(names) == ["a/cmd.md", "dom.md"]


def test_unsafe_members_stop_the_job(spark):
    rows = bundles.members(spark.createDataFrame([("b.zip", bytearray(zipped([("../x.md", "x")])))], "path string, content binary"))
    with pytest.raises(Exception, match="unsafe archive member"):
        rows.collect()


def test_navigation_tree(spark):
    xml = '<r><t id="1" txt="A"><t id="2" txt="B" url="b.html"/><t id="3" txt="C"/></t><t txt="D"/></r>'
    got = {r["title"]: r for r in bundles.topics(spark.createDataFrame([(xml,)], "xml string")).collect()}
    assert got["B"]["topic_path"] == ["A", "B"] and got["A"]["child_count"] == 2 and got["D"]["parent_id"] is None
    assert [t for t, _ in sorted(((t, r["place"]) for t, r in got.items()), key=lambda x: x[1])] == ["A", "B", "C", "D"]


def test_markdown_tree(spark, tmp_path):
    folder = tmp_path / "a b@c"
    folder.mkdir()
    (folder / "x y.md").write_text("one\ntwo", encoding="utf-8")
    (tmp_path / ".hidden.md").write_text("h")
    (tmp_path / "p.png").write_bytes(b"1")
    rows = files.read_markdown(spark, str(tmp_path)).collect()
    assert [(r["source_path"], r["raw_md"]) for r in rows] == [("a b@c/x y.md", "one\ntwo")]
    assert [r["path"] for r in files.read_binary(spark, str(tmp_path)).collect()] == ["p.png"]
    assert files.read_one(spark, str(tmp_path), "a b@c/x y.md").first()["raw_md"] == "one\ntwo"
    assert files.file_times(spark, str(tmp_path)).count() >= 1 and files.read_preview(spark, str(tmp_path)).count() >= 1


def test_pages_with_charsets(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("中文".encode("gbk"))
    assert files.read_pages(spark, str(tmp_path)).first()["text"] == "中文"


def test_logs_and_users(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts":"2026","id":"A","type":"T","user":"u"}\n\nnot json\n{"ts":"2027","level":"request"}\n')
    rows = tables.with_sequence(tables.read_telemetry_log(spark, str(tmp_path / "log.jsonl"), "object"), str(tmp_path / "sorted"), 5).orderBy("ts").collect()
    assert [(r["seq"], r["level"], r["obj_id"]) for r in rows] == [(6, "object", "A"), (7, "request", None)]
    (tmp_path / "users.json").write_text(json.dumps({"users": [{"username": "a", "is_admin": True}, {"username": "b", "can_assets": False}]}))
    assert {r["username"]: (r["can_assets"], r["can_test"]) for r in tables.read_users(spark, str(tmp_path / "users.json")).collect()} == {"a": (True, False), "b": (False, False)}


def test_bundle_list_and_manifests(spark, tmp_path):
    for name, meta in (("one", {"nf": "UDG", "version": "1", "status": "failed"}), ("two", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.md").write_text("x")
        if meta:
            (tmp_path / name / "bundle.json").write_text(json.dumps(meta))
    assert {r["name"]: r["status"] for r in tables.read_bundles(spark, str(tmp_path)).collect()} == {"one": "failed", "two": "done"}
    assert tables.read_manifests(spark, str(tmp_path)).first()["manifest"]["nf"] == "UDG"


def test_review_tree(spark, tmp_path):
    case, run = tmp_path / "cases/d/s/TestCase@one", tmp_path / "runs/TestCase@one/Run@1"
    (case / "inputs").mkdir(parents=True)
    (run / "reviews").mkdir(parents=True)
    (tmp_path / "cases/TestCase@bare").mkdir()
    (tmp_path / "cases/TestCase@bare/x.txt").write_text("x")
    (tmp_path / "runs/TestCase@one/notes/Run@deep").mkdir(parents=True)
    (tmp_path / "runs/TestCase@one/notes/Run@deep/y.txt").write_text("not a run: too deep")
    (case / "TestCase@one.md").write_text("---\nstatus: open\n---\n# Title\n", encoding="utf-8")
    (case / "inputs/a.txt").write_text("a")
    (run / "Run@1.md").write_text("---\nrunner: me\nrun_at: '2026'\n---\n")
    (run / "log.txt").write_text("log")
    (run / "reviews/R001.md").write_text("---\nverdict: 通过\n---\n### 问题 1\n- 描述: 慢\n", encoding="utf-8")
    found = tables.read_review_tree(spark, str(tmp_path))
    assert sorted((r["id"], r["domain"], r["scenario"], r["name"], r["files"]) for r in found["cases"].collect()) == [("TestCase@bare", "未分类", "", "TestCase@bare", ["x.txt"]), ("TestCase@one", "d", "s", "Title", ["inputs/a.txt"])]
    assert [tuple(r)[:5] for r in found["runs"].collect()] == [("Run@1", "TestCase@one", "Run 2026", "me", "2026")]
    assert found["reviews"].first()["problems"][0]["description"] == "慢" and [tuple(r) for r in found["artifacts"].collect()] == [("Run@1", "log.txt", 3)]


def test_review_folders_take_the_disk_in_slices(spark, tmp_path, monkeypatch):
    """Logs are as long as keys: what lies on the disk at once is bounded, all of it is read, and nothing is left."""
    from graphloom.plans import source_queries

    data, seen = str(tmp_path), []
    keys = [4000 * i + i % 2 for i in range(24)]
    for table in ("region", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").write.parquet(f"{data}/{table}.parquet")
    spark.createDataFrame([(k, "S", k % 25) for k in keys], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{data}/supplier.parquet")
    read = tables.read_review_tree

    def watched(session, root):
        place = root.removeprefix("file://")
        seen.append((place, sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(place) for f in names)))
        return read(session, root)

    monkeypatch.setattr(tables, "read_review_tree", watched)
    monkeypatch.setattr(source_queries, "SLICE_BYTES", 1 << 20, raising=False)
    got = {r["id"]: (r["case_id"], r["size"], r["problem"]) for r in source_queries.run_folders(spark, data).collect()}
    assert got == {f"Run@{k}": (f"TestCase@{k}", 3 * k + 3, f"slow {k}" if k % 4 == 0 else None) for k in keys if k % 2 == 0}
    assert max(n for _, n in seen) < 1_400_000 < 1_500_000 < sum(n for _, n in seen)
    assert not any(os.path.exists(place) for place, _ in seen)


def test_stream_reindex_and_deletion(spark, tmp_path):
    docs, root = tmp_path / "docs", str(tmp_path / "store")
    docs.mkdir()
    store, registry = tables.Store(spark, root), default_registry(spark)
    (docs / "cmd.md").write_text(CMD, encoding="utf-8")
    (docs / "dom.md").write_text(DOM, encoding="utf-8")
    reindex.reindex(spark, str(docs), store, registry, str(tmp_path / "cp")).awaitTermination(120)
    assert store.objects().count() == 2 and store.edges().count() == 1
    (docs / "cmd2.md").write_text(CMD.replace("ConfigObject@URR", "ConfigObject@FAR"), encoding="utf-8")
    reindex.reindex(spark, str(docs), store, registry, str(tmp_path / "cp")).awaitTermination(120)
    assert store.objects().count() == 2 and store.edges().first()["to_id"] == "UDG@ConfigObject@FAR"
    os.remove(docs / "dom.md")
    reindex.remove_deleted(spark, str(docs), store)
    assert [r["id"] for r in store.objects().collect()] == ["UDG@MMLCommand@ADD URR"]


def test_streamed_counts_equal_batch(spark, tmp_path):
    rows = [(i, f"2026-01-01T{i % 5:02d}:{i % 60:02d}:00", "object", "skill", "/md", "F", "T", f"u{i % 3}", "") for i in range(200)]
    rows.append((999, "2026-01-02T00:00:00", "object", "skill", "/md", "F", "T", "u", ""))
    log = spark.createDataFrame(rows, TELEMETRY)
    log.write.parquet(str(tmp_path / "log"))
    stream = telemetry.read_log(spark, str(tmp_path / "log"), TELEMETRY)
    q = telemetry.hourly_counts(stream).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    streamed = {r["hour"]: r["n"] for r in spark.table("hours").collect()}
    batch = {r["hour"]: r["n"] for r in telemetry.hourly_counts(log).collect()}
    assert streamed == {h: n for h, n in batch.items() if h.day == 1} and sum(streamed.values()) == 200
    telemetry.append_feed(stream, str(tmp_path / "feed"), str(tmp_path / "cp")).awaitTermination(120)
    telemetry.append_feed(stream, str(tmp_path / "feed"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "feed")).count() == 201
    assert telemetry.without_repeats(stream).isStreaming and telemetry.sessions(log).count() >= 3


def test_store_writes_only_the_slices_that_change(spark, tmp_path):
    """A merge of one file leaves the other layers where they are; old folders go when no version needs them."""
    store, registry = tables.Store(spark, str(tmp_path / "store"), 4), default_registry(spark)
    rows = spark.createDataFrame([("cmd.md", CMD), ("dom.md", DOM)], "source_path string, raw_md string")
    admitted = bundles.admit(rows, registry)
    store.replace(bundles.to_objects(admitted), bundles.to_edges(admitted))
    before = store._slices()
    changed = bundles.admit(spark.createDataFrame([("cmd.md", CMD.replace("ADD URR", "ADD URR"))], "source_path string, raw_md string"), registry)
    store.merge(bundles.to_objects(changed), bundles.to_edges(changed))
    after = store._slices()
    assert {k[0] for k in before if before[k] != after[k]} == {"Command"}
    assert store.objects().count() == 2 and store.edges().count() == 1
    store.merge(bundles.to_objects(changed), bundles.to_edges(changed).where("false"))
    assert store.edges().count() == 0 and store.clean(1) and store.objects().count() == 2
    assert store.clean(1) == []


def test_upload_checks_the_folder(spark):
    registry, none = default_registry(spark), spark.createDataFrame([], "path string")
    rows = spark.createDataFrame([(0, "c.md", CMD), (1, "d.md", DOM), (2, "n.md", "no id")], "idx int, source_path string, raw_md string")
    found = bundles.upload(rows, "Command/UDG/9", registry, none, {"version": "9"})
    assert [r["path"] for r in found.documents.collect()] == ["Command/UDG/9/UDG@MMLCommand@ADD URR.md"]
    assert tuple(found.counts.first()) == (1, 0, 2) and "version: '9'" in found.documents.first()["raw_md"]
    assert {r["name"]: r["warning"] for r in found.warnings.collect()} == {"d.md": "not the folder of BusinessDomain", "n.md": "no id"}


def test_storage(spark, tmp_path):
    root = f"file://{tmp_path}"
    storage.write_text(spark, f"{root}/a/b/x.md", "one")
    storage.write_text(spark, f"{root}/a/b/x.md", "two")
    assert (tmp_path / "a/b/x.md").read_text() == "two"
    storage.move(spark, f"{root}/a/b", f"{root}/c/d")
    with pytest.raises(FileExistsError):
        storage.move(spark, f"{root}/a", f"{root}/c")
    storage.write_text(spark, f"{root}/new/y.md", "new")
    storage.replace_folder(spark, f"{root}/new", f"{root}/c/d", f"{root}/trash/1")
    assert storage.entries(spark, f"{root}/c/d") == ["y.md"] and storage.entries(spark, f"{root}/trash/1") == ["x.md"]
    with pytest.raises(FileNotFoundError):
        storage.replace_folder(spark, f"{root}/none", f"{root}/c/d", f"{root}/trash/2")
    assert storage.entries(spark, f"{root}/c/d") == ["y.md"]  # what was there came back
    assert storage.delete(spark, f"{root}/c/d/y.md", root) and not storage.exists(spark, f"{root}/c")


def test_small_writes_are_hidden_until_they_are_whole(spark, tmp_path):
    """A reader that lists the folder meanwhile must not find a name that is gone when it opens it."""
    seen = []

    class Watched:
        def __iter__(self):
            seen.extend(os.listdir(tmp_path))
            seen.extend(r["path"] for r in spark.read.format("binaryFile").load(f"file://{tmp_path}").select("path").collect())
            return iter(b"{}")

    storage.write_bytes(spark, f"file://{tmp_path}/x.json", Watched())
    assert seen and all(os.path.basename(n).startswith(".") for n in seen) and (tmp_path / "x.json").read_text() == "{}"
    assert [n for n in os.listdir(tmp_path) if n.endswith(".part")] == []
