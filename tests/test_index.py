import pytest
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.engine import Engine
from quire.functions.embedding import HashingEmbedder
from quire.operators import incremental, index

LISTING = "attachmentKey string, mtime double, size bigint, seen_at timestamp, extra string"
MANIFEST = "attachmentKey string, mtime double, size bigint, pdf_path string, run_id int"
RUNS = "run_id int, status string"


def ts(n):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(days=n)


def test_changed_keys(spark):
    listing = spark.createDataFrame([("same", 1.0, 1, ts(1), ""), ("new", 1.0, 1, ts(1), ""), ("grown", 1.0, 2, ts(2), ""), ("grown", 1.0, 1, ts(1), ""), ("back", 1.0, 1, ts(3), ""), ("back", 1.0, 9, ts(2), ""), ("nulls", None, None, ts(1), ""), ("half", None, 1, ts(1), ""), ("failed", 5.0, 5, ts(1), ""), (None, 1.0, 1, ts(1), ""), ("undated", 7.0, 7, None, ""), ("twice", 1.0, 1, ts(1), ""), ("twice", 1.0, 1, ts(1), "")], LISTING)
    manifest = spark.createDataFrame([("same", 1.0, 1, None, 1), ("grown", 1.0, 1, None, 1), ("back", 1.0, 1, None, 1), ("nulls", None, None, None, 1), ("half", 1.0, 1, None, 1), ("failed", 5.0, 5, None, 2), ("failed", 4.0, 5, None, 1), ("gone", 1.0, 1, None, 1), ("twice", 1.0, 1, None, 3), ("twice", 1.0, 1, None, 3), ("twice", 2.0, 2, None, None)], MANIFEST)
    runs = spark.createDataFrame([(1, "success"), (2, "failed"), (3, "success"), (4, "running"), (None, "success")], RUNS)
    now = incremental.current_state(listing, "attachmentKey", incremental.FILE_STATE)
    then = incremental.recorded_state(manifest, runs, "attachmentKey", incremental.FILE_STATE)
    assert {r.attachmentKey for r in incremental.changed(now, then, "attachmentKey", incremental.FILE_STATE).collect()} == {"new", "grown", "half", "failed", "undated"}
    assert [r.attachmentKey for r in incremental.stale(now, then, "attachmentKey").collect()] == ["gone"]
    empty = incremental.recorded_state(manifest.limit(0), runs.limit(0), "attachmentKey", incremental.FILE_STATE)
    assert incremental.changed(now, empty, "attachmentKey", incremental.FILE_STATE).count() == now.count()
    assert incremental.changed(now.limit(0), then, "attachmentKey", incremental.FILE_STATE).count() == 0


class Boom(Exception):
    pass


def test_ledger_neither_skips_nor_repeats(spark, tmp_path):
    ledger = incremental.Ledger(spark, f"file://{tmp_path}/ledger", "k", ["v"])
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    work = lambda df: df.withColumn("out", F.col("v") * 10)
    assert ledger.run(rows(("a", 1), ("b", None)), work, "001")
    assert not ledger.run(rows(("a", 2)), work, "001")  # a repeated batch does nothing

    def broken(df):
        raise Boom

    with pytest.raises(Boom):
        ledger.run(rows(("a", 2), ("b", None), ("c", 3)), broken, "002")
    assert not ledger.committed("002")
    # a batch that wrote data but broke off before the commit
    work(rows(("a", 99))).write.parquet(f"{tmp_path}/ledger/data/batch=002")
    listing = rows(("a", 2), ("b", None), ("c", 3))
    assert {r.k for r in ledger.pending(listing).collect()} == {"a", "c"}
    assert ledger.run(listing, work, "002")
    assert sorted((r.k, r.out) for r in ledger.output().where("batch = 2").collect()) == [("a", 20), ("c", 30)]
    assert ledger.pending(listing).count() == 0


def test_replacement_by_owner(spark):
    schema = "chunk_id string, owner_key string, text string"
    old = spark.createDataFrame([("a:0", "a", "x"), ("a:1", "a", "x"), ("b:0", "b", "x"), ("c:0", "c", "x"), ("n:0", None, "x")], schema)
    new = spark.createDataFrame([("a:0", "a", "y")], schema)
    gone = spark.createDataFrame([("b",)], "owner_key string")
    assert sorted((r.chunk_id, r.text) for r in index.replace_owners(old, new, gone).collect()) == [("a:0", "y"), ("c:0", "x"), ("n:0", "x")]
    assert index.replace_owners(old, new.limit(0)).count() == 5 and index.upsert(old, new).count() == 5


def test_collection_versions(spark, tmp_path):
    c = index.Collection(spark, f"file://{tmp_path}", "p", 2)
    assert not c.exists() and c.read().count() == 0
    rows = spark.createDataFrame([("a:html:para0:part0", "a", "t", [1.0, 0.0], "html")], "chunk_id string, owner_key string, text string, embedding array<float>, source_type string")
    for _ in range(4):
        c.write(rows)
    assert c._versions() == [3, 4] and c.read().count() == 1
    c.delete(spark.createDataFrame([("a",)], "owner_key string"))
    assert c.read().count() == 0
    wrong = index.Collection(spark, f"file://{tmp_path}", "p", 2)
    wrong.write(rows.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    with pytest.raises(ValueError):
        wrong.read()
    assert c.load_config() is None
    for dim in (2, 3):
        c.save_config({"embedder": "hashing", "dim": dim})
    assert c.load_config() == {"embedder": "hashing", "dim": 3}
    c.rebuild()
    assert not c.exists()


def test_a_change_rewrites_only_its_buckets(spark, tmp_path):
    c = index.Collection(spark, f"file://{tmp_path}", "p", 2, buckets=16)
    schema = "chunk_id string, owner_key string, text string"
    rows = spark.createDataFrame([(f"k{i}:html:para0:part0", f"k{i}", "old") for i in range(60)] + [("x:html:para0:part0", None, "old")], schema)
    c.write(rows)
    before = c._pointer()["buckets"]
    c.replace(spark.createDataFrame([("k7:html:para0:part0", "k7", "new")], schema), spark.createDataFrame([("k9",)], "owner_key string"))
    after = c._pointer()["buckets"]
    assert 1 <= sum(after.get(b) != f for b, f in before.items()) <= 2 and len(before) > 8
    texts = {r.owner_key: r.text for r in c.read().collect()}
    assert len(texts) == 60 and texts["k7"] == "new" and "k9" not in texts and texts[None] == "old"
    ids = spark.createDataFrame([("k7:html:para0:part0",), ("k8:html:para0:part0",), ("none",)], "chunk_id string")
    assert {r.text for r in c.get(ids, ["text"]).collect()} == {"new", "old"} and c.near(ids).count() < 30
    with pytest.raises(Exception):
        c._write_text(f"{c.path}/_current/2", "{}", replace=False)  # a version is committed once
    for _ in range(2):
        c.replace(rows.limit(0), rows.where("owner_key = 'k1'").select("owner_key"))
    assert c.read().count() == 59 and c._versions() == [3, 4]


def test_batches_shadow_in_the_order_of_numbers(spark, tmp_path):
    ledger = incremental.Ledger(spark, f"file://{tmp_path}/ledger", "k", ["v"])
    rows = lambda v: spark.createDataFrame([("a", v)], "k string, v int")
    assert ledger.run(rows(1), lambda df: df, "9") and ledger.run(rows(2), lambda df: df, "10")
    assert ledger.pending(rows(2)).count() == 0 and ledger.pending(rows(1)).count() == 1


def test_a_library_is_indexed_and_searched(spark, tmp_path):
    import json

    from quire.cli import main

    body = "".join(f"<p>{x}</p>" for x in ("The warden of the reed bed kept a list of the birds for many years, and sold it with the book. " * 3, "The mill was built of stone from the shore, and the miller paid his rent in flour until the reform. " * 3))
    for key, name, text in (("H1", "page.html", body), ("B1", "bad.epub", "no archive")):
        (tmp_path / "lib" / "storage" / key).mkdir(parents=True)
        (tmp_path / "lib" / "storage" / key / name).write_text(text)
    item = lambda key, **data: json.dumps({"key": key, "version": 1, "data": {"key": key, **data}})
    note = lambda text: item("N1", itemType="note", parentItem="P1", note=f"<p>{text}</p>", version=len(text))
    fixed = [item("P1", itemType="book", title="Reeds", date="1999-01", creators=[{"lastName": "Roe", "firstName": "A"}]), item("H1", itemType="attachment", parentItem="P1", contentType="text/html", filename="page.html"), item("B1", itemType="attachment", parentItem="P1", contentType="application/epub+zip", filename="bad.epub")]

    def run(*extra):
        raw = spark.createDataFrame(list(enumerate([*fixed, *extra])), "seq long, json string")
        e = Engine(spark, raw, HashingEmbedder(64), EngineConfig(index_dir=f"file://{tmp_path}/index", min_return_chars=50))
        return e, e.index_library(str(tmp_path / "lib"))

    e, first = run(note("A remark on the tide gauge, which stood beside the harbour office for a century. " * 3))
    assert first == {"files": {"update": 2, "failed": 1}, "notes": {"update": 1}}
    top = e.rag_search("warden reed bed birds", k=1, context_window=1).collect()[0]
    assert top.citation == "Reeds (1999)" and "reed bed" in top.text and len(top.context) >= 1 and top.meta.itemKey == "P1"
    assert e.search_items(["reed bed", "mill"], k=3).collect()[0].itemKey == "P1"
    assert "reed" in e.get_chunk_context(top.id)["context_text"] and "error" in e.get_chunk_context("nothing")
    _, second = run(note("A remark on the tide gauge, which stood beside the harbour office for a century. " * 3))
    assert second == {"files": {"skip": 1, "update": 1, "failed": 1}, "notes": {"skip": 1}}  # the broken file comes again
    e, third = run()
    assert third["notes"] == {"delete": 1} and e.collection.read().where("source_type = 'note'").count() == 0
    e.rebuild()
    assert run()[1]["files"] == {"update": 2, "failed": 1}
    (tmp_path / "items.json").write_text("\n".join(fixed))
    assert main(["--index-dir", f"file://{tmp_path}/other", "index", "--items", f"file://{tmp_path}/items.json", "--data-dir", str(tmp_path / "lib")]) == 0
    assert main(["--index-dir", f"file://{tmp_path}/other", "search", "reed bed", "-k", "1"]) == 0


def test_notes_are_synced_incrementally(spark, tmp_path):
    e = Engine(spark, embedder=HashingEmbedder(16), config=EngineConfig(index_dir=f"file://{tmp_path}"))
    body = "<p>" + "The list was kept for a year and then it was sold with the book. " * 3 + "</p>"
    notes = lambda *r: spark.createDataFrame([(k, None, b, "t", 2000, ["A, B"], v) for k, b, v in r], "noteKey string, parentItemKey string, note_html string, title string, year int, creators array<string>, version int")
    first = e.sync_notes(notes(("a", body, 1), ("b", body, 1), ("c", body, 1)), spark.createDataFrame([], "noteKey string, version int"))
    assert first["counters"] == {"update": 3} and e.collection.read().count() == 3
    second = e.sync_notes(notes(("a", body, 1), ("b", "", 2)), first["manifest"])
    assert second["counters"] == {"skip": 1, "update": 1, "delete": 1}
    assert [r.owner_key for r in e.collection.read().collect()] == ["a"]  # an emptied note loses its chunks


def test_files_that_give_nothing_stay(spark, tmp_path):
    e = Engine(spark, embedder=HashingEmbedder(16), config=EngineConfig(index_dir=f"file://{tmp_path}"))
    chunk = lambda k, x: (f"{k}:html:para0:part0", k, k, x, "html")
    make = lambda *r: spark.createDataFrame(list(r), "chunk_id string, owner_key string, attachmentKey string, text string, source_type string")
    state = lambda *r: spark.createDataFrame(list(r), "attachmentKey string, mtime double, size bigint")
    one = e.sync_files(make(chunk("a", "old a"), chunk("b", "old b")), state(("a", 1.0, 1), ("b", 1.0, 1)), state(("x", 1.0, 1)).limit(0))
    assert one["counters"] == {"update": 2, "failed": 0}
    two = e.sync_files(make(chunk("a", "new a")), state(("a", 2.0, 1), ("b", 2.0, 1)), one["manifest"])
    assert two["counters"]["failed"] == 1
    assert {r.text for r in e.collection.read().collect()} == {"new a", "old b"}
    assert {(r.attachmentKey, r.mtime) for r in two["manifest"].collect()} == {("a", 2.0), ("b", 1.0)}


def test_json_manifests_are_imported(spark, tmp_path):
    import json

    from quire.sources import manifest

    path = tmp_path / "m.json"
    assert manifest.read_json(str(path)) == {"files": {}, "notes": {}}
    for text in ("", "[]", "{}"):
        path.write_text(text)
        assert [d.count() for d in manifest.import_manifest(spark, str(path))] == [0, 0]
    path.write_text("{broken")
    assert manifest.read_json(str(path)) == {"files": {}, "notes": {}} and not path.exists() and (tmp_path / "m.json.bak").exists()
    path.write_text(json.dumps({"files": {"a": {"mtime": 1, "size": 2, "pdf_path": "/x"}, "b": None}, "notes": {"n": {"version": 3}}, "version": 1}))
    files, notes = manifest.import_manifest(spark, str(path))
    assert {tuple(r) for r in files.collect()} == {("a", 1.0, 2, "/x"), ("b", None, None, None)} and [tuple(r) for r in notes.collect()] == [("n", 3)]
