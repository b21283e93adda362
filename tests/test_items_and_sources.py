import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from quire.operators import items
from quire.sources import api, files


def raw(spark, *values):
    return spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "seq bigint, json string")


def test_unwrap_nested_and_flat(spark):
    df = items.unwrap(raw(spark, {"key": "A", "data": {"key": "A", "title": "t"}}, {"key": "B", "title": "u"}, {"data": {"key": "C", "title": "v"}}, {"title": "no key"}, "[]", "broken"))
    assert {r.key: r.title for r in df.select("key", "data.title").collect()} == {"A": "t", "B": "u", "C": "v"}


def test_creators_and_years(spark):
    data = {"key": "P", "title": "T", "date": "2021-03", "creators": [{"lastName": "Doe", "firstName": "J"}, {"lastName": "Roe"}, {"name": "Org"}, {"lastName": " ", "firstName": "Ann"}]}
    r = items.parent_meta(items.unwrap(raw(spark, data))).first()
    assert (r.title, r.year, r.creators) == ("T", 2021, ["Doe, J", "Roe", "Ann"])
    assert items.parent_meta(items.unwrap(raw(spark, {"key": "P", "creators": [{"name": "Org"}]}))).first().creators is None


@pytest.mark.parametrize(("kind", "name", "listed", "indexed"), [("text/html", "x.pdf", "pdf", "pdf"), ("application/xhtml+xml", "x", "html", "html"), (None, "X.EPUB", "epub", "epub"), ("image/png", "x.png", None, "pdf"), (None, None, None, "pdf"), ("application/pdf", "x.html", "pdf", "html")])
def test_source_types(spark, kind, name, listed, indexed):
    r = spark.createDataFrame([(kind, name)], "k string, n string").select(items.source_type(F.col("k"), F.col("n")).alias("a"), items.indexed_source_type(F.col("k"), F.col("n"), items.source_type(F.col("k"), F.col("n"))).alias("b")).first()
    assert (r.a, r.b) == (listed, indexed)


def test_collections_keep_rows_without_a_parent(spark):
    attachment = lambda key, parent: {"key": key, "itemType": "attachment", "parentItem": parent, "filename": "f.pdf"}
    df = items.unwrap(raw(spark, {"key": "P", "itemType": "book", "collections": ["c"]}, {"key": "Q", "itemType": "book", "collections": []}, attachment("a", "P"), attachment("b", "Q"), attachment("c", None), attachment("d", "GONE")))
    assert {r.attachmentKey for r in items.normalized_attachments(df, collection="c").collect()} == {"a", "c"}
    assert {r.attachmentKey for r in items.normalized_attachments(df).collect()} == {"a", "b", "c", "d"}


@pytest.mark.parametrize("find", [items.normalized_attachments, items.note_records])
def test_parents_guessed_small_are_not_broadcast(spark, find):
    # 6,000 items: guessed at less than the threshold, several times as large
    kind = "attachment" if find is items.normalized_attachments else "note"
    parent = F.format_string('{"key": "P%d", "itemType": "book", "title": "title %d", "collections": ["c%d"]}', "id", "id", F.col("id") % 2)
    child = F.format_string(f'{{"key": "A%d", "itemType": "{kind}", "filename": "f.pdf", "parentItem": "%s"}}', "id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("P"), "id")).otherwise(""))
    n = spark.range(3000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        out = find(items.unwrap(n.select(parent.alias("json")).unionByName(n.select(child.alias("json")))), collection="c1")
        rows = {r[0]: r.title for r in out.collect()}
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == {f"A{i}": f"title {i}" if i % 3 else None for i in range(3000) if i % 3 == 0 or i % 2}


def test_dedupe_keeps_the_last_value_and_the_first_place(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, None), (None, 4, "z")], "k string, seq int, v string")
    assert {(r.k, r.v, r.seq, r.first_seen) for r in items.dedupe_last(df, "k", "seq").collect()} == {("a", None, 3, 1), ("b", "y", 2, 2)}


def test_recent_filters_after_the_limit(spark):
    df = spark.createDataFrame([("a", "2020", "attachment"), ("b", "2019", "note"), ("c", "2018", "book"), ("d", None, "book")], "key string, dateModified string, itemType string")
    assert [r.key for r in items.recent(df, 2).collect()] == ["b"]


def test_paths_and_snapshots(spark):
    have = spark.createDataFrame([("/d/storage/K1/a.pdf", 1.0, 1), ("/abs/b.pdf", 1.0, 1), ("/d/storage/K3/c.html", 1.0, 1), ("/d/storage/S/index.htm", 1.0, 1), ("/d/storage/S/a.html", 1.0, 1), ("/d/storage/T/b.HTML", 1.0, 1), ("/d/storage/T/c.html", 1.0, 1), ("/d/storage/U/x.css", 1.0, 1)], "path string, mtime double, size bigint")
    wanted = spark.createDataFrame([("K1", "storage:a.pdf", None), ("K2", "/abs/b.pdf", "b.pdf"), ("K3", "/gone.html", "c.html"), ("K4", None, None)], "attachmentKey string, path string, filename string")
    assert {r.attachmentKey: r.pdf_path for r in files.resolve_paths(wanted, have, "/d/").collect()} == {"K1": "/d/storage/K1/a.pdf", "K2": "/abs/b.pdf", "K3": "/d/storage/K3/c.html"}
    assert {r.folder: r.path.split("/")[-1] for r in files.snapshot_files(have.where("path LIKE '/d/storage/_/%'")).collect()} == {"/d/storage/S": "index.htm", "/d/storage/T": "b.HTML"}


def test_html_bytes(spark, tmp_path):
    assert files.decode_html("<meta charset='latin-1'>é".encode("latin-1")).endswith("é")
    assert files.decode_html("é".encode()) == "é" and files.decode_html(b"<meta charset=nonsense>x").endswith("x") and files.decode_html(None) is None
    (tmp_path / "a.html").write_bytes("<p>é</p>".encode())
    df = spark.read.format("binaryFile").load(str(tmp_path)).select(files.html_of(F.col("content")).alias("h"))
    assert df.first().h == "<p>é</p>"
    assert files.listing(spark, str(tmp_path)).first().size == 9


def epub(chapters):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        manifest = "".join(f'<item id="c{i}" href="c{i}.html"/>' for i in range(len(chapters)))
        spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
        z.writestr("o/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{manifest}</manifest><spine>{spine}</spine></package>')
        for i, c in enumerate(chapters):
            if c is not None:
                z.writestr(f"o/c{i}.html", c)
    return out.getvalue()


def test_epubs_and_pdfs_tolerate_broken_files(spark):
    df = spark.createDataFrame([("A", bytearray(epub(["<p>one</p>", None, "<p>three</p>"]))), ("B", bytearray(b"no zip"))], "attachmentKey string, content binary")
    out = {(r.attachmentKey, r.chapter_index): (r.html, r.error) for r in files.read_epubs(df).collect()}
    assert out["A", 0] == ("<p>one</p>", None) and out["A", 1] == (None, None) and out["A", 2][0] == "<p>three</p>"
    assert out["B", None][0] is None and "Zip" in out["B", None][1]
    assert all(r.error for r in files.read_pdfs(df).collect())


@pytest.fixture
def server():
    state = {"filter": True, "total": True}
    library = [{"key": f"K{i}", "data": {"key": f"K{i}", "itemType": "attachment" if i % 2 else "book", "dateModified": str(i)}} for i in range(7)]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            url, q = urlparse(self.path), parse_qs(urlparse(self.path).query)
            state.setdefault("headers", []).append(self.headers.get("X-Version"))
            if "itemType" in q and not state["filter"]:
                self.send_error(400)
                return
            if url.path.endswith("/file"):
                body, rows = b"bytes", None
            elif url.path.endswith("/items"):
                rows = [x for x in library if "itemType" not in q or x["data"]["itemType"] == q["itemType"][0]]
                start, limit = int(q.get("start", ["0"])[0]), int(q["limit"][0])
                body = json.dumps(rows[start : start + limit]).encode()
            else:
                rows, body = None, json.dumps(library[3]).encode()
            self.send_response(200)
            if rows is not None and state["total"]:
                self.send_header("Total-Results", str(len(rows)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", state
    http.shutdown()


@pytest.mark.parametrize(("total", "accepts"), [(True, True), (False, True), (True, False), (False, False)])
def test_paged_api(spark, server, total, accepts):
    base, state = server
    state["total"], state["filter"] = total, accepts
    spark.dataSource.register(api.LibrarySource)
    read = lambda **o: spark.read.format("library").options(base=base, prefix="u", limit="3", **o).load()
    assert sorted(json.loads(r.json)["key"] for r in read().collect()) == [f"K{i}" for i in range(7)]
    out = items.unwrap(read(itemType="attachment", **{"header.X-Version": "3"})).where("data.itemType = 'attachment'")
    assert sorted(r.key for r in out.collect()) == ["K1", "K3", "K5"] and "3" in state["headers"]


def test_single_lookups(server, tmp_path):
    base, _ = server
    client = api.LibraryClient(base, "u")
    assert client.item("K3")["key"] == "K3" and len(client.recent(2)) == 2
    path = client.download("K3", str(tmp_path / "x" / "f.pdf"))
    assert open(path, "rb").read() == b"bytes"


class FakePage:
    def __init__(self, blocks, text="", wait=0.0):
        self.blocks, self.text, self.wait = blocks, text, wait

    def get_text(self, kind):
        import time

        time.sleep(self.wait)
        if kind == "blocks":
            if self.blocks is None:
                raise RuntimeError("no blocks")
            return self.blocks
        return self.text

    def get_label(self):
        return "i"


def test_pages_fall_back_to_plain_text_and_time_out():
    from contextlib import nullcontext
    from types import SimpleNamespace

    pages = [FakePage([(0, 1, 9, 2, "a block", 0, 0)], "unused"), FakePage(None, "one\n\ntwo"), FakePage([], "three"), FakePage([(0, 1, 9, 2, "late", 0, 0)], wait=1.5), FakePage([(0, 0, 1, 1, "<image>", 0, 1)], "beside an image"), FakePage([], "")]
    library = SimpleNamespace(open=lambda stream, filetype: nullcontext(pages))
    rows = list(files.pdf_blocks(b"", library, 0.5))
    assert [(r[0], r[-1]) for r in rows] == [(0, "a block"), (1, "one"), (1, "two"), (2, "three"), (4, "beside an image")]
    assert rows[2][4] - rows[1][5] > 12  # plain paragraphs stay apart
