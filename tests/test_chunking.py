from pyspark.sql import functions as F

from quire.config import DEFAULT
from quire.functions import text as t
from quire.functions.text import strip
from quire.operators import chunking, pdfnoise

BLOCKS = "attachmentKey string, page_index int, page_label string, block_no int, x0 double, y0 double, y1 double, block_type int, text string"
PAGES = "doc string, page int, paras array<string>"


def test_blocks_join_within_the_gap(spark):
    rows = [("A", 0, "", i, 0.0, y0, y1, 0, x) for i, (y0, y1, x) in enumerate([(0.0, 10.0, "a"), (10.0, 20.0, "b"), (32.0, 40.0, "c"), (52.1, 60.0, "d"), (59.0, 70.0, "e")])]
    rows += [("A", 0, "", 9, 0.0, 61.0, 62.0, 1, "image"), ("A", 1, "ii", 0, 0.0, 0.0, 1.0, 0, "hy-\nphen \n"), ("A", 2, "", 0, 0.0, 0.0, 1.0, 0, None)]
    out = {r.page_index: r.paras for r in chunking.merge_blocks(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert out == {0: ["a b c", "d", "e"], 1: ["hyphen"]}


def pages(spark, n, on, line="HEAD"):
    return spark.createDataFrame([("d", i, [line if i < on else f"x{i}", f"body {i}"]) for i in range(n)], PAGES)


def test_repeated_lines_thresholds(spark):
    count = lambda n, on: pdfnoise.repeated_lines(pages(spark, n, on), "doc", "page", "paras").count()
    assert count(8, 4) == 1 and count(20, 4) == 0 and count(3, 3) == 0
    assert pdfnoise.repeated_lines(pages(spark, 0, 0), "doc", "page", "paras").count() == 0


def test_noise_goes_and_indexes_shift(spark):
    p = spark.createDataFrame([("d", i, ["HEAD", f"Journal of Reeds {i}", f"body {i}"]) for i in range(6)] + [("e", 0, None)], PAGES)
    out = {(r.doc, r.page): r.paras for r in pdfnoise.without_noise(p, "doc", "page", "paras").collect()}
    assert out["d", 2] == ["Journal of Reeds 2", "body 2"] and out["e", 0] is None
    long = "Journal of Reeds, volume seventeen, 1901"
    p = spark.createDataFrame([("d", i, [f"{long} - page body {i}"]) for i in range(6)] + [("d", 6, [long])], PAGES)
    out = {r.page: r.paras for r in pdfnoise.without_noise(p, "doc", "page", "paras", lines=False).collect()}
    assert out[3] == ["page body 3"] and out[6] == []


def test_assembled_chunks_hold_their_laws(spark, small):
    notes = spark.read.parquet(f"{small}/notes.parquet").dropDuplicates(["noteKey"])
    out = chunking.chunk_notes(notes, "noteKey", "note_html", ["noteKey"])
    assert chunking.duplicate_ids(out).count() == 0
    assert out.where((F.length("text") > 1200) | (F.length("text") < 40) | (strip(F.col("text")) != F.col("text"))).count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("owner", F.col("doc_id").cast("string"))
    out = chunking.chunk_text(docs, "owner", "text", "html", ["owner"])
    assert out.count() > 0 and chunking.duplicate_ids(out).count() == 0
    assert out.where(F.length("text") > 1200).count() == 0


def test_epub_counts_on_over_chapters(spark):
    long = "The reed bed was measured again in that year, and the list was kept for the book. " * 4
    rows = [("E", 1, f"<p>{long}</p><p>{long}</p>"), ("E", 0, f"<p>{long}</p>"), ("E", 2, None), ("E", 3, f"<p>{long}</p>")]
    out = chunking.chunk_epub(spark.createDataFrame(rows, "attachmentKey string, chapter_index int, html string"), "attachmentKey", ["attachmentKey"]).orderBy("para_index").collect()
    assert [(r.para_index, r.chapter_index) for r in out] == [(0, 0), (1, 1), (2, 1), (3, 3)]
    assert out[1].chunk_id == "E:epub:para1:part0" and out[1].locator == "epub:para1"


def test_pages_have_their_own_paragraph_count(spark):
    text = "A line of the page that is long enough to be a chunk of its own, with words enough to stay. " * 3
    p = spark.createDataFrame([("A", 1, [text, text]), ("A", 2, [text]), ("A", 3, ["!" * 60]), ("A", 4, [])], "attachmentKey string, page int, paras array<string>")
    out = chunking.chunk_pages(p, "attachmentKey", "page", "paras", ["attachmentKey", "page"])
    assert sorted(r.chunk_id for r in out.collect()) == ["A:p1:para0:part0", "A:p1:para1:part0", "A:p2:para0:part0"]


def test_batches_equal_the_folds(spark, small):
    """Splitting and merging in Arrow batches against the folds over columns, on whole tables and hard cases."""
    hard = ["", "   ", None, "a" * 3000, "\u4e00" * 2500, "\u3002".join("\u6f22\u5b57" * 40 for _ in range(40)), "x. " * 900, "no end " * 400, "One. \u00a0Two.\x1fThree." * 120, "a.b" * 900, ("word " * 100 + ". ") * 30]
    rows = [(f"h{i}", x) for i, x in enumerate(hard)] + [(None, "words of a document without an owner " * 9)]
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").cast("string").alias("owner"), "text").unionByName(spark.createDataFrame(rows, "owner string, text string"))
    both = docs.select("owner", t.split_long(F.col("text")).alias("fold"), chunking.parts_of(F.col("text")).alias("batch"))
    assert both.where("NOT fold <=> batch").count() == 0 and both.where("size(batch) > 3").count() > 5
    paras = docs.select("owner", F.col("text").alias("sample"), t.paragraphs(t.clean(F.col("text")), t.joiner(F.col("text"))).alias("paras")).where("owner IS NOT NULL AND paras IS NOT NULL")
    got = chunking.assembled(paras, "owner", "paras", F.lit("html"), F.col("sample"), ["owner"], DEFAULT)

    def of_para(p, i):
        locator = F.concat(F.lit("html:para"), i)
        return F.transform(t.split_long(p), lambda part, j: F.struct(F.concat(F.col("owner"), F.lit(":"), locator, F.lit(":part"), j).alias("chunk_id"), t.strip(part).alias("text"), locator.alias("locator"), i.alias("para_index"), j.alias("part_index"), F.lit(None).cast("int").alias("chapter_index")))

    records = F.filter(F.flatten(F.transform("paras", of_para)), lambda r: F.length(r["text"]) >= DEFAULT.hard_min_chars)
    want = paras.select("owner", F.explode(t.merge_short(records, t.min_chunk_chars(F.col("sample")))).alias("c")).select("owner", *(F.col(f"c.{n}").alias(n) for n in got.columns[1:]))
    # and the whole way from text to chunks
    whole = docs.withColumn("clean", t.clean(F.col("text"))).withColumn("paras", t.paragraphs(F.col("clean"), t.joiner(F.substring("clean", 1, t.SAMPLE_CHARS)))).where("owner IS NOT NULL AND size(paras) > 0")
    for by_all in (False, True):
        sampled = whole.withColumn("sample", F.col("clean") if by_all else chunking._sample(F.col("paras"))).where(~t.is_gibberish(F.col("sample")))
        long_way = chunking.assembled(sampled, "owner", "paras", F.lit("html"), F.col("sample"), ["owner"], DEFAULT)
        short_way = chunking.chunk_text(docs, "owner", "text", "html", ["owner"], whole_sample=by_all)
        assert sorted(map(str, long_way.collect())) == sorted(map(str, short_way.collect()))
    key = lambda r: str(r.asDict())
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.count() > 100
