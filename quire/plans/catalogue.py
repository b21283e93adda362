"""Queries of the engine's own operators over the test tables, and the SQL they are held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import DEFAULT
from quire.engine import Engine
from quire.functions import text as t
from quire.operators import chunking, context, incremental, index, items, pdfnoise, search, where
from quire.runtime import checkpoint_dir, checkpointed, ship, table
from quire.sources import files

# --- shared pieces ---------------------------------------------------------------------------------------

FILTER = {"$and": [{"source_type": {"$in": ["pdf", "html"]}}, {"$or": [{"year": {"$gte": 1990}}, {"itemKey": {"$eq": None}}]}, {"$not": {"page": 3}}]}


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per chunk id, its latest, with the columns named: others are not read."""
    return items.dedupe_last(table(spark, d, "chunks").select("chunk_id", "indexed_at", *columns), "chunk_id", "indexed_at").drop("first_seen")


_CHUNKS = "(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST) AS rn FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1)"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec")), rows


def _hits(spark: SparkSession, d: str, n: int) -> DataFrame:
    queries, rows = _vectors(spark, d)
    return search.nearest(queries, rows, n, key="vec_id").join(rows.select("vec_id", "label"), "vec_id")


_HITS = """(SELECT q, rank, vec_id, label, distance FROM (
  SELECT q, vec_id, label, distance, row_number() OVER (PARTITION BY q ORDER BY distance, vec_id) AS rank FROM (
    SELECT a.vec_id AS q, b.vec_id, b.label, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS distance
    FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= {n})"""


# --- search ------------------------------------------------------------------------------------------------


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, 25).select("q", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"))


def rrf_passages(spark: SparkSession, d: str) -> DataFrame:
    fused = search.fuse_passages(_hits(spark, d, 25), key="vec_id")
    return fused.select("vec_id", F.round("distance", 6).alias("distance"), F.round("rrf_score", 9).alias("rrf_score"), F.col("first_q"), F.col("first_rank").cast("long").alias("first_rank"))


def rrf_items(spark: SparkSession, d: str) -> DataFrame:
    fused = search.fuse_items(_hits(spark, d, 100), item="label", meta=("vec_id",))
    return fused.select("label", F.col("vec_id").alias("first_vec"), F.round("distance", 6).alias("distance"), F.round("rrf_score", 9).alias("rrf_score"))


def exclude_and_include(spark: SparkSession, d: str) -> DataFrame:
    """Labels restricted before ranking, ids excluded after fusion."""
    queries, rows = _vectors(spark, d)
    eligible = rows.where(where.compile_where({"label": {"$in": [1, 3, 5]}}))
    fused = search.fuse_passages(search.nearest(queries, eligible, 27, key="vec_id"), key="vec_id")
    return fused.where(~F.col("vec_id").isin(100, 200)).select("vec_id", F.round("rrf_score", 9).alias("rrf_score"))


def search_where(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "source_type", "year", "page", "itemKey").where(where.compile_where(FILTER)).select("chunk_id", "source_type", "year", "page")


def note_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "source_type", "year").where(where.compile_where(where.effective({"year": {"$lt": 2000}}))).select("chunk_id", "source_type", "year")


def asks_for_notes(spark: SparkSession, d: str) -> DataFrame:
    """A filter that names notes itself is not narrowed."""
    wanted = where.effective({"$or": [{"source_type": "note"}, {"itemKey": {"$eq": None}}]})
    return _chunks(spark, d, "source_type", "itemKey").where(where.compile_where(wanted)).select("chunk_id", "source_type")


def item_keys(spark: SparkSession, d: str) -> DataFrame:
    """Restricted to stated items, those of every fiftieth document, which are few."""
    keys = [r[0] for r in table(spark, d, "documents").where("doc_id % 50 = 0 AND item_key IS NOT NULL").select("item_key").distinct().collect()]
    kept = where.compile_where(where.effective({"year": {"$gte": 1950}}, item_keys=keys))
    return _chunks(spark, d, "itemKey", "year", "source_type").where(kept).select("chunk_id", "itemKey")


def min_return_chars(spark: SparkSession, d: str) -> DataFrame:
    """What the least length leaves of the chunks."""
    return _chunks(spark, d, "source_type", "text").where(F.length(t.strip(F.col("text"))) >= 200).select("chunk_id", "source_type", F.length("text").cast("long").alias("chars"))


LIBRARY = ("text", "itemKey", "attachmentKey", "noteKey", "title", "year", "creators", "source_type", "contentType", "filename", "path", "pdf_path", "page", "page_label", "para_index", "locator")


def _library(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Three queries, and the chunks with a vector of the embeddings table each, by place and length."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    at = F.pmod(F.coalesce(F.length("text"), F.lit(0)) + 31 * F.coalesce("para_index", F.lit(0)), F.lit(500)).cast("bigint")
    chunks = _chunks(spark, d, *LIBRARY).withColumn("vec_id", at).join(vectors, "vec_id").drop("vec_id")
    return vectors.where("vec_id IN (5, 105, 205)").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec")), chunks


def _shown(hits: DataFrame) -> DataFrame:
    around = F.array_join(F.transform("context", lambda x: x["id"]), " ")
    return hits.select("id", F.round("distance", 6).alias("distance"), F.round("rrf_score", 9).alias("rrf_score"), "citation", F.md5("text").alias("digest"), around.alias("around"), F.col("meta.itemKey").alias("itemKey"), F.col("meta.locator").alias("locator"))


def rag_search(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best passages of three fused queries with the paragraphs beside them; notes are left out by default."""
    queries, chunks = _library(spark, d)
    return _shown(search.search_passages(queries, chunks, 20, {"year": {"$gte": 1900}}, 1))


def rag_search_excluding(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best once the three best of a first search are excluded; notes count, too."""
    queries, chunks = _library(spark, d)
    first = [r.id for r in search.search_passages(queries, chunks, 3, include_notes=True).collect()]
    return _shown(search.search_passages(queries, chunks, 20, include_notes=True, exclude_chunk_ids=first))


def search_items(spark: SparkSession, d: str) -> DataFrame:
    queries, chunks = _library(spark, d)
    out = search.search_items(queries, chunks, 10, {"source_type": {"$ne": "epub"}})
    return out.select("itemKey", "title", "year", "creators", F.round("distance", 6).alias("distance"), F.round("rrf_score", 9).alias("rrf_score"))


def get_chunk_context(spark: SparkSession, d: str) -> DataFrame:
    """The context of every chunk of a first paragraph, as the lookup of one chunk gives it."""
    chunks = _chunks(spark, d, "text", "title", "year", "page", "page_label")
    hits = chunks.where("chunk_id LIKE '%:para0:part0'").select("chunk_id")
    shown = context.with_context(hits, chunks, 3)
    return shown.select("chunk_id", F.size("context").cast("long").alias("n"), F.md5(F.array_join(F.transform("context", lambda x: F.concat_ws("|", x["id"], x["citation"], x["text"])), "\n")).alias("digest"))


def chunk_id_parse(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", context.parse_id(F.col("chunk_id")).alias("p")).select("chunk_id", "p.*")


def citation(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "title", "year", "page", "page_label").select("chunk_id", items.citation(F.col("title"), F.col("year"), F.col("page"), F.col("page_label")).alias("citation"))


_CITE = """CASE WHEN coalesce(title, '') = '' THEN ''
  WHEN coalesce(nullif(trim(page_label), ''), page::VARCHAR) IS NOT NULL THEN title || CASE WHEN coalesce(year, 0) <> 0 THEN ' (' || year || ')' ELSE '' END || ' p.' || coalesce(nullif(trim(page_label), ''), page::VARCHAR)
  WHEN coalesce(year, 0) <> 0 THEN title || ' (' || year || ')' ELSE title END"""


def context_window(spark: SparkSession, d: str) -> DataFrame:
    """Around every chunk, two paragraphs each way."""
    chunks = _chunks(spark, d, "text", "title", "year", "page", "page_label")
    return context.neighbours(chunks, chunks, 2).select("hit", "id", "para_index")


def context_text(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d, "text", "title", "year", "page", "page_label")
    texts = context.context_texts(chunks, chunks, 2)
    return texts.select("hit", F.length("context_text").cast("long").alias("chars"), F.md5("context_text").alias("digest"), F.size("chunk_ids_included").cast("long").alias("n"))


_AROUND = f"""(SELECT h.chunk_id AS hit, c.chunk_id AS id, c.para_index, c.text FROM {_CHUNKS} h JOIN {_CHUNKS} c
  ON regexp_extract(h.chunk_id, '^([^:]*:[^:]*:para)', 1) = regexp_extract(c.chunk_id, '^([^:]*:[^:]*:para)', 1)
  AND abs(regexp_extract(h.chunk_id, ':para([0-9]+):', 1)::INT - regexp_extract(c.chunk_id, ':para([0-9]+):', 1)::INT) <= 2
  AND c.chunk_id LIKE '%:part0')"""


# --- items -------------------------------------------------------------------------------------------------


def recent_items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "ts", "event_type")
    return items.recent(rows.withColumn("kind", F.when(F.col("event_type") == "click", "attachment").otherwise(F.col("event_type"))), 200, order="ts", kind="kind", key="event_id").select("event_id", "event_type")


def creators_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "attachments")
    return rows.select("attachmentKey", t.creators_text(F.col("creators")).alias("creators"), "seen_at").distinct()


def source_type_of(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "attachments").select("contentType", "filename", "pdf_path", "source_type").distinct()
    return rows.select("contentType", "filename", "pdf_path", "source_type", items.source_type(F.col("contentType"), F.col("filename")).alias("listed"), items.indexed_source_type(F.col("contentType"), F.col("pdf_path"), F.col("source_type")).alias("indexed")).distinct()


def year_prefix(spark: SparkSession, d: str) -> DataFrame:
    dates = table(spark, d, "orders").select(F.concat(F.when(F.col("o_orderkey") % 3 == 0, "c. ").otherwise(""), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    return dates.select(t.year_of(F.col("date")).alias("year")).groupBy("year").agg(F.count("*").alias("n"))


def _raw_items(spark: SparkSession, d: str) -> DataFrame:
    """Items as JSON texts, half of them nested: customers as parents, orders as attachments."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.concat(F.lit("C"), "c_custkey").alias("key"), F.struct(F.concat(F.lit("C"), "c_custkey").alias("key"), F.lit("book").alias("itemType"), F.col("c_name").alias("title"), F.concat(F.lit(1990) + F.col("c_nationkey"), F.lit("-05")).alias("date"), F.array(F.struct(F.col("c_name").alias("lastName"), F.col("c_mktsegment").alias("firstName"), F.lit(None).cast("string").alias("name")), F.struct(F.lit(" ").alias("lastName"), F.lit(None).cast("string").alias("firstName"), F.lit("Body").alias("name"))).alias("creators"), F.array("c_mktsegment").alias("collections")).alias("data"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("O"), "o_orderkey").alias("key"), F.struct(F.concat(F.lit("O"), "o_orderkey").alias("key"), F.lit("attachment").alias("itemType"), F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("C"), "o_custkey")).alias("parentItem"), F.when(F.col("o_orderstatus") == "O", "application/pdf").alias("contentType"), F.concat(F.lit("f"), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, ".HTML").otherwise(".txt")).alias("filename")).alias("data"))
    nested = lambda df: df.select("seq", F.when(F.col("seq") % 2 == 0, F.to_json(F.struct("key", "data"))).otherwise(F.to_json("data")).alias("json"))
    return nested(c).unionByName(nested(o))


def normalized_attachments(spark: SparkSession, d: str) -> DataFrame:
    out = items.normalized_attachments(items.unwrap(_raw_items(spark, d)), collection="BUILDING")
    return out.select("attachmentKey", "parentItemKey", "title", "year", F.array_join("creators", "; ").alias("creators"), "source_type")


def note_records(spark: SparkSession, d: str) -> DataFrame:
    """Customers as items, nations' comments as their notes, with the metadata of the parent; one in three has none."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    data = lambda **f: F.struct(*(v.alias(k) for k, v in f.items()))
    key = F.concat(F.lit("C"), "c_custkey")
    book = c.select(F.to_json(F.struct(key.alias("key"), data(itemType=F.lit("book"), title=F.col("c_name"), date=F.concat(F.lit(1990) + F.col("c_nationkey"), F.lit("-05")), creators=F.array(F.struct(F.col("c_name").alias("lastName"), F.col("c_mktsegment").alias("firstName")))).alias("data"))).alias("json"))
    note = c.select(F.to_json(data(key=F.concat(F.lit("N"), "c_custkey"), itemType=F.lit("note"), parentItem=F.when(F.col("c_custkey") % 3 > 0, key), note=F.concat(F.lit("<p>on "), "c_name", F.lit("</p>")), version=F.col("c_nationkey"))).alias("json"))
    out = items.note_records(items.unwrap(book.unionByName(note)))
    return out.select("noteKey", "parentItemKey", "note_html", "title", "year", F.array_join("creators", "; ").alias("creators"), "version")


def chunk_base(spark: SparkSession, d: str) -> DataFrame:
    base = items.chunk_base(table(spark, d, "attachments")).distinct()
    return base.select("itemKey", "attachmentKey", "noteKey", "title", "year", "creators", "contentType", "filename", "path", "pdf_path", "source_type")


def item_details(spark: SparkSession, d: str) -> DataFrame:
    """The lookup of one item among all."""
    found = Engine(spark, _raw_items(spark, d)).get_item_details("C7")
    return found.select("key", F.col("data.itemType").alias("item_type"), F.col("data.title").alias("title"), F.col("data.date").alias("date"))


def resolve_paths(spark: SparkSession, d: str) -> DataFrame:
    """Absolute paths, and file names below the folder of their attachment, among the files listed."""
    wanted = table(spark, d, "attachments").select("attachmentKey", F.col("pdf_path").alias("path"), "filename").distinct()
    there = table(spark, d, "file_listing").select("path").distinct()
    return files.resolve_paths(wanted, there, "/data/library")


def snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    """Of each region's folders of parts, the snapshot; some hold an index."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    name = F.when(F.col("p_partkey") % 11 == 0, "Index.HTML").when(F.col("p_partkey") % 7 == 0, "index.htm").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("page"), "p_partkey", F.lit(".html"))).otherwise(F.concat(F.lit("scan"), "p_partkey", F.lit(".pdf")))
    return files.snapshot_files(p.select(F.concat(F.lit("/storage/S"), F.floor(F.col("p_partkey") / 5), F.lit("/"), name).alias("path")))


# --- index -------------------------------------------------------------------------------------------------


def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "file_listing").select("attachmentKey", "size", "seen_at")
    return items.dedupe_last(rows, "attachmentKey", "seen_at").select("attachmentKey", "size", "seen_at", "first_seen")


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    now = incremental.current_state(table(spark, d, "file_listing"), "attachmentKey", incremental.FILE_STATE)
    return now, incremental.recorded_state(table(spark, d, "manifest_files"), table(spark, d, "index_runs"), "attachmentKey", incremental.FILE_STATE)


_NOW = "(SELECT attachmentKey, mtime, size FROM (SELECT *, row_number() OVER (PARTITION BY attachmentKey ORDER BY seen_at DESC NULLS LAST, mtime DESC NULLS LAST, size DESC NULLS LAST) AS rn FROM file_listing WHERE attachmentKey IS NOT NULL) WHERE rn = 1)"
_THEN = "(SELECT attachmentKey, mtime, size FROM (SELECT *, row_number() OVER (PARTITION BY attachmentKey ORDER BY run_id DESC, mtime DESC NULLS LAST, size DESC NULLS LAST) AS rn FROM manifest_files WHERE attachmentKey IS NOT NULL AND run_id IN (SELECT run_id FROM index_runs WHERE status = 'success')) WHERE rn = 1)"
_ACTIONS = f"(SELECT coalesce(n.attachmentKey, r.attachmentKey) AS attachmentKey, CASE WHEN n.attachmentKey IS NULL THEN 'delete' WHEN r.attachmentKey IS NULL OR n.mtime IS DISTINCT FROM r.mtime OR n.size IS DISTINCT FROM r.size THEN 'update' ELSE 'skip' END AS action FROM {_NOW} n FULL JOIN {_THEN} r ON n.attachmentKey = r.attachmentKey)"


def stale_keys(spark: SparkSession, d: str) -> DataFrame:
    return incremental.stale(*_files(spark, d), "attachmentKey")


def index_plan(spark: SparkSession, d: str) -> DataFrame:
    return index.plan(*_files(spark, d), "attachmentKey", incremental.FILE_STATE)


def index_counters(spark: SparkSession, d: str) -> DataFrame:
    return index.counters({"file": index_plan(spark, d)})


def replace_owner(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of changed files replaced by one new chunk each, those of stale files dropped."""
    plan = index_plan(spark, d)
    fresh = plan.where("action = 'update'").select(F.concat("attachmentKey", F.lit(":html:para0:part0")).alias("chunk_id"), F.col("attachmentKey").alias("owner_key"), F.concat(F.lit("new text of "), "attachmentKey").alias("text"))
    gone = plan.where("action = 'delete'").select(F.col("attachmentKey").alias("owner_key"))
    return index.replace_owners(_chunks(spark, d, "owner_key", "text").select("chunk_id", "owner_key", "text"), fresh, gone)


def upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows by id: those of chunk ids that a file's first chunk has again."""
    old = _chunks(spark, d, "text").select("chunk_id", "text")
    fresh = table(spark, d, "attachments").where("attachmentKey IS NOT NULL").select(F.concat("attachmentKey", F.lit(":html:para0:part0")).alias("chunk_id"), F.concat(F.lit("new "), "attachmentKey").alias("text")).distinct()
    return index.upsert(old, fresh)


def collection_replace(spark: SparkSession, d: str) -> DataFrame:
    """As ``replace_owner``, through a collection on disk: written, two owners' buckets replaced and dropped, read again."""
    folder = f"{checkpoint_dir(spark)}/collection-{uuid.uuid4().hex}"
    kept = index.Collection(spark, folder, "chunks", 64, buckets=16)
    kept.write(_chunks(spark, d, "owner_key", "text").select("chunk_id", "owner_key", "text"))
    plan = checkpointed(index_plan(spark, d))
    fresh = plan.where("action = 'update'").select(F.concat("attachmentKey", F.lit(":html:para0:part0")).alias("chunk_id"), F.col("attachmentKey").alias("owner_key"), F.concat(F.lit("new text of "), "attachmentKey").alias("text"))
    kept.replace(fresh)
    kept.delete(plan.where("action = 'delete'").select(F.col("attachmentKey").alias("owner_key")))
    return kept.read()


# --- text --------------------------------------------------------------------------------------------------


def control_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", F.length(t.without_control(F.col("text"))).cast("long").alias("chars"), F.md5(t.without_control(F.col("text"))).alias("digest"))


def nfkc_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.clean(F.col("text")).alias("text"))


def language_ratios(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.round(t.latin_ratio(c), 6).alias("latin"), F.round(t.cjk_ratio(c), 6).alias("cjk"), t.is_cjk(c).alias("no_space"), t.overlap(c).cast("long").alias("overlap"))


def gibberish(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.is_gibberish(F.col("text")).alias("gibberish"))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("chunk_id", "text").distinct().select("chunk_id", t.paragraphs(F.col("text"), F.lit(" ")).alias("p"))
    return rows.select("chunk_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "¶")).alias("digest"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    pieces = table(spark, d, "documents").select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("pos", "piece"))
    return pieces.where("piece <> ''").select("doc_id", F.md5("piece").alias("digest"), F.length("piece").cast("long").alias("chars"))


def merge_short(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each HTML snapshot and note, in order, merged as the chunker merges its parts."""
    c = _chunks(spark, d, "owner_key", "text", "locator", "para_index", "part_index").where("owner_key IS NOT NULL AND text IS NOT NULL AND (chunk_id LIKE '%:html:%' OR chunk_id LIKE '%:note:%')")
    record = F.struct("chunk_id", "text", "locator", "para_index", "part_index", F.lit(None).cast("int").alias("chapter_index"))
    owners = c.groupBy("owner_key").agg(F.array_sort(F.collect_list(F.struct("para_index", "part_index", "chunk_id", record.alias("r")))).alias("rs"))
    merged = owners.select("owner_key", F.explode(t.merge_short(F.transform("rs", lambda x: x["r"]), F.lit(500))).alias("m"))
    return merged.select("owner_key", F.col("m.chunk_id").alias("chunk_id"), F.md5("m.text").alias("digest"), F.col("m.merged").alias("merged"), F.col("m.merge_count").alias("merge_count"), F.col("m.locator_end").alias("locator_end"))


def split_long(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.parts_of(F.col("text"))).alias("part_index", "part"))


def html_strip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "notes").where("note_html IS NOT NULL").select("noteKey", "version", "note_html").distinct()
    return rows.select("noteKey", "version", F.md5(t.strip_html(F.col("note_html"))).alias("digest")).distinct()


def html_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "notes").select("noteKey", "note_html").distinct()
    return rows.select("noteKey", t.text_of_html(F.col("note_html")).alias("text"))


def chunk_notes(spark: SparkSession, d: str) -> DataFrame:
    notes = items.dedupe_last(table(spark, d, "notes"), "noteKey", "seen_at")
    return chunking.chunk_notes(notes, "noteKey", "note_html", ["noteKey", "title"])


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("owner"), "text")
    return chunking.chunk_text(rows, "owner", "text", "html", ["owner"])


def repeated_lines_default(spark: SparkSession, d: str) -> DataFrame:
    """At the default threshold, over pages of which every one begins with the year of its item."""
    return pdfnoise.repeated_lines(_headed(spark, d), "attachmentKey", "page", "paras")


def without_noise(spark: SparkSession, d: str) -> DataFrame:
    """The same pages without what comes back on them."""
    kept = pdfnoise.without_noise(_headed(spark, d), "attachmentKey", "page", "paras")
    return kept.select("attachmentKey", "page", F.size("paras").cast("long").alias("n"), F.md5(F.array_join("paras", "¶")).alias("digest"))


def assembled(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of orders, whose lines are their paragraphs, with positional ids."""
    line = F.concat(F.lit("Order "), "l_orderkey", F.lit(" line "), "l_linenumber", F.lit(" with part "), "l_partkey", F.lit(" of supplier "), "l_suppkey", F.lit(" in state "), "l_returnflag", "l_linestatus", F.when(F.col("l_partkey") % 3 == 0, F.repeat(F.lit(" as agreed"), 30)).otherwise(""))
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("O"), "l_orderkey").alias("owner"), F.struct(F.col("l_linenumber"), line.alias("text")).alias("l"))
    docs = rows.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["text"]).alias("paras"))
    out = chunking.assembled(docs, "owner", "paras", F.lit("html"), F.array_join("paras", "\n\n"), ["owner"], DEFAULT)
    return out.select("owner", "chunk_id", F.md5("text").alias("digest"), "para_index", "part_index", "merged", "merge_count", "locator", "locator_end")


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return chunking.duplicate_ids(table(spark, d, "chunks").select("chunk_id")).select("chunk_id", F.col("count").alias("n"))


def language_choice(spark: SparkSession, d: str) -> DataFrame:
    """What the language decides for a whole document: joiner, local minimum, whether it has no spaces."""
    c = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", t.is_no_space_document(c).alias("no_space"), F.length(t.joiner(c)).cast("long").alias("joiner"), t.min_chunk_chars(c).cast("long").alias("least"))


def _headed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("event_id") % 97).alias("doc"), F.col("event_id").alias("page"), "event_type", "user_id", "value")
    head = F.concat(F.lit("Annals of volume "), "doc")
    paras = F.array(F.when(F.col("page") % 3 > 0, head).otherwise(F.concat(head, F.lit(" - page "), F.col("page"))), F.concat(F.lit("user "), "user_id"), F.col("event_type"))
    return rows.select(F.concat(F.lit("D"), "doc").alias("attachmentKey"), "page", paras.alias("paras"))


def merge_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as blocks of a page: gaps of 8 join, those of 20 part."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    top = F.col("l_linenumber") * 30.0 + F.when(F.col("l_returnflag") == "R", 0.0).otherwise(12.0)
    blocks = rows.select(F.concat(F.lit("O"), F.col("l_orderkey")).alias("attachmentKey"), F.lit(0).alias("page_index"), F.lit("").alias("page_label"), F.col("l_linenumber").alias("block_no"), F.lit(0.0).alias("x0"), top.alias("y0"), (F.col("l_linenumber") * 30.0 + 22.0).alias("y1"), F.when(F.col("l_quantity") < 5, 1).otherwise(0).alias("block_type"), F.concat(F.lit("line "), "l_linenumber", F.lit(" hy-\nphen")).alias("text"))
    return chunking.merge_blocks(blocks).select("attachmentKey", F.size("paras").cast("long").alias("n"), F.array_join("paras", "¶").alias("paras"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """PDF pages of an attachment with their lines as paragraphs."""
    rows = table(spark, d, "chunks").where("chunk_id LIKE '%:p%:para%' AND text IS NOT NULL AND page IS NOT NULL").select("attachmentKey", "page", "chunk_id", "text").distinct()
    lines = rows.select("attachmentKey", "page", F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "").alias("lines"), "chunk_id")
    return lines.groupBy("attachmentKey", "page").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "lines"))), lambda x: x["lines"])).alias("paras"))


_PAGES = "(SELECT DISTINCT attachmentKey, page, chunk_id, text FROM chunks WHERE chunk_id LIKE '%:p%:para%' AND text IS NOT NULL AND page IS NOT NULL)"
_LINES = f"(SELECT DISTINCT attachmentKey, page, trim(line) AS line FROM (SELECT attachmentKey, page, unnest(string_split(text, chr(10))) AS line FROM {_PAGES}) WHERE trim(line) <> '')"


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return pdfnoise.repeated_lines(_pages(spark, d), "attachmentKey", "page", "paras", ratio=0.05, least=2)


def repeated_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return pdfnoise.repeated_prefixes(_pages(spark, d), "attachmentKey", "page", "paras", ratio=0.05, least=2)


QUERIES = {
    f.__name__: f
    for f in (
        knn_topk, rrf_passages, rrf_items, exclude_and_include, search_where, note_exclusion, asks_for_notes, item_keys, rag_search, rag_search_excluding, search_items, get_chunk_context, min_return_chars, chunk_id_parse, citation, context_window, context_text, recent_items, creators_join, source_type_of, year_prefix, normalized_attachments,
        dedupe_last, stale_keys, index_plan, index_counters, replace_owner, control_clean, nfkc_clean, language_ratios, gibberish, paragraphs, sentence_split, split_long, html_strip, html_text, chunk_notes, chunk_documents, repeated_lines, repeated_prefixes, repeated_lines_default, without_noise, merge_blocks, merge_short,
        assembled, duplicate_ids, language_choice, note_records, chunk_base, item_details, resolve_paths, snapshot_files, upsert, collection_replace,
    )
}

_SOLID = r"regexp_replace(text, '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')"
_LATIN = f"(length(regexp_replace({_SOLID}, '[^A-Za-z]', '', 'g')) / greatest(length({_SOLID}), 1))"
_CJK = rf"(length(regexp_replace({_SOLID}, '[^\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{FF66}}-\x{{FF9D}}]', '', 'g')) / greatest(length({_SOLID}), 1))"
_GAP = r"[ \t\x0B\x0C\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ANY = _GAP.replace("[ ", "[\\n ")
_TRIM = f"'^{_ANY}+|{_ANY}+$', '', 'g'"
_FUSE = "SELECT {key}, round(min(distance), 6) AS distance, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score"


def _fill(sql: str, **parts: object) -> str:
    """``@name@`` in a piece of SQL by its value; braces stand in its patterns."""
    for name, value in parts.items():
        sql = sql.replace(f"@{name}@", str(value))
    return sql


# sentences: a private sign stands where the text is cut; where no space follows an end sign, the end signs alone cut
_MARK = "chr(57344)"
_SENTENCES = f"(CASE WHEN regexp_matches(@c@, '[.?!。！？]{_ANY}') THEN string_split(regexp_replace(@c@, '([.?!。！？]){_ANY}+', '\\1' || {_MARK}, 'g'), {_MARK}) ELSE string_split(regexp_replace(@c@, '([.?!。！？])', '\\1' || {_MARK}, 'g'), {_MARK}) END)"
_SPLIT = f"""WITH RECURSIVE src AS (SELECT doc_id, regexp_replace(text, {_TRIM}) AS text FROM documents WHERE text IS NOT NULL),
info AS (SELECT doc_id, text, CASE WHEN {_CJK} >= 0.2 AND {_LATIN} <= 0.4 THEN '' ELSE ' ' END AS glue, CASE WHEN {_CJK} >= 0.2 AND {_LATIN} <= 0.4 THEN 60 ELSE 80 END AS back FROM src WHERE length(text) > 1200),
pieces AS (SELECT doc_id, glue, back, list_filter(list_transform({_fill(_SENTENCES, c='text')}, lambda x: regexp_replace(x, {_TRIM})), lambda x: x <> '') AS p FROM info),
pack AS (SELECT doc_id, glue, back, p, 1 AS i, p[1] AS cur, []::VARCHAR[] AS parts FROM pieces
  UNION ALL SELECT doc_id, glue, back, p, i + 1, CASE WHEN length(cur) + length(glue) + length(p[i + 1]) <= 1200 THEN cur || glue || p[i + 1] ELSE p[i + 1] END,
    CASE WHEN length(cur) + length(glue) + length(p[i + 1]) <= 1200 THEN parts ELSE list_append(parts, cur) END FROM pack WHERE i < len(p)),
packed AS (SELECT doc_id, back, list_append(parts, cur) AS p FROM pack WHERE i = len(p)),
lap AS (SELECT doc_id, back, p, 1 AS i, p[1] AS cur FROM packed
  UNION ALL SELECT doc_id, back, p, i + 1, CASE WHEN least(back, 1200 - length(p[i + 1])) > 0 THEN right(cur, least(back, 1200 - length(p[i + 1]))) ELSE '' END || p[i + 1] FROM lap WHERE i < len(p)),
cut AS (SELECT doc_id, i, 0 AS k, cur AS part FROM lap WHERE length(cur) <= 1200
  UNION ALL SELECT doc_id, i, k, regexp_replace(substr(cur, k * (1200 - back) + 1, 1200), {_TRIM}) FROM (SELECT doc_id, back, i, cur, unnest(range(ceil((length(cur) - 1200) / (1200 - back))::INT + 1)) AS k FROM lap WHERE length(cur) > 1200))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INT AS part_index, part FROM cut WHERE part <> '' UNION ALL SELECT doc_id, 0, text FROM src WHERE length(text) <= 1200"""
_FOLD = f"""WITH RECURSIVE rows AS (SELECT owner_key, chunk_id, regexp_replace(text, {_TRIM}) AS text, locator, row_number() OVER (PARTITION BY owner_key ORDER BY para_index NULLS FIRST, part_index NULLS FIRST, chunk_id) AS i, count(*) OVER (PARTITION BY owner_key) AS n
  FROM @rows@ WHERE owner_key IS NOT NULL AND text IS NOT NULL AND (chunk_id LIKE '%:html:%' OR chunk_id LIKE '%:note:%') AND length(regexp_replace(text, {_TRIM})) >= 40),
fold AS (SELECT owner_key, i, n, chunk_id, text, locator AS locator_end, 1 AS m, []::STRUCT(chunk_id VARCHAR, text VARCHAR, locator_end VARCHAR, m INT)[] AS done FROM rows WHERE i = 1
  UNION ALL SELECT f.owner_key, r.i, f.n, CASE WHEN fits THEN f.chunk_id ELSE r.chunk_id END, CASE WHEN fits THEN f.text || chr(10) || chr(10) || r.text ELSE r.text END, CASE WHEN fits THEN coalesce(nullif(r.locator, ''), f.locator_end) ELSE r.locator END, CASE WHEN fits THEN f.m + 1 ELSE 1 END,
    CASE WHEN fits THEN f.done ELSE list_append(f.done, {{'chunk_id': f.chunk_id, 'text': f.text, 'locator_end': f.locator_end, 'm': f.m}}) END
  FROM (SELECT f.*, r.chunk_id AS rid, length(f.text) < @least@ AND length(f.text) + 2 + length(r.text) <= 1200 AS fits FROM fold f JOIN rows r ON f.owner_key = r.owner_key AND r.i = f.i + 1) f JOIN rows r ON f.owner_key = r.owner_key AND r.i = f.i + 1),
ended AS (SELECT *, len(done) > 0 AND length(text) < @least@ AND length(done[-1].text) + 2 + length(text) <= 1200 AS joins FROM fold WHERE i = n),
out AS (SELECT owner_key, unnest(CASE WHEN joins THEN list_append(done[:-2], {{'chunk_id': done[-1].chunk_id, 'text': done[-1].text || chr(10) || chr(10) || text, 'locator_end': coalesce(nullif(locator_end, ''), done[-1].locator_end), 'm': done[-1].m + 1}}) ELSE list_append(done, {{'chunk_id': chunk_id, 'text': text, 'locator_end': locator_end, 'm': m}}) END) AS c FROM ended)
SELECT owner_key AS @owner@, c.chunk_id AS chunk_id, md5(c.text) AS digest, CASE WHEN c.m > 1 THEN TRUE END AS merged, CASE WHEN c.m > 1 THEN c.m END AS merge_count, CASE WHEN c.m > 1 THEN c.locator_end END AS locator_end@more@ FROM out"""
_ORDERS = "(SELECT 'O' || l_orderkey AS owner_key, 'O' || l_orderkey || ':html:para' || i || ':part0' AS chunk_id, text, 'html:para' || i AS locator, i AS para_index, 0 AS part_index FROM (SELECT l_orderkey, text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, text) - 1 AS i FROM (SELECT l_orderkey, l_linenumber, 'Order ' || l_orderkey || ' line ' || l_linenumber || ' with part ' || l_partkey || ' of supplier ' || l_suppkey || ' in state ' || l_returnflag || l_linestatus || CASE WHEN l_partkey % 3 = 0 THEN repeat(' as agreed', 30) ELSE '' END AS text FROM lineitem)))"
_LIBRARY = f"(SELECT c.*, e.embedding AS vec FROM {_CHUNKS} c JOIN embeddings e ON e.vec_id = (coalesce(length(c.text), 0) + 31 * coalesce(c.para_index, 0)) % 500)"
_RANKED = f"(SELECT * FROM (SELECT q, chunk_id, distance, row_number() OVER (PARTITION BY q ORDER BY distance, chunk_id) AS rank FROM (SELECT v.vec_id AS q, c.chunk_id, round(1 - list_cosine_similarity(v.embedding::DOUBLE[], c.vec::DOUBLE[]), 12) AS distance FROM embeddings v, {_LIBRARY} c WHERE v.vec_id IN (5, 105, 205) AND @where@)) WHERE rank <= @n@)"
_BEST = f"(SELECT chunk_id, min(distance) AS distance, sum(1.0::DOUBLE / (60 + rank)) AS score, min(q) AS first_q, arg_min(rank, q) AS first_rank FROM {_RANKED} GROUP BY chunk_id)"
_TOP = f"(SELECT b.*, c.* EXCLUDE chunk_id FROM {_BEST} b JOIN {_CHUNKS} c ON b.chunk_id = c.chunk_id WHERE length(regexp_replace(text, {_TRIM})) >= 200 @but@ ORDER BY round(score, 12) DESC, first_q, first_rank LIMIT @k@)"
_SHOW = f"SELECT chunk_id AS id, round(distance, 6) AS distance, round(score, 9) AS rrf_score, {_CITE} AS citation, md5(text) AS digest, @around@ AS around, itemKey, locator FROM {_TOP} h"
_BESIDE = f"coalesce((SELECT string_agg(c.chunk_id, ' ' ORDER BY regexp_extract(c.chunk_id, ':para([0-9]+):', 1)::INT, c.chunk_id) FROM {_CHUNKS} c WHERE regexp_matches(h.chunk_id, '^[^:]*:(p[0-9]+|html|epub|note):para[0-9]+:part[0-9]+$') AND c.chunk_id LIKE '%:part0' AND regexp_extract(h.chunk_id, '^([^:]*:[^:]*:para)', 1) = regexp_extract(c.chunk_id, '^([^:]*:[^:]*:para)', 1) AND abs(regexp_extract(h.chunk_id, ':para([0-9]+):', 1)::INT - regexp_extract(c.chunk_id, ':para([0-9]+):', 1)::INT) <= 1 AND regexp_replace(coalesce(c.text, ''), {_TRIM}) <> ''), '')"
_NO_NOTES = "c.source_type IS DISTINCT FROM 'note'"
_HEADED = "(SELECT 'D' || (event_id % 97) AS attachmentKey, event_id AS page, CASE WHEN event_id % 3 > 0 THEN 'Annals of volume ' || (event_id % 97) ELSE 'Annals of volume ' || (event_id % 97) || ' - page ' || event_id END AS head, 'user ' || user_id AS person, event_type FROM events)"
_HEAD_LINES = f"(SELECT attachmentKey, page, head AS line FROM {_HEADED} UNION SELECT attachmentKey, page, person FROM {_HEADED} UNION SELECT attachmentKey, page, event_type FROM {_HEADED})"
_DEFAULT_LINES = f"(SELECT attachmentKey, line, count(DISTINCT page) AS n, any_value(pages) AS pages FROM {_HEAD_LINES} JOIN (SELECT attachmentKey, count(*) AS pages FROM {_HEADED} GROUP BY 1) USING (attachmentKey) WHERE length(line) <= 180 GROUP BY ALL HAVING any_value(pages) > 3 AND count(DISTINCT page) >= greatest(4, floor(any_value(pages) * 0.25)))"

SQL = {
    "knn_topk": f"SELECT q, rank, vec_id, round(distance, 6) AS distance FROM {_HITS.format(n=25)}",
    "rrf_passages": f"{_FUSE.format(key='vec_id')}, min(q) AS first_q, arg_min(rank, q) AS first_rank FROM {_HITS.format(n=25)} GROUP BY vec_id",
    "rrf_items": f"{_FUSE.format(key='label')}, arg_min(vec_id, q * 1000 + rank) AS first_vec FROM {_HITS.format(n=100)} GROUP BY label",
    "exclude_and_include": "SELECT vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score FROM (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12), b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.label IN (1, 3, 5)) WHERE rank <= 27 AND vec_id NOT IN (100, 200) GROUP BY vec_id",
    "search_where": f"SELECT chunk_id, source_type, year, page FROM {_CHUNKS} WHERE source_type IN ('pdf', 'html') AND (coalesce(year >= 1990, FALSE) OR itemKey IS NULL) AND page IS DISTINCT FROM 3",
    "note_exclusion": f"SELECT chunk_id, source_type, year FROM {_CHUNKS} WHERE year < 2000 AND source_type IS DISTINCT FROM 'note'",
    "asks_for_notes": f"SELECT chunk_id, source_type FROM {_CHUNKS} WHERE source_type = 'note' OR itemKey IS NULL",
    "item_keys": f"SELECT chunk_id, itemKey FROM {_CHUNKS} WHERE itemKey IN (SELECT DISTINCT item_key FROM documents WHERE doc_id % 50 = 0 AND item_key IS NOT NULL) AND year >= 1950 AND source_type IS DISTINCT FROM 'note'",
    "min_return_chars": f"SELECT chunk_id, source_type, length(text) AS chars FROM {_CHUNKS} WHERE length(regexp_replace(text, {_TRIM})) >= 200",
    "rag_search": _fill(_SHOW, where=f"c.year >= 1900 AND {_NO_NOTES}", n=100, but="", k=20, around=_BESIDE),
    "rag_search_excluding": _fill(_SHOW, where="TRUE", n=103, but=f"AND b.chunk_id NOT IN (SELECT chunk_id FROM {_fill(_TOP, where='TRUE', n=15, but='', k=3)})", k=20, around="''"),
    "search_items": f"SELECT itemKey, arg_min(title, q * 1000 + rank) AS title, arg_min(year, q * 1000 + rank) AS year, arg_min(creators, q * 1000 + rank) AS creators, round(min(distance), 6) AS distance, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score FROM {_fill(_RANKED, where=f"c.source_type IS DISTINCT FROM 'epub' AND {_NO_NOTES}", n=100)} JOIN {_CHUNKS} USING (chunk_id) WHERE coalesce(itemKey, '') <> '' GROUP BY itemKey ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, min(q * 1000 + rank) LIMIT 10",
    "get_chunk_context": f"SELECT h.chunk_id, count(a.id) AS n, md5(coalesce(string_agg(a.id || '|' || a.citation || '|' || a.text, chr(10) ORDER BY a.para, a.id), '')) AS digest FROM (SELECT chunk_id FROM {_CHUNKS} WHERE chunk_id LIKE '%:para0:part0') h LEFT JOIN (SELECT chunk_id AS id, regexp_extract(chunk_id, '^([^:]*:[^:]*:para)', 1) AS base, regexp_extract(chunk_id, ':para([0-9]+):', 1)::INT AS para, {_CITE} AS citation, text FROM {_CHUNKS} WHERE chunk_id LIKE '%:part0' AND regexp_replace(coalesce(text, ''), {_TRIM}) <> '') a ON a.base = regexp_extract(h.chunk_id, '^([^:]*:[^:]*:para)', 1) AND a.para <= 3 GROUP BY h.chunk_id",
    "split_long": _SPLIT,
    "merge_short": _fill(_FOLD, rows=_CHUNKS, least=500, owner="owner_key", more=""),
    "assembled": _fill(_FOLD, rows=_ORDERS, least=200, owner="owner", more=", regexp_extract(c.chunk_id, ':para([0-9]+):', 1)::INT AS para_index, 0 AS part_index, 'html:para' || regexp_extract(c.chunk_id, ':para([0-9]+):', 1) AS locator"),
    "duplicate_ids": "SELECT chunk_id, count(*) AS n FROM chunks GROUP BY chunk_id HAVING count(*) > 1",
    "language_choice": f"SELECT doc_id, c >= 0.2 AND l <= 0.4 AS no_space, CASE WHEN whole_c >= 0.2 AND whole_l <= 0.4 THEN 0 ELSE 1 END::BIGINT AS joiner, CASE WHEN c >= 0.2 AND l <= 0.4 THEN 120 ELSE 200 END::BIGINT AS least FROM (SELECT doc_id, {_CJK} AS c, {_LATIN} AS l FROM (SELECT doc_id, substr(regexp_replace(text, {_TRIM}), 1, 20000) AS text FROM documents WHERE text IS NOT NULL)) JOIN (SELECT doc_id, {_CJK} AS whole_c, {_LATIN} AS whole_l FROM documents WHERE text IS NOT NULL) USING (doc_id)",
    "note_records": "SELECT 'N' || c_custkey AS noteKey, CASE WHEN c_custkey % 3 > 0 THEN 'C' || c_custkey END AS parentItemKey, '<p>on ' || c_name || '</p>' AS note_html, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS title, CASE WHEN c_custkey % 3 > 0 THEN (1990 + c_nationkey)::INT END AS year, CASE WHEN c_custkey % 3 > 0 THEN c_name || ', ' || c_mktsegment END AS creators, c_nationkey AS version FROM customer",
    "chunk_base": "SELECT DISTINCT parentItemKey AS itemKey, attachmentKey, NULL::VARCHAR AS noteKey, title, year, nullif(array_to_string(list_filter(creators, lambda x: x IS NOT NULL AND trim(x) <> ''), '; '), '') AS creators, contentType, filename, pdf_path AS path, pdf_path, source_type FROM attachments",
    "item_details": "SELECT 'C' || c_custkey AS key, 'book' AS item_type, c_name AS title, (1990 + c_nationkey) || '-05' AS date FROM customer WHERE c_custkey = 7",
    "resolve_paths": "SELECT attachmentKey, arg_min(candidate, rank) AS pdf_path FROM (SELECT attachmentKey, 0 AS rank, pdf_path AS candidate FROM attachments WHERE pdf_path LIKE '/%' UNION SELECT attachmentKey, 1, '/data/library/storage/' || attachmentKey || '/' || substr(pdf_path, 9) FROM attachments WHERE pdf_path LIKE 'storage:%' UNION SELECT attachmentKey, 2, '/data/library/storage/' || attachmentKey || '/' || filename FROM attachments WHERE coalesce(filename, '') <> '') WHERE candidate IN (SELECT path FROM file_listing) GROUP BY attachmentKey",
    "snapshot_files": "SELECT folder, folder || '/' || name AS path FROM (SELECT '/storage/S' || (p_partkey // 5) AS folder, CASE WHEN p_partkey % 11 = 0 THEN 'Index.HTML' WHEN p_partkey % 7 = 0 THEN 'index.htm' WHEN p_partkey % 2 = 0 THEN 'page' || p_partkey || '.html' ELSE 'scan' || p_partkey || '.pdf' END AS name FROM part) WHERE regexp_matches(lower(name), '[.]html?$') QUALIFY row_number() OVER (PARTITION BY folder ORDER BY CASE lower(name) WHEN 'index.html' THEN 0 WHEN 'index.htm' THEN 1 ELSE 2 END, name) = 1",
    "upsert": f"SELECT chunk_id, text FROM {_CHUNKS} WHERE chunk_id NOT IN (SELECT attachmentKey || ':html:para0:part0' FROM attachments WHERE attachmentKey IS NOT NULL) UNION ALL SELECT DISTINCT attachmentKey || ':html:para0:part0', 'new ' || attachmentKey FROM attachments WHERE attachmentKey IS NOT NULL",
    "repeated_lines_default": f"SELECT attachmentKey, line, n FROM {_DEFAULT_LINES}",
    "without_noise": f"SELECT attachmentKey, page, len(p) AS n, md5(array_to_string(p, '¶')) AS digest FROM (SELECT attachmentKey, page, CASE WHEN len(q) = 0 OR prefix IS NULL OR NOT starts_with(q[1], prefix) THEN q WHEN regexp_replace(substr(q[1], length(prefix) + 1), '^[ \\-–—:：\t]+', '') = '' THEN q[2:] ELSE list_prepend(regexp_replace(substr(q[1], length(prefix) + 1), '^[ \\-–—:：\t]+', ''), q[2:]) END AS p FROM (SELECT h.attachmentKey, h.page, list_filter([h.head, h.person, h.event_type], lambda x: NOT list_contains(coalesce(l.lines, []), x)) AS q, x.prefix FROM {_HEADED} h LEFT JOIN (SELECT attachmentKey, list(line) AS lines FROM {_DEFAULT_LINES} GROUP BY 1) l USING (attachmentKey) LEFT JOIN (SELECT attachmentKey, head AS prefix FROM {_HEADED} JOIN (SELECT attachmentKey, count(*) AS pages FROM {_HEADED} GROUP BY 1) USING (attachmentKey) GROUP BY attachmentKey, head HAVING length(head) BETWEEN 5 AND 40 AND count(*) >= greatest(4, floor(0.25 * any_value(pages)))) x USING (attachmentKey)))",
    "merge_blocks": """WITH b AS (SELECT 'O' || l_orderkey AS attachmentKey, l_linenumber AS no, l_linenumber * 30.0 + CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 12.0 END AS y0, l_linenumber * 30.0 + 22.0 AS y1, 'line ' || l_linenumber || ' hyphen' AS t FROM lineitem WHERE l_quantity >= 5),
g AS (SELECT *, CASE WHEN y0 - lag(y1) OVER w BETWEEN 0 AND 12 THEN 0 ELSE 1 END AS starts FROM b WINDOW w AS (PARTITION BY attachmentKey ORDER BY y0, no, t)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY attachmentKey ORDER BY y0, no, t ROWS UNBOUNDED PRECEDING) AS para FROM g),
p AS (SELECT attachmentKey, para, string_agg(t, ' ' ORDER BY y0, no) AS t FROM s GROUP BY ALL)
SELECT attachmentKey, count(*) AS n, string_agg(t, '¶' ORDER BY para) AS paras FROM p GROUP BY attachmentKey""",
    "chunk_id_parse": rf"SELECT chunk_id, CASE WHEN ok THEN regexp_extract(chunk_id, '^([^:]*):', 1) END AS owner_key, CASE WHEN ok THEN CASE WHEN kind LIKE 'p%' THEN 'pdf' ELSE kind END END AS source_type, CASE WHEN ok THEN try_cast(regexp_extract(kind, '^p([0-9]+)$', 1) AS INT) END AS page, CASE WHEN ok THEN regexp_extract(chunk_id, ':para([0-9]+):', 1)::INT END AS para_index, CASE WHEN ok THEN regexp_extract(chunk_id, ':part([0-9]+)$', 1)::INT END AS part_index FROM (SELECT chunk_id, regexp_extract(chunk_id, '^[^:]*:([^:]*):', 1) AS kind, regexp_matches(chunk_id, '^[^:]*:(p[0-9]+|html|epub|note):para[0-9]+:part[0-9]+$') AS ok FROM {_CHUNKS})",
    "citation": f"SELECT chunk_id, {_CITE} AS citation FROM {_CHUNKS}",
    "context_window": f"SELECT hit, id, regexp_extract(id, ':para([0-9]+):', 1)::INT AS para_index FROM {_AROUND}",
    "context_text": f"SELECT hit, length(s) AS chars, md5(s) AS digest, n FROM (SELECT hit, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY regexp_extract(id, ':para([0-9]+):', 1)::INT, id) AS s, count(*) AS n FROM {_AROUND} GROUP BY hit)",
    "recent_items": "SELECT event_id, event_type FROM (SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 200) WHERE event_type <> 'click'",
    "creators_join": "SELECT DISTINCT attachmentKey, nullif(array_to_string(list_filter(creators, lambda x: x IS NOT NULL AND trim(x) <> ''), '; '), '') AS creators, seen_at FROM attachments",
    "source_type_of": "SELECT DISTINCT contentType, filename, pdf_path, source_type, CASE WHEN contentType = 'application/pdf' OR lower(filename) LIKE '%.pdf' THEN 'pdf' WHEN contentType IN ('text/html', 'application/xhtml+xml') OR lower(filename) LIKE '%.html' OR lower(filename) LIKE '%.htm' THEN 'html' WHEN contentType = 'application/epub+zip' OR lower(filename) LIKE '%.epub' THEN 'epub' END AS listed, CASE WHEN contentType = 'application/epub+zip' OR lower(pdf_path) LIKE '%.epub' THEN 'epub' WHEN lower(pdf_path) LIKE '%.html' OR lower(pdf_path) LIKE '%.htm' THEN 'html' ELSE coalesce(lower(source_type), 'pdf') END AS indexed FROM attachments",
    "year_prefix": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE year(o_orderdate)::INT END AS year, count(*) AS n FROM orders GROUP BY 1",
    "normalized_attachments": "SELECT 'O' || o_orderkey AS attachmentKey, CASE WHEN o_orderkey % 5 > 0 THEN 'C' || o_custkey END AS parentItemKey, c_name AS title, (1990 + c_nationkey)::INT AS year, c_name || ', ' || c_mktsegment AS creators, CASE WHEN o_orderstatus = 'O' THEN 'pdf' ELSE 'html' END AS source_type FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_orderkey % 5 > 0 WHERE (o_orderstatus = 'O' OR o_orderkey % 2 = 0) AND (o_orderkey % 5 = 0 OR c_mktsegment = 'BUILDING')",
    "dedupe_last": "SELECT attachmentKey, max(size) FILTER (seen_at IS NOT DISTINCT FROM last) AS size, last AS seen_at, min(seen_at) AS first_seen FROM (SELECT *, max(seen_at) OVER (PARTITION BY attachmentKey) AS last FROM file_listing WHERE attachmentKey IS NOT NULL) GROUP BY attachmentKey, last",
    "stale_keys": f"SELECT attachmentKey FROM {_ACTIONS} WHERE action = 'delete'",
    "index_plan": f"SELECT attachmentKey, action FROM {_ACTIONS}",
    "index_counters": f"SELECT 'file' AS source_type, action, count(*) AS n FROM {_ACTIONS} GROUP BY action",
    "replace_owner": f"SELECT chunk_id, owner_key, text FROM {_CHUNKS} WHERE owner_key IS NULL OR owner_key NOT IN (SELECT attachmentKey FROM {_ACTIONS} WHERE action <> 'skip') UNION ALL SELECT attachmentKey || ':html:para0:part0', attachmentKey, 'new text of ' || attachmentKey FROM {_ACTIONS} WHERE action = 'update'",
    "collection_replace": f"SELECT chunk_id, owner_key, text FROM {_CHUNKS} WHERE owner_key IS NULL OR owner_key NOT IN (SELECT attachmentKey FROM {_ACTIONS} WHERE action <> 'skip') UNION ALL SELECT attachmentKey || ':html:para0:part0', attachmentKey, 'new text of ' || attachmentKey FROM {_ACTIONS} WHERE action = 'update'",
    "control_clean": r"SELECT doc_id, length(s) AS chars, md5(s) AS digest FROM (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS s FROM documents WHERE text IS NOT NULL)",
    "language_ratios": f"SELECT doc_id, round({_LATIN}, 6) AS latin, round({_CJK}, 6) AS cjk, ({_CJK} >= 0.2 AND {_LATIN} <= 0.4) AS no_space, CASE WHEN {_CJK} >= 0.2 AND {_LATIN} <= 0.4 THEN 60 ELSE 80 END::BIGINT AS overlap FROM documents WHERE text IS NOT NULL",
    "gibberish": rf"SELECT doc_id, coalesce(length(s) >= 50 AND (length(regexp_replace(s, '[\p{{C}}\p{{Z}}]', '', 'g')) / greatest(length(s), 1) < 0.9 OR length(regexp_replace(s, '[^\p{{L}}\p{{Nd}}]', '', 'g')) / greatest(length(s), 1) < 0.2), FALSE) AS gibberish FROM (SELECT doc_id, {_SOLID} AS s FROM documents)",
    "sentence_split": f"SELECT doc_id, md5(piece) AS digest, length(piece) AS chars FROM (SELECT doc_id, unnest({_fill(_SENTENCES, c='text')}) AS piece FROM documents) WHERE piece <> ''",
    "paragraphs": rf"SELECT chunk_id, len(p) AS n, md5(array_to_string(p, '¶')) AS digest FROM (SELECT chunk_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '\r\n|[\r\x0B\x0C\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '\n(?:{_GAP}*\n)+'), lambda x: regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(x, {_TRIM}), '-{_GAP}*\n{_ANY}*', '', 'g'), '{_GAP}*\n{_ANY}*', chr(10), 'g'), chr(10), ' '), '{_ANY}+', ' ', 'g'), {_TRIM})), lambda x: x <> '') AS p FROM (SELECT DISTINCT chunk_id, text FROM chunks))",
    "html_strip": r"SELECT DISTINCT noteKey, version, md5(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(note_html, '(?is)<script.*?>.*?</script>|<style.*?>.*?</style>', '', 'g'), '</p>', chr(10) || chr(10)), '<br>', chr(10)), '<br/>', chr(10)), '<br />', chr(10)), '<[^>]*>', ' ', 'g'), '<[^>]*$', '')) AS digest FROM (SELECT DISTINCT noteKey, version, note_html FROM notes WHERE note_html IS NOT NULL)",
    "repeated_prefixes": f"SELECT h.attachmentKey, h.prefix, h.n FROM (SELECT attachmentKey, prefix, count(*) AS n FROM (SELECT attachmentKey, page, trim(substr(arg_min(line, chunk_id), 1, 40)) AS prefix FROM (SELECT attachmentKey, page, chunk_id, regexp_replace(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '{_ANY}+', ' ', 'g') AS line FROM {_PAGES}) WHERE line IS NOT NULL GROUP BY attachmentKey, page) WHERE length(prefix) BETWEEN 5 AND 40 GROUP BY ALL) h JOIN (SELECT attachmentKey, count(DISTINCT page) AS pages FROM {_LINES} GROUP BY attachmentKey) p ON h.attachmentKey = p.attachmentKey WHERE pages > 3 AND h.n >= greatest(2, floor(pages * 0.05))",
    "repeated_lines": f"SELECT l.attachmentKey, l.line, l.n FROM (SELECT attachmentKey, line, count(DISTINCT page) AS n FROM {_LINES} WHERE length(line) <= 180 GROUP BY ALL) l JOIN (SELECT attachmentKey, count(DISTINCT page) AS pages FROM {_LINES} GROUP BY attachmentKey) p ON l.attachmentKey = p.attachmentKey WHERE pages > 3 AND n >= greatest(2, floor(pages * 0.05))",
}
