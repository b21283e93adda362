"""The engine's public face: indexing, searches, contexts and item lookups."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import DEFAULT, EngineConfig
from quire.functions.embedding import Embedder, embed, embedder_of
from quire.functions.text import Extractor
from quire.operators import chunking, context, incremental, index, items, search
from quire.operators.pdfnoise import without_noise
from quire.runtime import checkpointed
from quire.schemas import MANIFEST_FILES, MANIFEST_NOTES
from quire.sources import files


class Engine:
    """Over one collection of chunks and one library of items.

    ``items_raw`` (seq, json) is any DataFrame of items: the paged API source, a table, a file."""

    def __init__(self, spark: SparkSession, items_raw: DataFrame | None = None, embedder: Embedder | None = None, config: EngineConfig = DEFAULT, extractor: Extractor | None = None) -> None:
        self.spark, self.config, self.embedder, self.extractor = spark, config, embedder or embedder_of(config), extractor
        self.items_raw = items_raw
        self.collection = index.Collection(spark, config.index_dir, config.collection, self.embedder.dim)

    # --- items

    def items(self) -> DataFrame:
        """(key, data) of each item, the last of repeated ones."""
        if self.items_raw is None:
            raise ValueError("the engine was made without items")
        return items.dedupe_last(items.unwrap(self.items_raw), "key", "seq")

    def get_item_details(self, item_key: str) -> DataFrame:
        """The item; filtered before repeated ones are gathered, so a lookup is a scan without a shuffle of the library."""
        if self.items_raw is None:
            raise ValueError("the engine was made without items")
        one = items.unwrap(self.items_raw).where(F.col("key") == item_key)
        return items.dedupe_last(one, "key", "seq").select("key", "data")

    def list_recent_items(self, limit: int = 20) -> DataFrame:
        flat = self.items().select("key", F.col("data.itemType").alias("itemType"), F.col("data.title").alias("title"), F.col("data.creators").alias("creators"), F.col("data.date").alias("date"), F.col("data.dateModified").alias("dateModified"))
        return items.recent(flat, limit)

    def dump_attachments(self, paths: DataFrame | None = None, collection: str | None = None) -> DataFrame:
        return items.normalized_attachments(self.items(), paths, collection)

    # --- search

    def _queries(self, query: str | list[str]) -> DataFrame:
        texts = [query] if isinstance(query, str) else list(query)
        table = self.spark.createDataFrame(list(enumerate(texts)), "q int, text string")
        return table.select("q", embed(F.col("text"), self.embedder).alias("vec"))

    def rag_search(self, query: str | list[str], k: int = 5, where: dict | None = None, context_window: int = 0, include_notes: bool = False, include_item_keys: list[str] | None = None, exclude_chunk_ids: list[str] | None = None) -> DataFrame:
        return search.search_passages(self._queries(query), self.collection.read(), k, where, context_window, include_notes, include_item_keys, exclude_chunk_ids, config=self.config)

    def search_items(self, query: str | list[str], k: int = 10, where: dict | None = None, include_notes: bool = False, include_item_keys: list[str] | None = None) -> DataFrame:
        return search.search_items(self._queries(query), self.collection.read(), k, where, include_notes, include_item_keys, config=self.config)

    def get_chunk_context(self, chunk_id: str, window: int = 2) -> dict:
        """context_text, metadata of the chunk (else of the first found) and chunk_ids_included, or an error."""
        one = self.spark.createDataFrame([(chunk_id,)], "chunk_id string")
        if window <= 0 or one.select(context.parse_id(F.col("chunk_id"))).first()[0] is None:
            return {"error": f"invalid chunk id or window: {chunk_id}, {window}"}
        chunks = self.collection.near(one)
        found = context.context_texts(one, chunks, window, bounded=True).first()
        if not found or not found.chunk_ids_included:
            return {"error": f"nothing found around {chunk_id}"}
        at = chunk_id if chunk_id in found.chunk_ids_included else found.chunk_ids_included[0]
        meta = chunks.where(F.col("chunk_id") == at).drop("embedding", "text").first()
        return {"context_text": found.context_text, "metadata": meta.asDict(), "chunk_ids_included": list(found.chunk_ids_included)}

    # --- index

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        return chunks.withColumn("embedding", embed(F.col("text"), self.embedder))

    def html_chunks(self, attachments: DataFrame) -> DataFrame:
        """Chunks of attachments (metadata and ``html``)."""
        keep = ["itemKey", "attachmentKey", "title", "year", "creators", "contentType", "filename", "path", "pdf_path"]
        base = items.chunk_base(attachments.withColumn("source_type", F.lit("html"))).join(attachments.select("attachmentKey", "html"), "attachmentKey")
        return chunking.chunk_html(base, "attachmentKey", "html", keep, config=self.config, extractor=self.extractor).withColumn("owner_key", F.col("attachmentKey")).withColumn("source_type", F.lit("html"))

    def note_chunks(self, notes: DataFrame) -> DataFrame:
        """Chunks of notes (noteKey, parentItemKey, note_html, title, year, creators)."""
        base = notes.select(F.col("parentItemKey").alias("itemKey"), "noteKey", "title", "year", items.creators_text(F.col("creators")).alias("creators"), "note_html")
        out = chunking.chunk_notes(base, "noteKey", "note_html", ["itemKey", "noteKey", "title", "year", "creators"], config=self.config)
        return out.withColumn("owner_key", F.col("noteKey")).withColumn("source_type", F.lit("note"))

    def pdf_chunks(self, blocks: DataFrame, attachments: DataFrame) -> DataFrame:
        """Chunks of PDF attachments from their positional blocks; repeated lines and prefixes are taken out first."""
        pages = chunking.merge_blocks(blocks, config=self.config)
        c = self.config
        pages = without_noise(pages, "attachmentKey", "page_index", "paras", ratio=c.repeated_ratio, lines=c.drop_repeated_lines, prefixes=c.strip_repeated_prefix).withColumn("page", F.col("page_index") + 1)
        out = chunking.chunk_pages(pages, "attachmentKey", "page", "paras", ["attachmentKey", "page", "page_label"], config=c)
        meta = items.chunk_base(attachments).drop("noteKey", "source_type")
        return out.join(meta, "attachmentKey").withColumn("owner_key", F.col("attachmentKey")).withColumn("source_type", F.lit("pdf"))

    def epub_chunks(self, chapters: DataFrame, attachments: DataFrame) -> DataFrame:
        """Chunks of EPUB chapters (attachmentKey, chapter_index, html)."""
        out = chunking.chunk_epub(chapters.where("html IS NOT NULL"), "attachmentKey", ["attachmentKey"], config=self.config)
        meta = items.chunk_base(attachments).drop("noteKey", "source_type")
        return out.join(meta, "attachmentKey").withColumn("owner_key", F.col("attachmentKey")).withColumn("source_type", F.lit("epub"))

    def sync_notes(self, notes: DataFrame, manifest: DataFrame | None = None) -> dict:
        """Replaces the chunks of new and changed notes and drops those of notes that are gone.

        A changed note loses its old chunks even if nothing comes of it now.  A listing that failed must
        raise before this is called: an empty listing means that every note is gone.  Without a manifest that of the
        collection is used; the new one is committed with the chunks, and returned beside the counters."""
        manifest = self.collection.manifest("notes", MANIFEST_NOTES) if manifest is None else manifest
        plan = checkpointed(index.plan(notes, manifest, "noteKey", incremental.NOTE_STATE))
        todo = notes.join(plan.where("action = 'update'"), "noteKey", "left_semi")
        gone = plan.where("action <> 'skip'").select(F.col("noteKey").alias("owner_key"))
        entries = checkpointed(notes.select("noteKey", *incremental.NOTE_STATE))
        self.collection.replace(checkpointed(self._embedded(self.note_chunks(todo))), gone, manifests={"notes": entries})
        return {"counters": {r.action: r["count"] for r in plan.groupBy("action").count().collect()}, "manifest": entries}

    def sync_files(self, fresh: DataFrame, listing: DataFrame, manifest: DataFrame | None = None) -> dict:
        """Replaces the chunks of changed files by ``fresh`` (chunks without vectors) and drops stale ones.

        A file of which no chunk came is a failure: its old chunks and its manifest entry stay.  Manifests as in ``sync_notes``."""
        manifest = self.collection.manifest("files", MANIFEST_FILES) if manifest is None else manifest
        plan = checkpointed(index.plan(listing, manifest, "attachmentKey", incremental.FILE_STATE))
        changed = fresh.join(plan.where("action = 'update'"), "attachmentKey", "left_semi")
        new = checkpointed(self._embedded(changed))
        done = new.select("attachmentKey").distinct()
        gone = plan.where("action = 'delete'").select(F.col("attachmentKey").alias("owner_key"))
        failed = plan.where("action = 'update'").select("attachmentKey").join(done, "attachmentKey", "left_anti")
        kept = manifest.join(failed, "attachmentKey", "left_semi").select("attachmentKey", *incremental.FILE_STATE)
        entries = checkpointed(listing.join(failed, "attachmentKey", "left_anti").select("attachmentKey", *incremental.FILE_STATE).unionByName(kept))
        self.collection.replace(new, gone, manifests={"files": entries})
        return {"counters": {r.action: r["count"] for r in plan.groupBy("action").count().collect()} | {"failed": failed.count()}, "manifest": entries}

    def index_library(self, data_dir: str, collection: str | None = None) -> dict:
        """One run of the indexer: the library's attachments below ``data_dir/storage`` and its notes, new and changed ones only.

        Returns the counters of files and notes.  Files that cannot be read count as failed and come again."""
        there = files.listing(self.spark, f"{data_dir.rstrip('/')}/storage")
        library = checkpointed(self.items())
        shape = library.where("data.itemType = 'attachment'").select(F.col("key").alias("attachmentKey"), F.col("data.path").alias("path"), F.col("data.filename").alias("filename"))
        paths = files.resolve_paths(shape, there, data_dir)
        attachments = checkpointed(items.normalized_attachments(library, paths, collection))
        state = checkpointed(attachments.join(there.withColumnRenamed("path", "pdf_path"), "pdf_path").select("attachmentKey", *incremental.FILE_STATE))
        todo = incremental.changed(state, self.collection.manifest("files", MANIFEST_FILES), "attachmentKey", incremental.FILE_STATE)
        changed = checkpointed(attachments.join(todo.select("attachmentKey"), "attachmentKey", "left_semi").withColumn("source_type", items.indexed_source_type(F.col("contentType"), F.col("pdf_path"), F.col("source_type"))))
        content = files.contents(changed.select("attachmentKey", F.col("pdf_path").alias("path"), "source_type"))
        of = lambda kind: content.where(F.col("source_type") == kind)
        html = of("html").select("attachmentKey", files.html_of(F.col("content"), self.config).alias("html"))
        parts = [
            self.html_chunks(changed.where("source_type = 'html'").join(html, "attachmentKey")),
            self.epub_chunks(files.read_epubs(of("epub")), changed),
            self.pdf_chunks(files.read_pdfs(of("pdf"), config=self.config).where("error IS NULL").drop("error"), changed),
        ]
        fresh = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        done = self.sync_files(fresh, state)["counters"]
        return {"files": done, "notes": self.sync_notes(items.note_records(library, collection))["counters"]}

    def rebuild(self) -> None:
        self.collection.rebuild()


def response_json(hits: DataFrame) -> str:
    """{"results": [...]} of a search, as a transport would send it; k rows at most."""
    return json.dumps({"results": [r.asDict(recursive=True) for r in hits.collect()]}, ensure_ascii=False)
