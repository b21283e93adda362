"""Fixed schemas of the engine's tables, as DDL: workers import them without a session."""

ITEM_DATA = (
    "STRUCT<key: STRING, itemType: STRING, title: STRING, date: STRING, dateModified: STRING, creators: ARRAY<STRUCT<lastName: STRING, firstName: STRING, name: STRING>>, "
    "collections: ARRAY<STRING>, parentItem: STRING, contentType: STRING, filename: STRING, path: STRING, note: STRING, version: INT>"
)
ITEM_FIELDS = ["key", "itemType", "title", "date", "dateModified", "creators", "collections", "parentItem", "contentType", "filename", "path", "note", "version"]
ATTACHMENTS = "attachmentKey STRING NOT NULL, parentItemKey STRING, title STRING, year INT, creators ARRAY<STRING>, pdf_path STRING, source_type STRING, contentType STRING, filename STRING"
NOTES = "noteKey STRING NOT NULL, parentItemKey STRING, note_html STRING, title STRING, year INT, creators ARRAY<STRING>, version INT"
PDF_BLOCKS = "attachmentKey STRING, page_index INT, page_label STRING, block_no INT, x0 DOUBLE, y0 DOUBLE, y1 DOUBLE, block_type INT, text STRING"
CHUNKS = (
    "chunk_id STRING, owner_key STRING, text STRING, embedding ARRAY<FLOAT>, itemKey STRING, attachmentKey STRING, noteKey STRING, title STRING, year INT, creators STRING, source_type STRING, contentType STRING, filename STRING, "
    "path STRING, pdf_path STRING, page INT, page_label STRING, chapter_index INT, para_index INT, part_index INT, locator STRING, locator_end STRING, merged BOOLEAN, merge_count INT"
)
MANIFEST_FILES = "attachmentKey STRING, mtime DOUBLE, size BIGINT, pdf_path STRING"
MANIFEST_NOTES = "noteKey STRING, version INT"
