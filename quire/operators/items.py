"""Bibliographic items: unwrapping, metadata of the parent, source types, collections, recent items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import creators_text, once, strip, year_of
from quire.schemas import ITEM_DATA, ITEM_FIELDS

#: The payload's fields at the top, for flat items, and nested under ``data``.
_RAW = f"{ITEM_DATA[:-1]}, data: {ITEM_DATA}>"
_FIELDS = ITEM_FIELDS


def unwrap(raw: DataFrame, column: str = "json") -> DataFrame:
    """(key, data) of items given as JSON texts, the payload nested under ``data`` or flat.

    Records without a key, and texts that are no JSON objects, are dropped."""
    # one parse of either form, once a row
    parsed = raw.withColumn("__n", once(F.from_json(column, _RAW)))
    flat = F.struct(*(F.col(f"__n.{f}").alias(f) for f in _FIELDS))
    data = F.when(F.col("__n.data").isNotNull(), F.col("__n.data")).otherwise(flat)
    out = parsed.withColumn("data", data).withColumn("key", F.coalesce(F.nullif(F.col("__n.key"), F.lit("")), F.col("__n.data.key"))).withColumn("version", F.coalesce(F.col("__n.version"), F.col("__n.data.version")))
    return out.where(F.coalesce("key", F.lit("")) != "").select("key", "version", "data", *(c for c in raw.columns if c not in (column, "key", "data", "version")))


def dedupe_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the values of its last row, and ``first_seen``, the place of its first.

    Aggregated partly before the shuffle; equal places (a tie) give the greatest row."""
    others = [c for c in df.columns if c != key]
    comparable = [c for c in others if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    last = F.max_by(F.struct(*others), F.struct(order, *(c for c in comparable if c != order)))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("__row"), F.min(order).alias("first_seen")).select(key, "__row.*", "first_seen")


def creator_names(creators: Column) -> Column:
    """``Last, First`` of each creator with either; single-field names give nothing; null for none."""
    name = lambda c: F.regexp_replace(F.concat(strip(F.coalesce(c["lastName"], F.lit(""))), F.lit(", "), strip(F.coalesce(c["firstName"], F.lit("")))), r"^[, ]+|[, ]+$", "")
    kept = F.filter(F.transform(creators, name), lambda n: n != "")
    return F.when(F.size(kept) > 0, kept)


def parent_meta(items: DataFrame) -> DataFrame:
    """(parentItemKey, title, year, creators, collections) of unwrapped items."""
    return items.select(F.col("key").alias("parentItemKey"), F.col("data.title").alias("title"), year_of(F.col("data.date")).alias("year"), creator_names(F.col("data.creators")).alias("creators"), F.col("data.collections").alias("collections"))


def source_type(content_type: Column, filename: Column) -> Column:
    """pdf before html before epub, by content type or suffix; null for anything else."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    kind = F.coalesce(content_type, F.lit(""))
    return F.when((kind == "application/pdf") | name.endswith(".pdf"), "pdf").when(kind.isin("text/html", "application/xhtml+xml") | name.endswith(".html") | name.endswith(".htm"), "html").when((kind == "application/epub+zip") | name.endswith(".epub"), "epub")


def indexed_source_type(content_type: Column, path: Column, declared: Column) -> Column:
    """As the indexer derives it once the file is resolved: epub, then html by suffix, then as declared, else pdf."""
    name = F.lower(F.coalesce(path, F.lit("")))
    return F.when((F.coalesce(content_type, F.lit("")) == "application/epub+zip") | name.endswith(".epub"), "epub").when(name.endswith(".html") | name.endswith(".htm"), "html").otherwise(F.coalesce(F.lower(declared), F.lit("pdf")))


def with_parent(children: DataFrame, parents: DataFrame, key: str = "parentItemKey", collection: str | None = None) -> DataFrame:
    """Children with the metadata of their parent, null without one; of a collection, those whose parent is
    in it, and those without a parent.  Both sides are sorted and merged: Spark's guess at the size of parsed
    items is so far too low (171 KB for 27 MB) that it would broadcast parents which the driver can't hold."""
    out = children.join(parents.hint("merge"), key, "left")
    if collection is not None:
        out = out.where(F.col(key).isNull() | F.coalesce(F.array_contains("collections", collection), F.lit(False)))
    return out.drop("collections")


def normalized_attachments(items: DataFrame, paths: DataFrame | None = None, collection: str | None = None) -> DataFrame:
    """Attachment records of unwrapped items, with their parents' metadata and resolved paths (attachmentKey, pdf_path)."""
    data = F.col("data")
    kept = items.where(data["itemType"] == "attachment").select(F.col("key").alias("attachmentKey"), F.nullif(data["parentItem"], F.lit("")).alias("parentItemKey"), source_type(data["contentType"], data["filename"]).alias("source_type"), data["contentType"].alias("contentType"), F.coalesce(data["filename"], F.lit("")).alias("filename"))
    out = with_parent(kept.where("source_type IS NOT NULL"), parent_meta(items), collection=collection)
    out = out.join(paths, "attachmentKey") if paths is not None else out.withColumn("pdf_path", F.lit(None).cast("string"))
    return out.select("attachmentKey", "parentItemKey", "title", "year", "creators", "pdf_path", "source_type", "contentType", "filename")


def note_records(items: DataFrame, collection: str | None = None) -> DataFrame:
    data = F.col("data")
    kept = items.where(data["itemType"] == "note").select(F.col("key").alias("noteKey"), F.nullif(data["parentItem"], F.lit("")).alias("parentItemKey"), F.coalesce(data["note"], F.lit("")).alias("note_html"), F.coalesce("version", data["version"]).alias("version"))
    return with_parent(kept, parent_meta(items), collection=collection).select("noteKey", "parentItemKey", "note_html", "title", "year", "creators", "version")


def recent(items: DataFrame, limit: int = 20, *, order: str = "dateModified", kind: str = "itemType", key: str = "key") -> DataFrame:
    """The last ``limit`` items by modification, of which attachments are then dropped, so fewer may remain."""
    return items.orderBy(F.desc_nulls_last(order), key).limit(limit).where(F.coalesce(kind, F.lit("")) != "attachment")


def chunk_base(attachments: DataFrame) -> DataFrame:
    """The metadata columns that every chunk of an attachment carries."""
    return attachments.select(F.col("parentItemKey").alias("itemKey"), "attachmentKey", F.lit(None).cast("string").alias("noteKey"), "title", "year", creators_text(F.col("creators")).alias("creators"), "contentType", "filename", F.col("pdf_path").alias("path"), "pdf_path", "source_type")


def citation(title: Column, year: Column, page: Column, page_label: Column) -> Column:
    """``title (year) p.X``, as much of it as is there; X is the label, else the page; nothing without a title."""
    label = strip(F.coalesce(page_label, F.lit("")))
    shown = F.when(label != "", label).otherwise(page.cast("string"))
    has_year, name = F.coalesce(year, F.lit(0)) != 0, F.coalesce(title, F.lit(""))
    dated = F.concat(name, F.lit(" ("), year, F.lit(")"))
    paged = F.concat(F.when(has_year, dated).otherwise(name), F.lit(" p."), shown)
    return F.when(name == "", "").when(shown.isNotNull(), paged).when(has_year, dated).otherwise(name)
