"""Chunk ids and the paragraphs around a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.operators.items import citation

ID = r"^([^:]*):(p(\d+)|html|epub|note):para(\d+):part(\d+)$"


def parse_id(c: Column) -> Column:
    """struct(owner_key, source_type, page, para_index, part_index); null for anything but four well-formed fields."""
    kind = F.regexp_extract(c, ID, 2)
    number = lambda g: F.regexp_extract(c, ID, g).try_cast("int")
    fields = F.struct(F.regexp_extract(c, ID, 1).alias("owner_key"), F.when(kind.startswith("p"), "pdf").otherwise(kind).alias("source_type"), F.when(kind.startswith("p"), number(3)).alias("page"), number(4).alias("para_index"), number(5).alias("part_index"))
    return F.when(c.rlike(ID) & number(4).isNotNull() & number(5).isNotNull() & ((F.regexp_extract(c, ID, 3) == "") | number(3).isNotNull()), fields)


def neighbour_ids(c: Column, window: int) -> Column:
    """Ids of the first parts of the paragraphs around, of the same document and page; none for a bad id or window."""
    if window <= 0:
        return F.array().cast("array<string>")
    p = parse_id(c)
    base = F.regexp_extract(c, r"^([^:]*:[^:]*:para)\d+:part\d+$", 1)
    around = F.sequence(F.greatest(p["para_index"] - window, F.lit(0)), p["para_index"] + window)
    return F.when(p.isNull(), F.array().cast("array<string>")).otherwise(F.transform(around, lambda i: F.concat(base, i, F.lit(":part0"))))


def neighbours(hits: DataFrame, chunks: DataFrame, window: int, key: str = "chunk_id", *, bounded: bool = False) -> DataFrame:
    """(hit, id, para_index, page, citation, text) of what is there around each hit: an equi-join on enumerated ids,
    which are sent to the chunks where the caller knows their number to be ``bounded``."""
    wanted = hits.select(F.col(key).alias("hit")).distinct().select("hit", F.explode(neighbour_ids(F.col("hit"), window)).alias("chunk_id"))
    found = chunks.select("chunk_id", "text", "title", "year", "page", "page_label").join(F.broadcast(wanted) if bounded else wanted, "chunk_id")
    shown = citation(F.col("title"), F.col("year"), F.col("page"), F.col("page_label"))
    return found.select("hit", F.col("chunk_id").alias("id"), parse_id(F.col("chunk_id"))["para_index"].alias("para_index"), "page", shown.alias("citation"), "text")


_CONTEXT = "array<struct<id: string, page: int, citation: string, text: string>>"


def with_context(hits: DataFrame, chunks: DataFrame, window: int, key: str = "chunk_id", *, bounded: bool = False) -> DataFrame:
    """``context``: the neighbours with text, in order of paragraphs; empty for a window of 0."""
    if window <= 0:
        return hits.withColumn("context", F.array().cast(_CONTEXT))
    around = neighbours(hits, chunks, window, key, bounded=bounded).where(strip(F.coalesce("text", F.lit(""))) != "")
    per = around.groupBy("hit").agg(F.transform(F.array_sort(F.collect_list(F.struct("para_index", "id", "page", "citation", "text"))), lambda x: F.struct(x["id"].alias("id"), x["page"].alias("page"), x["citation"].alias("citation"), x["text"].alias("text"))).alias("context"))
    return hits.join(per.withColumnRenamed("hit", key), key, "left").withColumn("context", F.coalesce("context", F.array().cast(_CONTEXT)))


def context_texts(hits: DataFrame, chunks: DataFrame, window: int = 2, key: str = "chunk_id", *, bounded: bool = False) -> DataFrame:
    """(hit, context_text, chunk_ids_included): neighbouring texts joined by empty lines, in order of paragraphs."""
    per = neighbours(hits, chunks, window, key, bounded=bounded).groupBy("hit").agg(F.array_sort(F.collect_list(F.struct("para_index", "id", "text"))).alias("__c"))
    return per.select("hit", F.array_join(F.transform("__c", lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("context_text"), F.transform("__c", lambda x: x["id"]).alias("chunk_ids_included"))
