"""Documents to chunks: paragraphs, parts, short ones merged, with positional ids.

Paragraphs are expressions, parts and merges one pass of Arrow batches, all within a row (no shuffle); only repeated lines of PDF pages need a look at the
other pages of their document (``pdfnoise``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.config import DEFAULT, EngineConfig
from quire.functions import passages
from quire.functions import text as t
from quire.runtime import ship


def parts_of(c: Column, config: EngineConfig = DEFAULT) -> Column:
    """array<string>: the parts of a long text; null for null."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda text: passages.split_long(text, config), na_action="ignore")

    return run(c)


def assembled(df: DataFrame, owner: str, paras: str, kind: Column, sample: Column, keep: list[str], config: EngineConfig, chapters: str | None = None) -> DataFrame:
    """The chunks of the paragraphs in an array column: split, short ones merged, with positional ids.

    One pass of Arrow batches; only the columns of ``keep`` go along."""
    least = t.min_chunk_chars(sample, config)
    inputs = [F.col(owner).cast("string"), kind, least, F.col(paras), F.col(chapters) if chapters else F.lit(None).cast("array<int>")]

    def made(key: str | None, what: str, short: int, texts: list[str] | None, places: list[int] | None) -> list[passages.Chunk]:
        # a document without an owner has no ids, and so no chunks
        return passages.merge_short(passages.records(key, what, texts or [], places, config), short, config) if key is not None else []

    return _mapped(df, keep, inputs, made)


def _mapped(df: DataFrame, keep: list[str], inputs: list[Column], made: Callable[..., list[passages.Chunk]]) -> DataFrame:
    """A row for each chunk that ``made`` makes of the inputs of a row, with its columns ``keep``."""
    ship(df.sparkSession)
    schema = T.StructType([df.schema[k] for k in keep] + T.StructType.fromDDL(_OUT).fields)
    n, m = len(keep), len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            out: list[passages.Chunk] = []
            for i, values in enumerate(zip(*(batch.column(n + k).to_pylist() for k in range(m)))):
                found = made(*values)
                rows += [i] * len(found)
                out += found
            at = pa.array(rows, pa.int64())
            columns = list(zip(*out)) or [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in range(n)] + [pa.array(c, kind) for c, kind in zip(columns, _TYPES)], names=schema.names)

    return df.select(*keep, *(c.alias(f"__{i}") for i, c in enumerate(inputs))).mapInArrow(run, schema)


_OUT = "chunk_id string, text string, locator string, para_index int, part_index int, chapter_index int, merged boolean, merge_count int, locator_end string"
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string()]


def _sample(paras: Column) -> Column:
    return F.substring(F.array_join(F.slice(paras, 1, 20), "\n\n"), 1, 5000)


def chunk_text(df: DataFrame, owner: str, raw: str, kind: str, keep: list[str], *, config: EngineConfig = DEFAULT, whole_sample: bool = False) -> DataFrame:
    """Chunks of documents whose text is in ``raw`` (HTML snapshots, notes).

    A gibberish document gives none; the test reads the first paragraphs, or the whole text for notes.
    Null and blank texts give none."""
    return _mapped(df, keep, [F.col(owner).cast("string"), F.col(raw)], lambda key, text: passages.chunks_of(key, kind, text, whole_sample, config) if key is not None and text is not None else [])


def chunk_html(df: DataFrame, owner: str, raw: str, keep: list[str], *, config: EngineConfig = DEFAULT, extractor: t.Extractor | None = None) -> DataFrame:
    return chunk_text(df.withColumn("__text", t.main_text_of_html(F.col(raw), extractor)), owner, "__text", "html", keep, config=config)


def chunk_notes(df: DataFrame, owner: str, raw: str, keep: list[str], *, config: EngineConfig = DEFAULT) -> DataFrame:
    return chunk_text(df.withColumn("__text", t.text_of_html(F.col(raw))), owner, "__text", "note", keep, config=config, whole_sample=True)


def chunk_epub(chapters: DataFrame, owner: str, keep: list[str], *, chapter: str = "chapter_index", raw: str = "html", config: EngineConfig = DEFAULT) -> DataFrame:
    """Chunks of EPUB chapters; paragraphs count on across chapters.

    The chapters of one book are one group, bounded by the book."""
    df = chapters.withColumn("__clean", t.clean(t.text_of_html(F.col(raw))))
    df = df.withColumn("__paras", t.paragraphs(F.col("__clean"), t.joiner(F.substring("__clean", 1, t.SAMPLE_CHARS))))
    firsts = [F.first(c).alias(c) for c in keep if c != owner]
    books = df.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(F.col(chapter).alias("c"), F.col("__paras").alias("p")))).alias("__book"), *firsts)
    flat = F.flatten(F.transform("__book", lambda b: F.transform(F.coalesce(b["p"], F.array().cast("array<string>")), lambda p: F.struct(b["c"].alias("c"), p.alias("p")))))
    books = books.withColumn("__flat", flat).withColumn("__paras", F.transform("__flat", lambda x: x["p"])).withColumn("__sample", _sample(F.col("__paras")))
    books = books.where((F.size("__paras") > 0) & ~t.is_gibberish(F.col("__sample")))
    return assembled(books.withColumn("__of", F.transform("__flat", lambda x: x["c"].cast("int"))), owner, "__paras", F.lit("epub"), F.col("__sample"), keep, config, "__of")


def chunk_pages(pages: DataFrame, owner: str, page: str, paras: str, keep: list[str], *, config: EngineConfig = DEFAULT) -> DataFrame:
    """Chunks of PDF pages (one row per page, paragraphs in an array); a gibberish page gives none."""
    df = pages.withColumn("__sample", F.array_join(paras, "\n\n")).where((F.size(paras) > 0) & ~t.is_gibberish(F.col("__sample")))
    return assembled(df, owner, paras, F.concat(F.lit("p"), F.col(page)), F.col("__sample"), [*keep, page] if page not in keep else keep, config)


def merge_blocks(blocks: DataFrame, *, config: EngineConfig = DEFAULT) -> DataFrame:
    """(attachmentKey, page_index, page_label, paras) from positional text blocks.

    Text blocks in reading order; one that follows the lowest bottom so far within the gap joins its
    predecessor, one above it or further down starts a paragraph.  A page is one group, bounded by it."""
    texts = blocks.where(F.col("block_type") == 0).withColumn("__t", t.clean(F.col("text")))
    texts = texts.withColumn("__t", t.join_lines(t.one_newline(F.regexp_replace(F.col("__t"), r"(?U)\n(?:[^\S\n]*\n)+", "\n")), t.joiner(F.col("__t")))).where(F.col("__t") != "")
    ordered = texts.groupBy("attachmentKey", "page_index").agg(F.first("page_label").alias("page_label"), F.array_sort(F.collect_list(F.struct("y0", "x0", "block_no", "y1", F.col("__t").alias("t")))).alias("__b"))
    state = "struct<out: array<string>, cur: string, bottom: double>"
    start = F.struct(F.array().alias("out"), F.lit("").alias("cur"), F.lit(0.0).alias("bottom")).cast(state)

    def fold(acc: Column, b: Column) -> Column:
        gap = b["y0"] - acc["bottom"]
        both = F.concat(acc["cur"], b["t"])
        return (
            F.when(acc["cur"] == "", F.struct(acc["out"].alias("out"), b["t"].alias("cur"), b["y1"].alias("bottom")).cast(state))
            .when((gap >= 0) & (gap <= config.block_gap), F.struct(acc["out"].alias("out"), F.concat(acc["cur"], t.joiner(both), b["t"]).alias("cur"), F.greatest(acc["bottom"], b["y1"]).alias("bottom")).cast(state))
            .otherwise(F.struct(F.array_append(acc["out"], t.strip(acc["cur"])).alias("out"), b["t"].alias("cur"), b["y1"].alias("bottom")).cast(state))
        )

    paras = F.aggregate("__b", start, fold, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.array_append(a["out"], t.strip(a["cur"]))))
    return ordered.select("attachmentKey", "page_index", "page_label", paras.alias("paras"))


def duplicate_ids(chunks: DataFrame) -> DataFrame:
    """Ids that occur more than once; must be empty after assembly."""
    return chunks.groupBy("chunk_id").count().where("count > 1")
