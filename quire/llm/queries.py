"""Queries of the problems tagged llm, and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import boilerplate, bpe, encoding, markup, names, packing, scans, spam, splitting
from quire.runtime import checkpointed, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of familiar forms is fixed (67 rows)."""
    familiar = {r.familiar: r.formal for r in table(spark, sf_dir, "name_forms").collect() if r.familiar and r.formal}
    every = names.all_names(table(spark, sf_dir, "attachments"), table(spark, sf_dir, "chunks"))
    return names.pairs_of(checkpointed(names.clusters(every, familiar)))


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, restored, evidence) of the affected chunks; repeated rows of a chunk come out once."""
    chunks = table(spark, sf_dir, "chunks")
    return encoding.repaired(chunks, ["chunk_id"], "text", *encoding.trained(chunks, "text")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks")
    return encoding.repaired(chunks, ["chunk_id"], "text", *encoding.trained(chunks, "text"), only_keys=True).select("chunk_id").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized chunk as its pieces; repeated rows of a chunk give its pieces once."""
    chunks = table(spark, sf_dir, "chunks")
    big = chunks.where(F.length("text") > splitting.MAX_CHARS).select("chunk_id", "para_index", "text").distinct()
    return splitting.split_oversized(big, ["chunk_id", "para_index"], "text").drop("n_pieces")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = splitting.split_oversized(table(spark, sf_dir, "chunks"), ["chunk_id"], "text")
    return cut.where("n_pieces > 1").select("chunk_id").distinct()


def p4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, block_no, body): the probability of every block of an HTML snapshot that it is main body."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "attachmentKey", "title", "text")
    return boilerplate.judged(chunks.where(F.col("chunk_id").contains(":html:")), boilerplate.trained(chunks))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_blocks(spark, sf_dir).where("body < 0.5").select("chunk_id", "block_no").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.families(table(spark, sf_dir, "notes"), "noteKey", "note_html").withColumnRenamed("key", "note_key")


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note_key, clean) of every distinct text of a note."""
    return markup.cleaned(table(spark, sf_dir, "notes"), "noteKey", "note_html").withColumnRenamed("noteKey", "note_key")


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, repaired, counts of repairs by kind) of the affected chunks; repeated rows of a chunk come out once."""
    chunks = table(spark, sf_dir, "chunks")
    return scans.repaired(chunks, scans.lexicon_of(chunks, "text")).dropDuplicates(["chunk_id"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words broken by hyphens, misread signs, running headers or page numbers; gaps and splits alone are no case."""
    chunks = table(spark, sf_dir, "chunks")
    found = scans.repaired(chunks, scans.lexicon_of(chunks, "text"), only_kinds=True)
    return found.where("hyphen + misread + header + number > 0").select("chunk_id").distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capacity_name, doc_id, piece, piece_size, container) for each row of pack_capacities, a fixed table."""
    sizes = checkpointed(bpe.count_column(table(spark, sf_dir, "documents"), "doc_id", "text"))
    parts = [packing.pack(sizes, "doc_id", "n_tokens", r.capacity_tokens).select(F.lit(r.capacity_name).alias("capacity_name"), "doc_id", "piece", "piece_size", "container") for r in table(spark, sf_dir, "pack_capacities").collect()]
    return reduce(DataFrame.unionByName, parts)


def p10_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, language, distance, spam) of every document with enough text."""
    return spam.spam(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scored(spark, sf_dir).where("spam").select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_blocks": p4_blocks,
    "p5_found": p5_found,
    "p5_clean": p5_clean,
    "p6_found": p6_found,
    "p6_repaired": p6_repaired,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
    "p10_scored": p10_scored,
}

SQL = {
    "p3_found": r"SELECT DISTINCT chunk_id FROM chunks WHERE length(regexp_replace(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) > 1200",
}
