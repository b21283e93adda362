"""Lines and prefixes that come back on many pages of a document.

Page counts per line are partly aggregated before the shuffle; the detected lines return to the pages by
a join on the document, collected as one short array per document (at most one entry per quarter of its pages)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import collapse, strip

# Longest line, least pages of a document, least count, lengths of a prefix.
LINE_MOST, PAGES_MORE_THAN, LEAST, PREFIX_LEAST, PREFIX_MOST = 180, 3, 4, 5, 40


def _thresholds(pages: DataFrame, doc: str, page: str, paras: str, ratio: float, least: int) -> DataFrame:
    counted = pages.where(F.size(paras) > 0).groupBy(doc).agg(F.countDistinct(page).alias("n_pages")).where(F.col("n_pages") > PAGES_MORE_THAN)
    return counted.select(doc, F.greatest(F.lit(least), F.floor(F.col("n_pages") * ratio)).alias("threshold"))


def repeated_lines(pages: DataFrame, doc: str, page: str, paras: str, *, ratio: float = 0.25, least: int = LEAST) -> DataFrame:
    """(doc, line, n) of lines on at least a quarter of the pages and four."""
    lines = pages.select(doc, page, F.explode(F.array_distinct(F.transform(paras, strip))).alias("line")).where((F.col("line") != "") & (F.length("line") <= LINE_MOST))
    n = lines.groupBy(doc, "line").agg(F.countDistinct(page).alias("n"))
    return n.join(_thresholds(pages, doc, page, paras, ratio, least), doc).where("n >= threshold").select(doc, "line", "n")


def repeated_prefixes(pages: DataFrame, doc: str, page: str, paras: str, *, ratio: float = 0.25, least: int = LEAST) -> DataFrame:
    """(doc, prefix, n) of beginnings of first paragraphs that come back as often."""
    heads = pages.where(F.size(paras) > 0).select(doc, strip(F.substring(collapse(F.col(paras)[0]), 1, PREFIX_MOST)).alias("prefix"))
    n = heads.where(F.length("prefix").between(PREFIX_LEAST, PREFIX_MOST)).groupBy(doc, "prefix").agg(F.count("*").alias("n"))
    return n.join(_thresholds(pages, doc, page, paras, ratio, least), doc).where("n >= threshold").select(doc, "prefix", "n")


def without_noise(pages: DataFrame, doc: str, page: str, paras: str, *, ratio: float = 0.25, lines: bool = True, prefixes: bool = True) -> DataFrame:
    """Pages without repeated lines, and first paragraphs without the longest repeated prefix they start with.

    Both are found on the paragraphs as they were; a paragraph of which nothing remains goes."""
    out = pages
    nothing = F.array().cast("array<string>")
    if lines:
        found = repeated_lines(pages, doc, page, paras, ratio=ratio).groupBy(doc).agg(F.collect_set("line").alias("__lines"))
        out = out.join(found, doc, "left").withColumn(paras, F.filter(paras, lambda p: (p != "") & ~F.array_contains(F.coalesce("__lines", nothing), strip(p)))).drop("__lines")
    if prefixes:
        found = repeated_prefixes(pages, doc, page, paras, ratio=ratio).groupBy(doc).agg(F.collect_set("prefix").alias("__prefixes"))
        out = out.join(found, doc, "left")
        first = collapse(F.get(paras, F.lit(0)))
        longest = F.array_max(F.transform(F.filter(F.coalesce("__prefixes", nothing), lambda p: F.startswith(first, p)), F.length))
        rest = F.regexp_replace(F.substr(first, longest + 1), r"^[ \-–—:：\t]+", "")
        others = F.slice(paras, F.lit(2), F.greatest(F.size(paras) - 1, F.lit(0)))
        stripped = F.when(longest.isNull() | (F.size(paras) == 0), F.col(paras)).when(rest == "", others).otherwise(F.concat(F.array(rest), others))
        out = out.withColumn(paras, stripped).drop("__prefixes")
    return out
