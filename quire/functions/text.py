"""Text as Column expressions: cleaning, paragraphs, language tests, splitting, merging.

Everything but compatibility normalisation and entity decoding is built in, so it stays in the JVM.
White space means Unicode white space throughout ((?U) patterns)."""

from __future__ import annotations

import html
import unicodedata
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.config import DEFAULT, EngineConfig

# Control characters that cleaning drops, CJK code points, thresholds of the language test.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
CJK = r"぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾝ"
CJK_LEAST, LATIN_MOST, SAMPLE_CHARS = 0.20, 0.40, 20_000
SENTENCE_ENDS = ".?!。！？"


def once(c: Column) -> Column:
    """The expression behind a one-element generator: evaluated once a row, however often it is referred to.

    The optimizer copies a projected expression into every later use; for folds over whole documents that
    would repeat the work."""
    return F.explode(F.array(c))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda t: html.unescape(t) if "&" in t else t, na_action="ignore")


def without_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def clean(c: Column) -> Column:
    """Control characters out, compatibility forms composed, replacement characters out, in this order."""
    return F.replace(nfkc(without_control(c)), F.lit("�"), F.lit(""))


def _solid(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def ratio(c: Column, signs: str) -> Column:
    """Share of the signs of a character class among those that are not white space; 0 for none."""
    solid = _solid(c)
    return F.length(F.regexp_replace(solid, f"[^{signs}]", "")) / F.greatest(F.length(solid), F.lit(1))


def cjk_ratio(c: Column) -> Column:
    return ratio(c, CJK)


def latin_ratio(c: Column) -> Column:
    return ratio(c, "A-Za-z")


def is_cjk(c: Column) -> Column:
    # most texts hold no such sign at all, which one scan tells
    return F.when(c.rlike(f"[{CJK}]"), (cjk_ratio(c) >= CJK_LEAST) & (latin_ratio(c) <= LATIN_MOST)).otherwise(F.lit(False))


def is_no_space_document(c: Column) -> Column:
    return is_cjk(F.substring(strip(c), 1, SAMPLE_CHARS))


def joiner(c: Column) -> Column:
    return F.when(is_cjk(c), F.lit("")).otherwise(F.lit(" "))


def overlap(c: Column, config: EngineConfig = DEFAULT) -> Column:
    if config.overlap_chars > 0:
        return F.lit(config.overlap_chars)
    return F.when(is_cjk(c), F.lit(config.overlap_chars_cjk)).otherwise(F.lit(config.overlap_chars_latin))


def is_gibberish(c: Column) -> Column:
    """Fifty solid signs or more, with under 90 % printable or under 20 % letters and digits."""
    solid = _solid(c)
    n = F.length(solid)
    share = lambda pattern: F.length(F.regexp_replace(solid, pattern, "")) / F.greatest(n, F.lit(1))
    return F.coalesce((n >= 50) & ((share(r"[\p{C}\p{Z}]") < 0.90) | (share(r"[^\p{L}\p{Nd}]") < 0.20)), F.lit(False))


def min_chunk_chars(sample: Column, config: EngineConfig = DEFAULT) -> Column:
    return F.when(is_no_space_document(sample), F.lit(config.min_chunk_chars_no_space)).otherwise(F.lit(config.min_chunk_chars))


def one_newline(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n|[\r\x0B\x0C\x1C\x1D\x1E\u0085  ]", "\n")


def join_lines(c: Column, glue: Column) -> Column:
    """Lines of one paragraph joined; a hyphen at a line's end goes, and so does the gap after it."""
    undone = F.regexp_replace(strip(c), r"(?U)-[^\S\n]*\n\s*", "")
    return collapse(F.replace(F.regexp_replace(undone, r"(?U)[^\S\n]*\n\s*", "\n"), F.lit("\n"), glue))


def paragraphs(c: Column, glue: Column) -> Column:
    """Paragraphs between blank lines."""
    parts = F.split(one_newline(c), r"(?U)\n(?:[^\S\n]*\n)+")
    return F.filter(F.transform(parts, lambda p: join_lines(p, glue)), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Pieces after end signs and white space; where that gives one piece, after end signs alone."""
    spaced = F.split(c, rf"(?U)(?<=[{SENTENCE_ENDS}])\s+", -1)
    return F.when(F.size(spaced) > 1, spaced).otherwise(F.split(c, rf"(?U)(?<=[{SENTENCE_ENDS}])\s*", -1))


def split_long(c: Column, config: EngineConfig = DEFAULT) -> Column:
    """Parts of at most ``max_chars``: sentences packed in order, an overlap before each later part as far as
    there is room, and fixed windows for what is still too long.

    Glue and overlap travel in the accumulators, so the language test runs once per text and not per sentence."""
    most = config.max_chars
    text = strip(c)
    pieces = F.filter(F.transform(sentences(text), strip), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("cur"), joiner(text).alias("glue"), overlap(text, config).alias("back"))

    def state(acc: Column, parts: Column, cur: Column) -> Column:
        return F.struct(parts.alias("parts"), cur.alias("cur"), acc["glue"].alias("glue"), acc["back"].alias("back"))

    def pack(acc: Column, s: Column) -> Column:
        longer = F.concat(acc["cur"], acc["glue"], s)
        return F.when(acc["cur"] == "", state(acc, acc["parts"], s)).when(F.length(longer) <= most, state(acc, acc["parts"], longer)).otherwise(state(acc, F.array_append(acc["parts"], acc["cur"]), s))

    def lap(acc: Column, part: Column) -> Column:
        keep = F.greatest(F.lit(0), F.least(acc["back"], most - F.length(part)))
        before = F.coalesce(F.try_element_at(acc["out"], F.lit(-1)), F.lit(""))
        tail = F.when(keep > 0, F.substr(before, F.greatest(F.lit(1), F.length(before) - keep + 1))).otherwise(F.lit(""))
        return F.struct(F.array_append(acc["out"], F.concat(tail, part)).alias("out"), acc["back"].alias("back"))

    def windows(acc: Column) -> Column:
        step = F.greatest(F.lit(1), F.when(acc["back"] >= most, F.lit(most - most // 4)).otherwise(most - acc["back"]))

        def cut(part: Column) -> Column:
            last = F.ceil((F.length(part) - most) / step).cast("int")
            return F.when(F.length(part) <= most, F.array(part)).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substr(part, i * step + 1, F.lit(most)))))

        return F.filter(F.flatten(F.transform(acc["out"], cut)), lambda x: x != "")

    def finish(acc: Column) -> Column:
        parts = F.when(acc["cur"] == "", acc["parts"]).otherwise(F.array_append(acc["parts"], acc["cur"]))
        return F.aggregate(parts, F.struct(F.array().cast("array<string>").alias("out"), acc["back"].alias("back")), lap, windows)

    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.aggregate(pieces, start, pack, finish))


#: Type of the records that ``merge_short`` folds.
RECORD = "struct<chunk_id: string, text: string, locator: string, para_index: int, part_index: int, chapter_index: int>"
MERGED = "struct<chunk_id: string, text: string, locator: string, para_index: int, part_index: int, chapter_index: int, merged: boolean, merge_count: int, locator_end: string>"


def merge_short(records: Column, min_chars: Column, config: EngineConfig = DEFAULT) -> Column:
    """An ordered fold over array<RECORD>: short chunks grow by the next as long as they fit; a short tail
    joins the chunk before it; ids and positions are those of the first of each."""
    most, hard = F.lit(config.max_chars), F.lit(config.hard_min_chars)
    names = ["chunk_id", "text", "locator", "para_index", "part_index", "chapter_index"]
    state = f"struct<out: array<{MERGED}>, open: boolean, buf: {MERGED}>"
    empty = F.struct(F.array().alias("out"), F.lit(False).alias("open"), F.lit(None).alias("buf")).cast(state)

    # the structs below have the types of the state without casts, which would copy ``out`` at every step
    def fresh(r: Column) -> Column:
        return F.struct(*(strip(r[n]).alias(n) if n == "text" else r[n].alias(n) for n in names), F.lit(None).cast("boolean").alias("merged"), F.lit(None).cast("int").alias("merge_count"), r["locator"].alias("locator_end"))

    def grown(b: Column, text: Column, locator: Column) -> Column:
        end = F.when(F.coalesce(locator, F.lit("")) != "", locator).otherwise(b["locator_end"])
        return F.struct(*((F.concat(b["text"], F.lit("\n\n"), text) if n == "text" else b[n]).alias(n) for n in names), F.lit(True).alias("merged"), (F.coalesce(b["merge_count"], F.lit(1)) + 1).alias("merge_count"), end.alias("locator_end"))

    def closed(b: Column) -> Column:
        return F.struct(*(b[n].alias(n) for n in names), b["merged"].alias("merged"), b["merge_count"].alias("merge_count"), F.when(b["merged"], b["locator_end"]).alias("locator_end"))

    def next_state(out: Column, buf: Column) -> Column:
        return F.struct(out.alias("out"), F.lit(True).alias("open"), buf.alias("buf"))

    def step(acc: Column, r: Column) -> Column:
        t = strip(r["text"])
        fits = (F.length(acc["buf"]["text"]) < min_chars) & (F.length(acc["buf"]["text"]) + 2 + F.length(t) <= most)
        return (
            F.when(F.coalesce(F.length(t), F.lit(0)) < hard, acc)
            .when(~acc["open"], next_state(acc["out"], fresh(r)))
            .when(fits, next_state(acc["out"], grown(acc["buf"], t, r["locator"])))
            .otherwise(next_state(F.array_append(acc["out"], closed(acc["buf"])), fresh(r)))
        )

    def finish(acc: Column) -> Column:
        last, buf = F.try_element_at(acc["out"], F.lit(-1)), acc["buf"]
        joins = (F.size(acc["out"]) > 0) & (F.length(buf["text"]) < min_chars) & (F.length(last["text"]) + 2 + F.length(buf["text"]) <= most)
        joined = F.array_append(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), grown(last, buf["text"], buf["locator_end"]))
        return F.when(~acc["open"], acc["out"]).when(joins, joined).otherwise(F.array_append(acc["out"], closed(buf)))

    return F.aggregate(records, empty, step, finish)


def body_of_html(c: Column) -> Column:
    """What lies between the body tags; the rest after an unclosed one; everything without one."""
    low = F.lower(c)
    tag = F.locate("<body", low)
    start = F.when(tag > 0, F.locate(">", low, 1)).otherwise(F.lit(0))
    start = F.when(tag > 0, F.expr("0") + F.call_function("locate", F.lit(">"), low, tag)).otherwise(F.lit(0))
    end = F.when(start > 0, F.call_function("locate", F.lit("</body"), low, start)).otherwise(F.lit(0))
    return F.when(start == 0, c).when(end > 0, F.substr(c, start + 1, end - start - 1)).otherwise(F.substr(c, start + 1))


def strip_html(c: Column) -> Column:
    """Scripts and styles out, paragraphs and breaks as newlines, every other tag as a space."""
    body = F.regexp_replace(body_of_html(c), r"(?is)<(script|style).*?>.*?</\1>", "")
    for tag, text in (("</p>", "\n\n"), ("<br>", "\n"), ("<br/>", "\n"), ("<br />", "\n")):
        body = F.replace(body, F.lit(tag), F.lit(text))
    return F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"<[^>]*$", "")


def text_of_html(c: Column) -> Column:
    return unescape(strip_html(c))


class Extractor(Protocol):
    """Finds the main text of a page; None or blank where it finds none."""

    def __call__(self, page: str) -> str | None: ...


def main_text_of_html(c: Column, extractor: Extractor | None = None) -> Column:
    """What ``extractor`` finds, else all text of the page, as where it fails or there is none."""
    if extractor is None:
        return text_of_html(c)

    @F.pandas_udf(StringType())
    def found(s: pd.Series) -> pd.Series:
        def one(page: str) -> str | None:
            try:
                text = extractor(page) if page else None
            except Exception:  # whatever a library raises, the page is kept
                return None
            return text if isinstance(text, str) and text.strip() else None

        return s.map(one, na_action="ignore")

    return F.coalesce(found(c), text_of_html(c))


def creators_text(c: Column) -> Column:
    """Names that are not blank, joined; null for none."""
    kept = F.filter(c, lambda x: x.isNotNull() & (strip(x) != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, "; "))


def year_of(date: Column) -> Column:
    head = F.substring(date, 1, 4)
    return F.when(head.rlike("^[0-9]{4}$"), head.try_cast("int"))
