"""Problem 3: items above a size limit, cut at natural boundaries.

Every candidate cut has a penalty by its kind (paragraph, line, sentence, clause, word, none).
Dynamic programming over the candidates minimises the sum of the penalties and of the squared
deviations from an even size, subject to the maximum length, each piece after the first repeating the
last ``overlap`` characters before its cut.  So the first piece and every later one without its first
``overlap`` characters, joined, give the text back.

Defined results: null text, and text within the limit, gives one piece, the text as it is (part_index 0);
lengths are code points of the text without spaces, tabs, carriage returns and newlines at both ends;
no cut parts a base character from its combining marks, variation selectors or joiners.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.runtime import ship

# The engine's limit and overlaps.
MAX_CHARS, OVERLAP_LATIN, OVERLAP_CJK = 1200, 80, 60
#: Penalty of a cut by its kind, and weight of the squared deviation from an even size.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, NONE = 0.0, 0.5, 1.0, 4.0, 9.0, 30.0
BALANCE = 6.0

_STRONG = re.compile(r"(?P<para>\n[^\S\n]*\n\s*)|(?P<line>\n\s*)|(?P<sent>(?:[.?!…]['\"”’»)\]]*[^\S\n]+|[。！？]['\"”’」』）]*[^\S\n]*))|(?P<clause>[,;:–—]\s+|[，；：、])")
_KIND = {"para": PARAGRAPH, "line": LINE, "sent": SENTENCE, "clause": CLAUSE}
_WORD = re.compile(r"\s+")
# Abbreviations whose full stop ends no sentence.
_ABBREVIATIONS = frozenset("al approx art bd bzw ca cap cf ch cit col dr ed eds eg e.g etc fig figs hg ibid id i.e ie jg kap mr mrs ms no nos nr op p par pag pl pp prof s sect sr st tab tel tom u.a usw v vgl viz vol vols vs z.b ed cf. a.d b.c".split())
_LAST_TOKEN = re.compile(r"[\w.]*$")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]")
_LATIN = re.compile(r"[A-Za-z]")
_SPACE = re.compile(r"\s")
EDGE = " \t\r\n"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def overlap_of(text: str, latin: int = OVERLAP_LATIN, cjk: int = OVERLAP_CJK) -> int:
    """The overlap for CJK text where at least a fifth of its signs are CJK and at most two fifths Latin."""
    solid = max(1, len(text) - len(_SPACE.findall(text)))
    c = len(_CJK.findall(text))
    return cjk if c and c / solid >= 0.20 and len(_LATIN.findall(text)) / solid <= 0.40 else latin


def _joined(text: str, i: int) -> bool:
    """A cut before position i would part one user-perceived character."""
    c = text[i]
    return c in "‍︎️" or text[i - 1] == "‍" or unicodedata.combining(c) != 0 or "\U0001f3fb" <= c <= "\U0001f3ff" or text[i - 1 : i + 1] == "\r\n"


def _abbreviated(text: str, stop: int) -> bool:
    """The full stop at ``stop`` belongs to an abbreviation or an initial."""
    word = _LAST_TOKEN.search(text[max(0, stop - 12) : stop]).group()
    return word.lower() in _ABBREVIATIONS or len(word) == 1 and word.isalpha()


def boundaries(text: str, room: int) -> tuple[list[int], list[float]]:
    """Candidate cuts with penalties; word cuts and then bare cuts only where stronger ones lie too far apart."""
    at, cost = [0], [0.0]
    for m in _STRONG.finditer(text):
        if 0 < m.end() < len(text) and not (m.lastgroup == "sent" and text[m.start()] == "." and _abbreviated(text, m.start())):
            at.append(m.end())
            cost.append(_KIND[m.lastgroup])
    at.append(len(text))
    cost.append(0.0)
    for pattern, price, gap in ((_WORD, WORD, room // 2), (None, NONE, room // 2)):
        if all(b - a <= gap for a, b in zip(at, at[1:])):
            continue
        more, prices = [0], [0.0]
        for a, b, c in zip(at, at[1:], cost[1:]):
            if b - a > gap:
                inner = [m.end() for m in pattern.finditer(text, a, b)] if pattern else range(a + max(1, room // 16), b, max(1, room // 16))
                for i in inner:
                    while not pattern and i < b and _joined(text, i):
                        i += 1
                    if more[-1] < i < b:
                        more.append(i)
                        prices.append(price)
            more.append(b)
            prices.append(c)
        at, cost = more, prices
    return at, cost


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Positions where pieces end, the last being the length of the text."""
    n = len(text)
    if n <= limit:
        return [n]
    overlap = min(overlap, limit // 2)
    room = limit - overlap
    pieces = -(-(n - overlap) // room)
    even = (n - overlap) / pieces + overlap
    at, cost = boundaries(text, room)
    best, back = [0.0] + [float("inf")] * (len(at) - 1), [0] * len(at)
    for j in range(1, len(at)):
        end = at[j]
        for i in range(bisect_left(at, end - room), j):
            size = end - at[i] + overlap
            total = best[i] + BALANCE * ((size - even) / even) ** 2
            if total < best[j]:
                best[j], back[j] = total, i
        if at[0] == 0 and end <= limit:  # the first piece repeats nothing
            total = BALANCE * ((end - even) / even) ** 2
            if total < best[j]:
                best[j], back[j] = total, 0
        best[j] += cost[j]
    if best[-1] == float("inf"):  # only signs that no cut may part lie in the way: cut by length
        return [*range(limit, n, room), n]
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def pieces(text: str, limit: int = MAX_CHARS, latin: int = OVERLAP_LATIN, cjk: int = OVERLAP_CJK) -> list[str]:
    overlap = min(overlap_of(text, latin, cjk), limit // 2)
    ends = cuts(text, limit, overlap)
    return [text[max(0, a - overlap) : b] for a, b in zip([0, *ends], ends)]


def split_oversized(df: DataFrame, key: list[str], text: str, *, limit: int = MAX_CHARS, overlap: int = OVERLAP_LATIN, overlap_cjk: int = OVERLAP_CJK) -> DataFrame:
    """key columns, n_pieces, part_index and piece of the items above the limit; others are left to ``split_all``.

    The limit is tested in the JVM, so only oversized texts reach Python."""
    ship(df.sparkSession)
    kept = df.select(*key, F.col(text).alias("__text")).where(F.length("__text") > limit).withColumn("__text", trimmed(F.col("__text"))).where(F.length("__text") > limit)
    schema = T.StructType([*(df.schema[k] for k in key), T.StructField("n_pieces", T.IntegerType()), T.StructField("part_index", T.IntegerType()), T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, total, part, piece = [], [], [], []
            for row, t in enumerate(batch.column(len(key)).to_pylist()):
                cut = pieces(t, limit, overlap, overlap_cjk)
                rows += [row] * len(cut)
                total += [len(cut)] * len(cut)
                part += range(len(cut))
                piece += cut
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(key))), pa.array(total, pa.int32()), pa.array(part, pa.int32()), pa.array(piece, pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)


def split_all(df: DataFrame, key: list[str], text: str, **options: int) -> DataFrame:
    """Every item: those within the limit as one piece, without leaving the JVM."""
    limit = options.get("limit", MAX_CHARS)
    whole = df.where(F.col(text).isNull() | (F.length(trimmed(F.col(text))) <= limit)).select(*key, F.lit(1).alias("n_pieces"), F.lit(0).alias("part_index"), F.col(text).alias("piece"))
    return whole.unionByName(split_oversized(df, key, text, **options))
