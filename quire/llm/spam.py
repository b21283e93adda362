"""Problem 10: pages of repeated keywords, link lists and product tags instead of sentences.

Each document gets features of density (shares of the text outside sentences and in links, of prices, numbers
and signs), repetition, entropy and function words; those that grow with length are means over windows.
Location and scatter are estimated robustly per language over all documents: medians, median
deviations, and the covariance of the winsorised scores, shrunk towards the pooled ones of such languages.
The whitened deviation of a document has a length, its Mahalanobis distance, and a direction.  The directions
of all outliers are clustered on the sphere, from one seed for each kind of page; a document is spam when it is
an outlier, its direction is nearest to that of a kind of spam, and its projection on that direction is an
outlier's as well.  Reference lists, indexes, contents pages, glossaries, code and annotated links deviate
as far, but in other directions.

Defined results: null, empty and blank texts, and texts under five words, are no spam; repeated texts under
other ids get equal results; a language of few documents is judged mostly by the pooled estimate, texts without
a word of any known language wholly, as they may all be spam.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.runtime import checkpointed, ship

FEATURES = ("loose", "links", "repeats", "flat", "function", "numbers", "phrase", "signs", "prices")
#: Least deviation of a feature, so that a constant one does not make everything an outlier; a tenth of a page may be links.
FLOORS = (0.08, 0.10, 0.04, 0.02, 0.03, 0.02, 0.05, 0.01, 0.03)
#: Languages written without spaces, whose features are of pairs of signs; groups whose estimates those of languages lean on.
UNSPACED, POOLS = ("zh", "ja"), ("", "unspaced")
#: Point of chi-square with nine degrees of freedom that one in a million lies above; documents that weigh as much as the pooled estimate;
#: words in a window; rounds of the clustering of directions.
OUTLIER, PRIOR_DOCUMENTS, WINDOW, ROUNDS = 44.81, 200, 100, 5

# Seeds of the directions, by what each kind of page has more and less of than others do.
SPAM_SEEDS = {
    "keywords": {"loose": 1, "repeats": 1, "flat": 1, "function": -1, "phrase": 1}, "tags": {"loose": 1, "repeats": 1, "flat": 1, "function": -1}, "stuffed": {"repeats": 1, "flat": 1, "phrase": 1}, "links": {"loose": 1, "links": 1, "repeats": 1, "function": -1}, "products": {"loose": 1, "repeats": 1, "function": -1, "prices": 1},
}
OTHER_SEEDS = {
    "figures": {"loose": 1, "function": -1, "numbers": 1}, "index": {"loose": 1, "repeats": 1, "flat": 1, "function": -1, "numbers": 1, "phrase": 1}, "references": {"loose": 1, "links": 0.5, "numbers": 1}, "list": {"loose": 1, "function": -1}, "verse": {"loose": 1}, "code": {"loose": 1, "repeats": 1, "flat": 1, "function": -1, "signs": 1}, "formulas": {"loose": 1, "signs": 1},
    "names": {"function": -1}, "plain": {"function": 1}, "short": {"flat": -1}, "refrain": {"repeats": 1, "function": 0.5}, "monotone": {"flat": 1}, "accounts": {"numbers": 1}, "sums": {"prices": 1},
}

# Common function words.
FUNCTION_WORDS = {
    "en": "the of and to in a is was that it as for with on by from which or this are be not at an were has their than but its".split(),
    "de": "der die das und in den von zu mit des auf für ist im dem nicht ein eine als auch es an werden aus sich bei nach über vor".split(),
    "fr": "le la les de des du et en un une dans que qui pour par sur est pas plus au aux ce avec il à où après pendant".split(),
    "es": "el la los las de del y en un una que por con para se es no como su al lo más entre durante según sin".split(),
    "pt": "o a os as de do da dos das e em um uma que por com para se não no na nos nas ao mais entre durante sem pela".split(),
    "pl": "i w na z do nie się o że jest to od za po przez dla oraz jak przed bez według mimo nad".split(),
    "ru": "и в на с по не что к из за от о до как это для а же бы при после без между их".split(),
}
# Digits and signs that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})

_ALL_FUNCTION = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws)
_BY_LANGUAGE = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
_SEGMENT = re.compile(r"[^\n。！？]*?(?:[.!?]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[”」』）]*|\n|$)", re.S)
_LINK = re.compile(r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)\S+", re.I | re.S)
_WORDS = re.compile(r"[^\W_]+(?:['’@$][^\W_]+)*|[\w@$]+")
_PLAIN = re.compile(r"\w+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_KANA = re.compile(r"[぀-ヿ]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_NUMBER = re.compile(r"\d+")
_PRICE = re.compile(r"(?<![\w.,])\d{1,6}[.,]\d\d(?![\d%])(?! ?(?:%|per cent|Prozent))")
_MIXED = re.compile(r"[^\W\d_]+[\d@$]+|[\d@$]+[^\W\d_]+")


def is_sentence(segment: str) -> bool:
    """Closed by an end sign, of at least four words one of which is a function word (six signs in CJK)."""
    s = segment.strip()
    if not s or s[-1] not in ".!?。！？\"'”’»)]」』）":
        return False
    if _CJK.search(s):
        return s.rstrip("”」』）")[-1:] in "。！？" and len(s) >= 6
    words = s.lower().split()
    if len(words) < 4 or not any(e in s[-3:] for e in ".!?"):
        return False
    commas = s.count(",") + s.count("|") + s.count(";")
    return commas <= len(words) / 3 and not _ALL_FUNCTION.isdisjoint(words) and words.count("#") == 0


def language(text: str) -> str:
    """By script, else by the function words, else none."""
    head = text
    cjk = len(_CJK.findall(head))
    if cjk > 0.2 * len(head):
        return "ja" if len(_KANA.findall(head)) > 0.15 * cjk else "zh"
    if len(_CYRILLIC.findall(head)) > 0.3 * len(head):
        return "ru"
    words = Counter(head.lower().split())
    scores = {k: sum(words[w] for w in ws) for k, ws in _BY_LANGUAGE.items()}
    top = max(scores, key=lambda k: scores[k])
    return top if scores[top] > 0 else "none"


def keyword(text: str) -> float:
    """Share of the words that belong to the commonest pair of words, neither a function word, if it comes three times or more."""
    words = _PLAIN.findall(text.lower())
    n = len(words)
    if n < 12:
        return 0.0
    counts = Counter(words)
    often = {w for w, c in counts.items() if c >= max(3, 0.03 * n) and w not in _ALL_FUNCTION and len(w) > 1 and not w.isdigit()}
    if not often:
        return 0.0
    pairs = Counter(p for p in zip(words, words[1:]) if p[0] in often and p[1] in often)
    top = max(pairs.values(), default=0)
    return 2 * top / n if top >= 3 else 0.0


def features(text: str | None) -> tuple[str, *tuple[float, ...]] | None:
    """The language, and FEATURES: share outside sentences, share of links, share of words in repeated phrases, want of
    entropy, shares of function words, of numbers, of the commonest phrase, of signs of programs, of prices."""
    if not text or len(text.split(None, 5)) < 5 and len(text) < 40:
        return None
    links = _LINK.findall(text)
    linked = sum(map(len, links))
    inside = outside = 0
    for m in _SEGMENT.finditer(text):
        s = m.group()
        if not s.strip():
            continue
        if is_sentence(s) and not (links and _LINK.search(s) and sum(map(len, _LINK.findall(s))) > 0.5 * len(s)):
            inside += len(s)
        else:
            outside += len(s)
    lang = language(text)
    cjk = lang in UNSPACED
    tokens, numbers, prices = [], 0, len(_PRICE.findall(text))
    for w in _WORDS.findall((_LINK.sub(" ", text) if linked and linked < 0.5 * len(text) else text).lower()):
        if w.isdigit():
            numbers += 1
        else:
            tokens.append(w.translate(DISGUISE) if not w.isalpha() and _MIXED.match(w) else w)
    if cjk:
        tokens = [c for t in tokens for c in ([t[i : i + 2] for i in range(max(1, len(t) - 1))] if _CJK.search(t) else [t])]
    n, repeated, flat, function = len(tokens), 0.0, 0.0, 0
    windows = max(1, round(n / WINDOW))
    for i in range(windows):
        window = tokens[i * n // windows : (i + 1) * n // windows]
        size = len(window)
        words, pairs = Counter(window), Counter(zip(window, window[1:]))
        common = {w: c for w, c in words.items() if w in _ALL_FUNCTION}
        function += sum(common.values())
        if size > 4:
            often = sum(c for w, c in words.items() if c >= 3 and w not in common) / size
            repeated += size * max(sum(c for c in pairs.values() if c >= 3) / (size - 1), often)
            flat += size * (1 + sum(c * math.log(c / size) for c in words.values()) / (size * math.log(size)))
    signs = 0.0 if links else sum(map(text.count, "(){}[]=<>")) / len(text)
    own = max(1, n)
    figures = max(1, n + numbers)
    return (lang, outside / max(1, inside + outside), linked / len(text), repeated / own, flat / own, 0.0 if cjk else function / own, max(0, numbers - 2 * prices) / figures if n else 1.0, keyword(text), signs, 2 * prices / figures)


# --- on Spark ---------------------------------------------------------------------------------------


def measured(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, language, one column per feature) of every document with enough text."""
    ship(documents.sparkSession)
    schema = T.StructType([documents.schema[key], T.StructField("language", T.StringType()), *(T.StructField(f, T.DoubleType()) for f in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, f) for i, t in enumerate(batch.column(1).to_pylist()) if (f := features(t))]
            columns = list(zip(*(f for _, f in rows))) or [[] for _ in range(len(FEATURES) + 1)]
            at = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(columns[0], pa.string()), *(pa.array(c, pa.float64()) for c in columns[1:])], names=schema.names)

    return documents.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema)


def pool_of(language: str) -> str:
    return "unspaced" if language in UNSPACED else ""


Estimates = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


def robust_estimates(rows: DataFrame) -> Estimates:
    """Median, scaled median deviation and whitening matrix (the symmetric root of the inverse covariance of the
    winsorised scores) by language; the pooled ones of all and of those without spaces are kept beside them.

    Two passes of aggregation over all documents: percentiles, then cross products; there are as many rows as
    languages.  Each language's figures are means of its own and the pooled ones, weighted by
    its number of documents against PRIOR_DOCUMENTS, so they change smoothly as a corpus grows."""
    pools = F.when(F.col("language").isin(*UNSPACED), F.array(F.col("language"), F.lit("unspaced"), F.lit(""))).otherwise(F.array(F.col("language"), F.lit("")))
    grouped = rows.withColumn("group", F.explode(pools))
    middle = {r["group"]: r for r in grouped.groupBy("group").agg(F.count("*").alias("n"), *(F.percentile_approx(f, 0.5, 1000).alias(f) for f in FEATURES)).collect()}
    if not middle:
        return {}
    weight = {g: 1.0 if g == "" else 0.0 if g == "none" else r["n"] / (r["n"] + PRIOR_DOCUMENTS) for g, r in middle.items()}

    def shrunk(of: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {}
        for g in sorted(of, key=lambda g: (g not in POOLS, g)):  # pools first, the wider one before the other
            out[g] = weight[g] * of[g] + (1 - weight[g]) * (of[g] if g == "" else out[pool_of(g)])
        return out

    spark = rows.sparkSession
    centres = shrunk({g: np.array([r[f] for f in FEATURES], dtype=float) for g, r in middle.items()})
    centre = spark.createDataFrame([(g, v.tolist()) for g, v in centres.items()], "group string, centre array<double>")
    vector = F.array(*(F.col(f) for f in FEATURES))
    # one row a language on the small side
    off = grouped.withColumn("x", vector).join(F.broadcast(centre), "group").withColumn("d", F.zip_with("x", "centre", lambda x, c: x - c))
    spread = {r["group"]: np.array([1.4826 * r[f] for f in FEATURES]) for r in off.groupBy("group").agg(*(F.percentile_approx(F.abs(F.col("d")[i]), 0.5, 1000).alias(f) for i, f in enumerate(FEATURES))).collect()}
    scales = {g: np.maximum(v, FLOORS) for g, v in shrunk(spread).items()}
    scale = spark.createDataFrame([(g, v.tolist()) for g, v in scales.items()], "group string, scale array<double>")
    z = off.join(F.broadcast(scale), "group").withColumn("z", F.zip_with("d", "scale", lambda d, s: F.greatest(F.lit(-3.0), F.least(F.lit(3.0), d / s))))
    k = len(FEATURES)
    products = [F.avg(F.col("z")[i] * F.col("z")[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    covariances = {}
    for r in z.groupBy("group").agg(*products, *(F.avg(F.col("z")[i]).alias(f"m{i}") for i in range(k))).collect():
        mean = np.array([r[f"m{i}"] for i in range(k)])
        covariances[r["group"]] = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) - np.outer(mean, mean)
    return {g: (centres[g], scales[g], whitening(cov)) for g, cov in shrunk(covariances).items()}


def whitening(cov: np.ndarray) -> np.ndarray:
    """Symmetric, so that axes keep their meaning in every language; shrunk towards independent scores, so that a
    constant feature leaves it invertible."""
    values, vectors = np.linalg.eigh(0.7 * cov + 0.3 * np.eye(len(cov)))
    return (vectors / np.sqrt(values)) @ vectors.T


def seeds() -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the seeded directions, and which of them are of spam."""
    kinds = [*SPAM_SEEDS.values(), *OTHER_SEEDS.values()]
    axes = np.array([[kind.get(f, 0.0) for f in FEATURES] for kind in kinds], dtype=float)
    return axes / np.linalg.norm(axes, axis=1, keepdims=True), np.arange(len(kinds)) < len(SPAM_SEEDS)


def deviations(f: pd.DataFrame, estimates: Estimates) -> np.ndarray:
    """Whitened deviations, whose squared lengths are the Mahalanobis distances."""
    x = f[list(FEATURES)].to_numpy(dtype=float)
    out = np.zeros_like(x)
    for lang, at in f.groupby("language").indices.items():
        centre, scale, root = estimates[lang]
        out[at] = ((x[at] - centre) / scale) @ root
    return out


def directions(rows: DataFrame, estimates: Estimates, rounds: int = ROUNDS) -> np.ndarray:
    """The seeds, moved to the mean directions of the outliers nearest to them, round by round over all documents;
    a seed counts as one outlier of its own.  Sums by direction are all that leaves a task."""
    axes, _ = seeds()
    schema = "axis int, " + ", ".join(f"{f} double" for f in FEATURES)
    for _ in range(rounds if estimates else 0):

        def run(frames: Iterator[pd.DataFrame], axes: np.ndarray = axes) -> Iterator[pd.DataFrame]:
            sums = np.zeros_like(axes)
            for f in frames:
                w = deviations(f, estimates)
                length = np.linalg.norm(w, axis=1)
                unit = w[length**2 > OUTLIER] / length[length**2 > OUTLIER, None]
                np.add.at(sums, (unit @ axes.T).argmax(axis=1), unit)
            yield pd.DataFrame(sums, columns=list(FEATURES)).assign(axis=np.arange(len(sums), dtype=np.int32))[["axis", *FEATURES]]

        moved = axes.copy()
        for r in rows.mapInPandas(run, schema).groupBy("axis").agg(*(F.sum(f).alias(f) for f in FEATURES)).collect():
            moved[r["axis"]] += [r[f] for f in FEATURES]
        moved /= np.linalg.norm(moved, axis=1, keepdims=True)
        if np.allclose(moved, axes, atol=1e-4):
            break
        axes = moved
    return axes


def is_spam(w: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Outliers nearest to a direction of spam that are outliers along it."""
    distance = (w**2).sum(axis=1)
    along = w @ axes.T
    nearest = along.argmax(axis=1)
    return (distance > OUTLIER) & seeds()[1][nearest] & (along[np.arange(len(w)), nearest] > math.sqrt(OUTLIER))


def judged(rows: DataFrame, key: str, estimates: Estimates, axes: np.ndarray) -> DataFrame:
    """(key, language, distance, spam) of measured documents."""
    schema = T.StructType([rows.schema[key], T.StructField("language", T.StringType()), T.StructField("distance", T.DoubleType()), T.StructField("spam", T.BooleanType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            w = deviations(f, estimates)
            yield pd.DataFrame({key: f[key], "language": f["language"], "distance": (w**2).sum(axis=1), "spam": is_spam(w, axes)})

    return rows.mapInPandas(run, schema)


def spam(documents: DataFrame, key: str, text: str) -> DataFrame:
    rows = checkpointed(measured(documents, key, text))
    estimates = robust_estimates(rows)
    return judged(rows, key, estimates, directions(rows, estimates))
