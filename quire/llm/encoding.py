"""Problem 2: text that was decoded with the wrong character encoding.

A smoothed character bigram model is trained on the clean records of the corpus.  Every stretch
without white space that holds a sign outside ASCII is scored under each chain "encode as it was read,
decode as it was written", twice in a row where that helps; the likeliest reading is accepted when it
is likelier than the text as it stands by more than a margin.  The margin is validated on held-out
clean records and on the same records garbled by the chains.

Restoration is partial where signs were lost (U+FFFD, stripped control characters): what decodes is
restored, the rest stays.  Defined results: null, empty and ASCII texts are never affected; repeated rows
get equal results; an empty corpus gives an empty model, under which only strict chains are accepted.
"""

from __future__ import annotations

import codecs
import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.runtime import ship

# Fixed values: (written in, read as) of each chain.
CHAINS = (
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "cp1250"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "koi8-r"), ("utf-8", "gbk"), ("utf-8", "cp932"), ("utf-8", "iso8859-15"), ("utf-8", "iso8859-2"), ("utf-8", "big5"), ("utf-8", "cp866"),
    ("cp1252", "cp1251"), ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1252"), ("koi8-r", "latin-1"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1252"), ("gbk", "cp1252"), ("gbk", "latin-1"), ("big5", "cp1252"), ("cp932", "cp1252"), ("cp932", "latin-1"), ("euc_jp", "cp1252"), ("euc_jp", "latin-1"), ("euc_kr", "cp1252"),
    ("gbk", "cp932"), ("cp932", "gbk"), ("big5", "gbk"), ("gbk", "big5"), ("gbk", "cp1251"), ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("iso8859-2", "latin-1"), ("iso8859-2", "cp1252"), ("cp1250", "latin-1"), ("cp1250", "cp1251"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1252", "gbk"), ("cp1252", "iso8859-2"),
)
#: Bigrams the model keeps (the most frequent), and one in how many records, by a hash of the text, is held out for the margin.
MODEL_BIGRAMS, HELD_OUT = 400_000, 16
#: Least margin in nats, and the share of held-out clean records that it may touch at most.
LEAST_MARGIN, FALSE_SHARE = 8.0, 0.0005
#: Nats in favour of garbling for each sign that a reader replaced because it could not decode it.
LOST_SIGN = 9.0
#: Gain in nats with which one word alone is evidence for a single-byte chain.
SURE_WORD = 10.0
LOST = "�"
_TOKEN = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")


def _high(codec: str) -> dict[int, str]:
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(1)
def _flags() -> tuple[np.ndarray, np.ndarray]:
    """For training only.  Marks: 1 and 2 lead and following bytes of UTF-8 read as cp1252 or Latin-1, 4 and 8 as
    cp1251, 255 lost signs and control characters.  Classes: 1 Latin, 2 Cyrillic, 4 Greek letters, 8 symbols."""
    flags, classes = np.zeros(65536, dtype=np.uint8), np.zeros(65536, dtype=np.uint8)
    for codec, lead, tail in (("latin-1", 1, 2), ("cp1252", 1, 2), ("cp1251", 4, 8)):
        for b, c in _high(codec).items():
            if 0xC2 <= b <= 0xF4 and not (codec == "cp1251" and b not in (0xD0, 0xD1, 0xC2, 0xC3, 0xE2)):
                flags[ord(c)] |= lead
            if b <= 0xBF:
                flags[ord(c)] |= tail
    flags[ord(LOST)] = 255
    flags[0x80:0xA0] = 255
    flags[ord("»")] &= ~np.uint8(8)
    for i in range(0x41, 0x2C00):
        kind = unicodedata.category(chr(i))
        if kind[0] == "L":
            classes[i] = 1 if i < 0x250 else 2 if 0x400 <= i < 0x530 else 4 if 0x370 <= i < 0x400 else 0
        elif kind in ("Sm", "So", "Sk") and i > 0x7F and chr(i) not in "°·¬":
            classes[i] = 8
    return flags, classes


def _garbled_marks(codes: np.ndarray, flags: np.ndarray, classes: np.ndarray) -> bool:
    codes = np.minimum(codes, 65535)
    f, k = flags[codes], classes[codes]
    a, b, x, y = f[:-1], f[1:], k[:-1], k[1:]
    return bool(np.any(f == 255) or np.any((a & 1 > 0) & (b & 2 > 0) | (a & 4 > 0) & (b & 8 > 0)) or np.any((x > 0) & (y > 0) & (x != y)))


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def count_bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (first * 2^21 + second) and counts of all bigrams of the texts without marks of garbling."""
    flags, classes = _flags()
    clean = [t for t in texts if t.isascii() or not _garbled_marks(_codes([t]), flags, classes)]
    if not clean:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = _codes(["", *clean, ""]).astype(np.int64)
    a, b = codes[:-1], codes[1:]
    plain = (a < 128) & (b < 128)
    table = np.bincount(a[plain] * 128 + b[plain], minlength=128 * 128)
    at = np.flatnonzero(table)
    other, n = np.unique(a[~plain] * (1 << 21) + b[~plain], return_counts=True)
    return np.concatenate((at // 128 * (1 << 21) + at % 128, other)), np.concatenate((table[at], n))


Chain = tuple[str, str]


class _Pairs(dict):
    """(first, second) -> log probability, filled as pairs come up; short stretches need no arrays."""

    def __init__(self, model: CharModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, pair: tuple[str, str]) -> float:
        if len(self) > 1_000_000:
            self.clear()
        self[pair] = log = float(self.model.between(np.array([ord(pair[0])]), np.array([ord(pair[1])]))[0])
        return log


@dataclass
class CharModel:
    """Bigram probabilities, smoothed towards the unigram ones."""

    keys: np.ndarray
    logs: np.ndarray
    firsts: np.ndarray
    total: np.ndarray
    seconds: np.ndarray
    share: np.ndarray
    unseen: float

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, weight: float = 2.0) -> CharModel:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(float)
        first, second = keys >> 21, keys & ((1 << 21) - 1)
        firsts, at = np.unique(first, return_inverse=True)
        total = np.bincount(at, counts) if len(at) else np.empty(0)
        seconds, at2 = np.unique(second, return_inverse=True)
        n = counts.sum()
        unseen = 0.5 / (n + 0.5 * 150_000)
        share = (np.bincount(at2, counts) + 0.5) / (n + 0.5 * 150_000) if len(at2) else np.empty(0)
        logs = np.log((counts + weight * share[at2]) / (total[at] + weight)) if len(keys) else np.empty(0)
        return cls(keys, logs, firsts, np.log(weight / (total + weight)), seconds, np.log(share), float(np.log(unseen)))

    def between(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Log probability of each second sign given the first."""
        a, b = first.astype(np.int64), second.astype(np.int64)
        if not len(self.keys):
            return np.full(len(a), self.unseen)
        key = (a << 21) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        out = np.where(hit, self.logs[at], 0.0)
        miss = np.flatnonzero(~hit)
        if len(miss):
            x, y = a[miss], b[miss]
            i = np.minimum(np.searchsorted(self.firsts, x), len(self.firsts) - 1)
            j = np.minimum(np.searchsorted(self.seconds, y), len(self.seconds) - 1)
            out[miss] = np.where(self.firsts[i] == x, self.total[i], 0.0) + np.where(self.seconds[j] == y, self.share[j], self.unseen)
        return out

    def score(self, text: str, before: str = " ", after: str = " ") -> float:
        logs, total, last = self.pairs, 0.0, before
        for c in text:
            total += logs[last, c]
            last = c
        return total + logs[last, after]

    @cached_property
    def pairs(self) -> _Pairs:
        return _Pairs(self)

    def strange(self, text: str) -> float:
        """Share of the signs outside ASCII that no clean record has."""
        odd = [c for c in text if c > "\x7f" and c != LOST]
        return sum(ord(c) not in self.known for c in odd) / max(1, len(odd))

    @cached_property
    def memory(self) -> dict[tuple[str, str, str], tuple[str, float, bool, Chain | None]]:
        """Best readings of short stretches under this model; a worker may see several models."""
        return {}

    @cached_property
    def gains(self) -> dict[tuple[str, str, str], dict[Chain, float]]:
        return {}

    @cached_property
    def known(self) -> set[int]:
        return set(self.seconds.tolist())

    def packed(self) -> tuple:
        """The arrays, and their digest, by which a worker knows the model again."""
        arrays = self.keys, self.logs, self.firsts, self.total, self.seconds, self.share
        digest = hashlib.blake2b(repr(self.unseen).encode())
        for a in arrays:
            digest.update(a.tobytes())
        return *arrays, self.unseen, digest.digest()

    @classmethod
    def unpacked(cls, packed: tuple) -> CharModel:
        """The model of ``packed``; tasks of one worker that are given the same model share what it remembers."""
        if (model := _LAST.get(packed[-1])) is None:
            _LAST.clear()
            _LAST[packed[-1]] = model = cls(*packed[:-1])
        return model


_LAST: dict[bytes, CharModel] = {}
_SINGLE = {read: {c: b for b, c in _high(read).items()} for _, read in CHAINS if read in ("cp1252", "cp1251", "cp1250", "latin-1", "mac_roman", "cp437", "cp850", "koi8-r", "iso8859-15", "iso8859-2", "cp866")}
# cp1252 leaves five bytes undefined; readers often pass them through as control characters
for _codec in ("cp1252", "cp1250", "cp1251"):
    for _b in range(128, 160):
        _SINGLE[_codec].setdefault(chr(_b), _b)
_TO_BYTES = {read: {**{b: b for b in range(128)}, **{ord(c): b for c, b in table.items()}, ord(LOST): 0xFF} for read, table in _SINGLE.items()}
_UTF8_RUN = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _to_bytes(token: str, read: str) -> bytes | None:
    """The bytes that a reader with ``read`` saw; lost signs stay as marks that no encoding reads."""
    table = _TO_BYTES.get(read)
    try:
        return token.encode(read) if table is None else codecs.charmap_encode(token, "strict", table)[0]
    except UnicodeEncodeError:
        if table is not None or LOST not in token:
            return None
    try:
        return b"\xff".join(part.encode(read) for part in token.split(LOST))
    except UnicodeEncodeError:
        return None


def _partly(token: str, read: str, data: bytes) -> str:
    """The valid UTF-8 sequences of the bytes decoded, every other byte as the sign it was read as."""
    out, at = [], 0
    for m in _UTF8_RUN.finditer(data):
        out.append(token[at : m.start()])
        try:
            out.append(m.group().decode("utf-8"))
        except UnicodeDecodeError:  # surrogates, overlong forms
            out.append(token[m.start() : m.end()])
        at = m.end()
    return "".join(out) + token[at:]


_PLAIN_CHAINS = tuple(c for c in CHAINS if c[0] == "utf-8" and c[1] in _SINGLE)


def _readings(token: str, chains: tuple[tuple[str, str], ...] = CHAINS) -> Iterator[tuple[str, str, str]]:
    """(reading, written, read) of each chain that applies to a whole stretch."""
    cache: dict[str, bytes | None] = {}
    for written, read in chains:
        if read not in cache:
            cache[read] = _to_bytes(token, read)
        data = cache[read]
        if data is None:
            continue
        if written == "utf-8":
            if not _UTF8_RUN.search(data):
                continue
            # what decodes is read anew, the rest stays as it is
            text = _partly(token, read, data) if read in _SINGLE else data.decode("utf-8", "replace")
            lost = text.count(LOST)
            if lost > max(1, 0.34 * sum(c > "\x7f" for c in text)):
                continue
        else:
            try:
                text = data.decode(written)
            except UnicodeDecodeError:
                continue
        if text != token:
            yield text, written, read


_FILLERS = [c for b, c in _high("cp1252").items() if b >= 0xC0 or c in "“”‘’–—…«»§°£"]


_MARKS = list("“”‘’–—…")


def fill_lost(token: str, model: CharModel, before: str, after: str, fillers: list[str] = _FILLERS) -> str:
    """Each lone lost sign beside Latin text as the likeliest sign of cp1252 that fits its neighbours."""
    padded = before + token + after
    out = list(token)
    for i, c in enumerate(token):
        left, right = (out[i - 1] if i else before), padded[i + 2]
        if c == LOST and LOST not in (left, right) and (left < "ɐ" or left in "“”‘’–—…") and right < "ɐ":
            codes = np.array([[ord(left), ord(x), ord(right)] for x in fillers])
            out[i] = fillers[int(np.argmax(model.between(codes[:, 0], codes[:, 1]) + model.between(codes[:, 1], codes[:, 2])))]
    return "".join(out)


def _letters(token: str) -> int:
    return sum(c.isalpha() for c in token)


def _has_letter(token: str) -> bool:
    """Single-byte chains are judged by letters outside ASCII, not by other signs."""
    return any(c > "\x7f" and c.isalpha() for c in token)


def best_reading(token: str, model: CharModel, before: str = " ", after: str = " ", rounds: int = 3) -> tuple[str, float, bool, Chain | None]:
    """The likeliest reading of a stretch, its gain in nats over the stretch as it is, whether a multi-byte
    encoding, which hardly any other text fits by chance, is among its chains, and its first chain.

    Readings as UTF-8 are read again, whatever their own likelihood, since twice garbled text is still
    garbled after one step.  A reading of signs that the clean records hardly know is none."""
    start = model.score(token, before, after)
    best: tuple[str, float, bool, Chain | None] = (token, start, False, None)
    frontier: list[tuple[str, bool, Chain | None]] = [(token, False, None)]
    seen = {token}
    for _ in range(rounds):
        following: list[tuple[str, bool, Chain | None]] = []
        for text, strict, first in frontier:
            if "â" in text:  # the first byte of UTF-8 punctuation whose other two a cleaner has dropped
                filled = fill_lost(text.replace("â", LOST), model, before, after, _MARKS)
                if LOST not in filled and (score := model.score(filled, before, after)) > best[1]:
                    best = (filled, score, strict, first)
            for t, written, read in _readings(text):
                if t in seen:
                    continue
                seen.add(t)
                many = strict or written not in _SINGLE
                chain = first or (written, read)
                if written == "utf-8" and not t.isascii():
                    following.append((t, many, chain))
                if not many and (t.count(LOST) != text.count(LOST) or not _has_letter(text) and not _has_letter(t)):
                    continue
                if model.strange(t) <= 0.3 and (score := model.score(t, before, after)) > best[1]:
                    best = (t, score, many, chain)
        frontier = following
        if not frontier:
            break
    text, score, strict, first = best
    if LOST in text:
        text = fill_lost(text, model, before, after)
        score, strict = max(score, model.score(text, before, after)), True
    return text, score - start, strict, first


def _cached(token: str, before: str, after: str, model: CharModel) -> tuple[str, float, bool, Chain | None]:
    if len(token) > 60:
        return best_reading(token, model, before, after)
    key, memory = (token, before, after), model.memory
    if key not in memory:
        if len(memory) > 300_000:
            memory.clear()
        memory[key] = best_reading(token, model, before, after)
    return memory[key]


def _gains(token: str, before: str, after: str, model: CharModel) -> dict[Chain, float]:
    """The gain of each single-byte chain under which the stretch is likelier."""
    key = (token, before, after)
    if key not in model.gains:
        if len(model.gains) > 100_000:
            model.gains.clear()
        start = model.score(token, before, after)
        model.gains[key] = {(written, read): g for t, written, read in _readings(token) if written in _SINGLE and (g := model.score(t, before, after) - start) > 0}
    return model.gains[key]


Reading = tuple[int, int, str, float, bool]


def readings(text: str, model: CharModel) -> list[Reading]:
    """(start, end, reading, gain, strict) of every stretch that has a likelier reading.

    A passage was garbled by one chain: where the single-byte chain with the most evidence in the text
    also fits a stretch, its reading is taken before that of a similar chain."""
    found = []
    by_chain: dict[Chain, float] = {}
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        around = text[a - 1 : a] or "\n", text[b : b + 1] or "\n"
        reading, gain, strict, chain = _cached(m.group(), *around, model)
        found.append((a, b, reading, gain, strict))
        if gain > 0 and not strict and (_has_letter(m.group()) or _has_letter(reading)):
            for chain, g in _gains(m.group(), *around, model).items():
                by_chain[chain] = by_chain.get(chain, 0.0) + g
    if by_chain:
        top = max(by_chain, key=lambda c: (by_chain[c], c))
        for i, (a, b, _, gain, strict) in enumerate(found):
            if not strict:
                around = text[a - 1 : a] or "\n", text[b : b + 1] or "\n"
                same = next((t for t, written, read in _readings(text[a:b]) if (written, read) == top), None)
                if same and (_has_letter(text[a:b]) or _has_letter(same)) and (g := model.score(same, *around) - model.score(text[a:b], *around)) > max(0.0, gain - 6.0):
                    found[i] = (a, b, same, g, False)
    return [x for x in found if x[3] > 0]


def evidence(found: list[Reading], text: str) -> tuple[float, float]:
    """Nats in favour of garbling by multi-byte and by single-byte chains.

    Stretches add up.  A single-byte chain fits many texts, so it counts only on words (three letters
    and more), on a different word each time, and needs two words or a clear one."""
    strict = sum(gain for *_, gain, s in found if s) + LOST_SIGN * text.count(LOST)
    words = {text[a:b]: gain for a, b, r, gain, s in found if not s and gain >= 3 and _letters(text[a:b]) >= 3 and _letters(r) >= 3}
    loose = sum(words.values()) if len(words) > 1 or any(g >= SURE_WORD for g in words.values()) else 0.0
    return strict, loose


# Fixed value: how the first byte of UTF-8 punctuation reads when a cleaner has dropped the two control characters after it.
_STRAY = re.compile(r"(?s)(.|^)(â)(.|$)")


def _stray(m: re.Match[str], model: CharModel) -> str:
    before, sign, after = m.group(1), m.group(2), m.group(3)
    left, right = before or "\n", after or "\n"
    filled = fill_lost(LOST, model, left, right, _MARKS)
    return before + filled + after if filled != LOST and model.score(filled, left, right) > model.score(sign, left, right) + 3.0 else m.group()


def restore(text: str, model: CharModel, margin: float) -> tuple[str, float]:
    """The text with the accepted readings in place, and the evidence for garbling."""
    found = readings(text, model)
    strict, loose = evidence(found, text)
    if max(strict, loose) > margin:
        for a, b, reading, gain, s in reversed(found):
            if strict > margin if s else loose > margin >= strict:
                text = text[:a] + reading + text[b:]
        if strict > margin:
            text = _STRAY.sub(lambda m: _stray(m, model), text)
    return text, max(strict, loose)


_SIGNATURE = re.compile(r"[\u00c2-\u00f4\u0413\u0420\u0421\u0432\u2500-\u25a0\u0393\u221a\u00ac\u201a][^\x00-\x7f]|[\u0080-\u009f]")


def without_model(text: str, rounds: int = 3) -> str:
    """Stretches that are valid UTF-8 read as a single-byte encoding, decoded; for operators that need readable
    text but no corpus model.  The reading with the fewest signs outside ASCII is taken."""

    def fix(m: re.Match[str]) -> str:
        token = m.group()
        for _ in range(rounds):
            if not _SIGNATURE.search(token):
                break
            options = [t for t, _, _ in _readings(token, _PLAIN_CHAINS) if LOST not in t]
            if not options:
                break
            best = min(options, key=lambda t: (sum(c > "\x7f" for c in t), t))
            if sum(c > "\x7f" for c in best) >= sum(c > "\x7f" for c in token):
                break
            token = best
        return token

    return _TOKEN.sub(fix, text) if _SIGNATURE.search(text) else text


# --- on Spark ---------------------------------------------------------------------------------------


def train(records: DataFrame, text: str, *, most: int = MODEL_BIGRAMS) -> CharModel:
    """The model of all clean records; its size is bounded by ``most``, the number of bigrams kept."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = count_bigrams([t for t in batch.column(0).to_pylist() if t])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["pair", "n"])

    counted = records.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    kept = counted.orderBy(F.desc("n"), "pair").limit(most).toArrow()
    return CharModel.of(kept.column("pair").to_numpy(), kept.column("n").to_numpy())


def garble(text: str, written: str, read: str) -> str | None:
    """The text as a reader with the wrong encoding would have it, if it can be written so."""
    try:
        return text.encode(written).decode(read, "replace")
    except UnicodeEncodeError:
        return None


def _is_clean(text: str) -> bool:
    return not text.isascii() and not _garbled_marks(_codes([text]), *_flags())


def _clean_evidence(text: str, model: CharModel) -> float:
    return max(evidence(readings(text, model), text))


def _broken_evidence(word: str, model: CharModel) -> float | None:
    """The evidence in a word garbled by one of the four commonest chains, if that changes it."""
    g = garble(word, *CHAINS[zlib.crc32(word.encode("utf-8", "surrogatepass")) % 4])
    return max(evidence(readings(g, model), g)) if g and g != word else None


def margin_of(clean: dict[float, int], broken: dict[float, int], least: float, share: float) -> float:
    """The margin from counts of the evidence in clean texts and in garbled words: at most ``share`` of the clean
    texts may lie above it, but it must not exceed what nine in ten garbled words show."""
    n = sum(clean.values())
    if not n:
        return least

    def ranked(counts: dict[float, int], rank: int) -> float:
        for value in sorted(counts):
            rank -= counts[value]
            if rank < 0:
                return value
        return math.inf

    floor = ranked(clean, n - 1 - int(share * n))
    return float(max(least, min(floor + 1.0, ranked(broken, sum(broken.values()) // 10))))


def validated_margin(texts: list[str], model: CharModel, *, least: float = LEAST_MARGIN, share: float = FALSE_SHARE) -> float:
    """A margin above the evidence found in all but ``share`` of the clean texts, but below that in nearly all garbled ones."""
    clean = [t for t in texts if _is_clean(t)]
    words = {w for t in clean for w in _TOKEN.findall(t)}
    broken = Counter(g for w in words if (g := _broken_evidence(w, model)) is not None)
    return margin_of(Counter(_clean_evidence(t, model) for t in clean), broken, least, share)


def held_out(text: str) -> Column:
    """Whether a record is kept out of training, the same for equal texts wherever they lie."""
    return F.pmod(F.xxhash64(text), F.lit(HELD_OUT)) == 0


def distributed_margin(held: DataFrame, text: str, model: CharModel, *, least: float = LEAST_MARGIN, share: float = FALSE_SHARE) -> float:
    """``validated_margin`` of all texts of ``held``; only counts by evidence, in hundredths of a nat, reach the driver."""
    spark = held.sparkSession
    ship(spark)
    packed = spark.sparkContext.broadcast(model.packed())

    def judged(of, keep):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = CharModel.unpacked(packed.value)
            for batch in batches:
                found = (of(t, own) for t in batch.column(0).to_pylist() if keep(t))
                counts = Counter(math.ceil(100 * e) for e in found if e is not None)
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["at", "n"])

        return run

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array({w for t in batch.column(0).to_pylist() if _is_clean(t) for w in _TOKEN.findall(t)}, pa.string())], names=["word"])

    def counted(df: DataFrame, run) -> dict[float, int]:
        rows = df.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
        return {r["at"] / 100: r["n"] for r in rows}

    texts = held.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(text)
    distinct = texts.mapInArrow(words, "word string").distinct()
    return margin_of(counted(texts, judged(_clean_evidence, _is_clean)), counted(distinct, judged(_broken_evidence, bool)), least, share)


def trained(records: DataFrame, text: str) -> tuple[CharModel, float]:
    """The model, and the margin on all the records that training did not see."""
    model = train(records.where(~held_out(text)), text)
    return model, distributed_margin(records.where(held_out(text)), text, model)


def repaired(records: DataFrame, key: list[str], text: str, model: CharModel, margin: float, *, only_keys: bool = False) -> DataFrame:
    """key columns, the restored text and the evidence of every affected record."""
    spark = records.sparkSession
    ship(spark)
    packed = spark.sparkContext.broadcast(model.packed())
    schema = T.StructType([*(records.schema[k] for k in key), *([] if only_keys else [T.StructField("restored", T.StringType())]), T.StructField("evidence", T.DoubleType())])
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CharModel.unpacked(packed.value)
        for batch in batches:
            texts = batch.column(n).to_pylist()
            rows, out, gains = [], [], []
            for i, t in enumerate(texts):
                fixed, gain = restore(t, own, margin)
                if gain > margin:
                    rows.append(i)
                    out.append(fixed)
                    gains.append(gain)
            at = pa.array(rows, pa.int64())
            columns = [batch.column(i).take(at) for i in range(n)] + ([] if only_keys else [pa.array(out, pa.string())]) + [pa.array(gains, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    beyond_ascii = F.col(text).rlike(r"[^\x00-\x7f]")
    return records.select(*key, text).where(beyond_ascii).mapInArrow(run, schema)
