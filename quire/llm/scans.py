"""Problem 6: noise in text from scanned pages.

A lexicon of the corpus's words and their counts is the language model.  The character stream of a
chunk, its lines undone, is decoded jointly into words: a stretch may be kept, read with confused
characters, joined with the next across a hyphen or a gap, or split, and the cheapest sequence wins.
Running headers and page numbers are recognised before by the item's title, creators, page and label
and by their form; paragraph boundaries are chosen by dynamic programming
over the line ends.

Defined results: null, empty and blank texts come out unchanged and unaffected; a chunk without page or
label has no page numbers; repeated rows get equal results; without a corpus nothing is misread.
"""

from __future__ import annotations

import math
import os
import re
import sqlite3
from collections import Counter
from collections.abc import Iterator
from contextlib import closing
from functools import lru_cache
from itertools import chain
from pathlib import Path
from uuid import uuid4
from zlib import crc32

import pyarrow as pa
from pyspark import SparkFiles, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.encoding import without_model
from quire.runtime import ship

#: Words the lexicon keeps in memory (the most frequent; the others lie in a file), and the least count of a word in it.
LEXICON_WORDS, LEAST_COUNT = 300_000, 3
#: Costs in nats: an unseen word, each of its signs, a confused sign, a join over a gap, a split; and the gain a reading needs.
UNSEEN, PER_SIGN, CONFUSED, GAP, SPLIT, GAIN = 11.0, 0.25, 3.0, 6.0, 7.0, 1.5
MOST_CONFUSED = 3
#: Longest word kept in memory.  A confusion changes a length by one sign at most; the readings of words so long that all
#: of them are in the file are looked up by what no confusion changes, as there are too many to try.
LONGEST = 40
#: Signs of text counted before a task hands on its counts, and bits of the filter before the file.
MOST_SIGNS, FILTER_BITS = 50_000_000, 1 << 27

# How scanned signs are misread, and the signs they stand for.
CONFUSIONS = (("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("9", "g"), ("5", "s"), ("ſ", "s"), ("c", "e"), ("f", "t"), ("b", "h"), ("l", "i"), ("ri", "n"), ("rn", "m"), ("cl", "d"), ("ii", "u"), ("h", "li"), ("m", "in"), ("vv", "w"), ("I", "l"), ("|", "l"), ("é", "e"), ("6", "b"), ("0", "O"), ("l", "I"), ("C", "G"), ("з", "э"), ("З", "Э"))
HYPHENS = "-‐­¬"
_EDGE = ".,;:?!()[]{}«»“”‘’„\"'—–…/*|<>"
_INSIDE = re.compile(r"[^\W\d_]{2,}[019!ſ][^\W\d_A-Z]|(?<![\w.])[^\W\d_][019!ſ][^\W\d_A-Z]{2,}")
_LETTER = re.compile(r"[^\W\d_]")
_ROMAN = re.compile(r"[ivxlcIVXLC]+")


@lru_cache(400_000)
def _core(token: str) -> tuple[str, str, str]:
    """Leading signs, word, trailing signs.  A ``!`` stays where it stands for a letter inside the word."""
    a, b = 0, len(token)
    while a < b and token[a] in _EDGE:
        a += 1
    while b > a and token[b - 1] in _EDGE:
        b -= 1
    return token[:a], token[a:b], token[b:]


class _Status(dict):
    """Token -> whether it needs decoding: unknown to the lexicon, or known and yet misread."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> bool:
        if len(self) > 1_000_000:
            self.clear()
        word = _core(token)[1]
        self[token] = odd = bool(word) and (self.lexicon.corrected(word) is not None or not self.lexicon.known(word, 0) and word.isalpha() and word.islower())
        return odd


class _Folds(dict):
    """Signs in classes such that no confusion and no capital changes the folded word: what confusions put in or take out is dropped."""

    def __missing__(self, code: int) -> str:
        self[code] = fold = "".join(_CLASSES.get(c, c) for c in chr(code).lower())
        return fold


# One class for all signs that CONFUSIONS lead to from each other.
_CLASSES = {c: fold for signs, fold in (("il1!|rnmuhb6", ""), ("ceédg9", "e"), ("ft", "t"), ("0o", "o"), ("5sſ", "s"), ("w", "vv"), ("зэ", "э")) for c in signs}
_FOLDS = _Folds()


def fold_key(word: str) -> int:
    return crc32(word.translate(_FOLDS).encode("utf-8", "surrogatepass"))


def confusions_between(word: str, target: str) -> int | None:
    """The least number of confusions that turn one word into the other; None beyond ``MOST_CONFUSED``.

    Confusions apart from each other may come in any order, so those from the first difference on are tried first; none
    that are needed begin before it, as no confusions but a useless ``l``, ``I``, ``l`` give a sign back."""
    start = max(len(os.path.commonprefix((word, target))) - 1, 0)
    layer, target = {word[start:]}, target[start:]
    for k in range(1, MOST_CONFUSED + 1):
        following, near = set(), 2 * (MOST_CONFUSED - k + 1)
        for w in layer:
            p = len(os.path.commonprefix((w, target)))
            for bad, good in CONFUSIONS:
                i = w.find(bad, p, p + near)
                while i >= 0:
                    following.add(w[:i] + good + w[i + len(bad) :])
                    i = w.find(bad, i + 1, p + near)
        if target in following:
            return k
        layer = following
    return None


class Vocabulary(dict):
    """Counts of the words kept in memory; ``total`` counts all words, ``filed`` names the file of the others, if there are any."""

    total: int
    filed: str | None = None


class Filed:
    """The words of a lexicon that are not kept in memory, read from a file of which every executor has a copy."""

    def __init__(self, path: str) -> None:
        self.db = sqlite3.connect(f"{Path(path).as_uri()}?mode=ro&immutable=1", uri=True)
        self.bits, self.rare = self.db.execute("SELECT bits, rare FROM about").fetchone()
        self.mask = 8 * len(self.bits) - 1
        self.read = lru_cache(200_000)(self._read)

    @staticmethod
    def write(path: str, words: Iterator[tuple[str, int]]) -> int:
        """Writes the words in a stream, and returns the sum of their counts."""
        with closing(sqlite3.connect(path, isolation_level=None)) as db:
            db.execute("PRAGMA journal_mode = OFF")
            db.execute("PRAGMA synchronous = OFF")
            db.execute("CREATE TABLE words (word BLOB, n INTEGER, fold INTEGER, signs INTEGER)")
            db.execute("CREATE TABLE about (bits BLOB, rare INTEGER)")
            db.execute("BEGIN")
            db.executemany("INSERT INTO words VALUES (?, ?, ?, ?)", ((w.encode(), n, fold_key(w) if len(w) > LONGEST else None, len(w)) for w, n in words))
            db.execute("CREATE INDEX by_word ON words (word, n)")
            db.execute("CREATE INDEX by_fold ON words (fold, signs) WHERE fold IS NOT NULL")
            rows, total, least = db.execute("SELECT count(*), sum(n), min(signs) FROM words").fetchone()
            # a word whose bit is not set is not in the file; with more words more bits are set, and the file is asked more often
            size = min(FILTER_BITS, 1 << max(6, (16 * rows).bit_length()))
            bits = bytearray(size // 8)
            for (word,) in db.execute("SELECT word FROM words"):
                bit = crc32(word) & (size - 1)
                bits[bit >> 3] |= 1 << (bit & 7)
            db.execute("INSERT INTO about VALUES (?, ?)", (bytes(bits), least <= LONGEST))
            db.execute("COMMIT")
        return total

    def _read(self, word: bytes) -> int:
        row = self.db.execute("SELECT n FROM words WHERE word = ?", (word,)).fetchone()
        return row[0] if row else 0

    def count(self, word: str) -> int:
        data = word.encode("utf-8", "surrogatepass")
        bit = crc32(data) & self.mask
        if not self.bits[bit >> 3] >> (bit & 7) & 1:
            return 0
        return self.read(data) if len(word) <= LONGEST else self._read(data)

    def alike(self, word: str) -> list[str]:
        """Words that confusions may lead to from a word of which all readings are longer than ``LONGEST``, capitals apart."""
        found = self.db.execute("SELECT word FROM words WHERE fold = ? AND signs BETWEEN ? AND ?", (fold_key(word), len(word) - MOST_CONFUSED, len(word) + MOST_CONFUSED + 1))
        return [w.decode() for (w,) in found]


class Lexicon:
    """Word costs, corrections of misread words, and joint decoding."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.filed = Filed(SparkFiles.get(counts.filed)) if isinstance(counts, Vocabulary) and counts.filed else None
        self.known = self._known if self.filed else counts.get
        self.total = math.log((counts.total if isinstance(counts, Vocabulary) else sum(counts.values())) + 1.0)
        self.memory: dict[str, tuple[str, int] | None] = {}
        self.status = _Status(self)

    def _known(self, word: str, none: int = 0) -> int:
        n = self.counts.get(word)
        if n is None:
            n = self.filed.count(word) if self.filed.rare or len(word) > LONGEST else none
        return n

    def count(self, word: str) -> int:
        n = self.known(word, 0)
        if word[:1].isupper():
            n += self.known(word[0].lower() + word[1:], 0)
        return n

    def cost(self, word: str) -> float:
        n = self.count(word)
        return self.total - math.log(n) if n else max(self.total, UNSEEN) + PER_SIGN * len(word)

    def corrected(self, word: str) -> tuple[str, int] | None:
        """The cheapest reading with up to three confused signs, if it beats the word as it is."""
        if word in self.memory:
            return self.memory[word]
        if len(self.memory) > 500_000:
            self.memory.clear()
        found = None
        plain = word.isalpha() and "ſ" not in word
        if _LETTER.search(word) and (len(word) > 2 or not plain) and not _ROMAN.fullmatch(word) and len(word) <= LONGEST + MOST_CONFUSED:
            best = self.cost(word) - GAIN
            beyond = self.filed is not None and (self.filed.rare or len(word) + MOST_CONFUSED > LONGEST)
            seen, layer = {word}, [word]
            for k in range(1, MOST_CONFUSED + 1):
                following = []
                for w in layer:
                    for bad, good in CONFUSIONS:
                        i = w.find(bad)
                        while i >= 0:
                            v = w[:i] + good + w[i + len(bad) :]
                            if v not in seen:
                                seen.add(v)
                                following.append(v)
                                if v in self.counts or v[:1].isupper() or beyond and self.known(v, 0):
                                    c = self.cost(v) + CONFUSED * k + (0.0 if not plain or k == 1 else 1.0)
                                    if c < best and self.count(v):
                                        best, found = c, (v, k)
                            i = w.find(bad, i + 1)
                layer = following
                if found:
                    break
            if not found and _INSIDE.search(word):
                v = word
                for bad, good in (("0", "o"), ("1", "l"), ("!", "i"), ("9", "g"), ("ſ", "s")):
                    v = re.sub(rf"(?<=[a-zà-öø-ÿą-žа-я]){re.escape(bad)}(?=[^\W\d_])", good, v)
                found = (v, sum(a != b for a, b in zip(v, word))) if v != word else None
        elif self.filed and len(word) > LONGEST + MOST_CONFUSED and _LETTER.search(word) and not _ROMAN.fullmatch(word):
            found = self._corrected_long(word, plain)
        self.memory[word] = found
        return found

    def _corrected_long(self, word: str, plain: bool) -> tuple[str, int] | None:
        """The same reading, found among the words of the lexicon with the same folded signs."""
        readings = set()
        for t in self.filed.alike(word):
            # a capital at the start also counts as its small letter: one that was read, or the word's own
            large = {c + t[len(c.lower()) :] for c in (t[:1].upper(), word[:1]) if c.isupper()}
            readings.update({t, *(v for v in large if v[:1].lower() + v[1:] == t)} - {word})
        best, found = self.cost(word) - GAIN, None
        by_number: dict[int | None, list[str]] = {}
        for v in sorted(readings):
            by_number.setdefault(confusions_between(word, v), []).append(v)
        for k in range(1, MOST_CONFUSED + 1):
            for v in by_number.get(k, ()):
                c = self.cost(v) + CONFUSED * k + (0.0 if not plain or k == 1 else 1.0)
                if c < best:
                    best, found = c, (v, k)
            if found:
                break
        return found

    def decode(self, tokens: list[str]) -> tuple[list[str], Counter[str]]:
        """Words of the stream and what was repaired."""
        n = len(tokens)
        best, back = [0.0] + [math.inf] * n, [None] * (n + 1)

        def step(i: int, j: int, cost: float, words: list[str], kinds: tuple[str, ...]) -> None:
            if best[i] + cost < best[j]:
                best[j], back[j] = best[i] + cost, (i, words, kinds)

        for i, token in enumerate(tokens):
            if best[i] == math.inf:
                continue
            lead, word, tail = _core(token)
            if not word:
                step(i, i + 1, 0.0, [token], ())
                continue
            base = self.cost(word)
            step(i, i + 1, base, [token], ())
            fix = self.corrected(word)
            if fix:
                step(i, i + 1, min(self.cost(fix[0]) + CONFUSED * fix[1], base - GAIN), [lead + fix[0] + tail], ("misread",) * fix[1])
            if i + 1 < n and word[-1:] in HYPHENS and not tail and len(word) > 1:
                _, second, after = _core(tokens[i + 1])
                stem = word[:-1]
                if second and stem[-1:].isalpha() and second[:1].islower() and second not in SUSPENDING:
                    joined, compound = stem + second, stem + "-" + second
                    whole = self.count(joined)
                    if self.count(compound) > whole and word[-1] in "-‐":
                        step(i, i + 2, self.cost(compound), [lead + compound + after], ())
                    else:
                        kinds = ("hyphen",)
                        if f := self.corrected(joined):
                            joined, kinds = f[0], ("hyphen", *("misread",) * f[1])
                        step(i, i + 2, min(self.cost(joined), base + self.cost(second) - GAIN), [lead + joined + after], kinds)
            elif i + 1 < n and not tail and not self.count(word):
                before, second, after = _core(tokens[i + 1])
                if not before and second.isalpha() and word.isalpha() and self.count(word + second) > 20:
                    step(i, i + 2, self.cost(word + second) + GAP, [lead + word + second + after], ("gap",))
            if not fix and word.isalpha() and len(word) > 5 and not self.count(word) and word.islower():
                for k in range(2, len(word) - 1):
                    if self.count(word[:k]) > 50 and self.count(word[k:]) > 50:
                        step(i, i + 1, self.cost(word[:k]) + self.cost(word[k:]) + SPLIT, [lead + word[:k], word[k:] + tail], ("split",))
        out: list[list[str]] = []
        kinds: Counter[str] = Counter()
        j = n
        while j:
            i, words, done = back[j]
            out.append(words)
            kinds.update(done)
            j = i
        return [w for words in reversed(out) for w in words], kinds


# Words after a hyphen that is not of a line end ("pre- and post-war").
SUSPENDING = frozenset("and or und oder bzw et ou y o e i lub oraz и или".split())

# --- page furniture -----------------------------------------------------------------------------------

# Letters and digits that scans confuse, folded for comparing headers and numbers.
_FOLD = str.maketrans({"0": "o", "1": "l", "!": "l", "i": "l", "|": "l", "ſ": "s", "c": "e", "f": "t", "b": "h", "9": "g", "5": "s", "j": "l"})
_PROCEEDINGS = re.compile(r"\S+ Pr[o0]c[ec][ec](?:d|cl)[il1!|](?:n|ri)[g9][sſ5]?s?, v[o0][il1!|]\. ?[\doOlI!|]+")
_CHAPTER = re.compile(r"(?<!in )(?<!see )(?<!of )(?<!\w)C[hb]ap[tf][ec]r [\doOlI!]{1,3}\. (?=[^\W\da-z])", re.M)


_NO_LETTER = re.compile(r"[\W\d_]+")


def skeleton(text: str) -> str:
    """Letters only, small, with confusable ones folded, and confusable pairs as the letters they stand for."""
    t = text.lower().replace("rn", "m").replace("ri", "n").replace("cl", "d").replace("ii", "u").replace("vv", "w").translate(_FOLD).replace("ll", "u").replace("ln", "n")
    return _NO_LETTER.sub("", t)


# a page number as printed or misread; it counts only if it is the chunk's own page or label
_N = r"[0-9oOsSgb!|IlivxLXV]{1,6}"
_OWN = re.compile(rf"[—–\-·•~=\[(|/]? ?(?:(?:[pPsS]|str|стр|pág)\. ?|(?:[Pp]age|Seite|Página|Strona|Страница|N[o0]?\.?) )?({_N})\.? ?[—–\-·•~=\])|/]?")
_SIDE_END = re.compile(rf"(?: {{2,}}| ?\[)({_N})\]?$")
_SIDE_START = re.compile(rf"^\[?({_N})(?:\] ?| {{2,}})(?=\S)")
_WITHIN = re.compile(rf"(?:^|(?<=\s))(?:[—–\-·•] ({_N}) [—–\-·•]|\[({_N})\]|[pS]\. ({_N})(?![\w–-])|({_N}) \|)(?=\s|$)")
_PLAIN = re.compile(rf"(?:^|(?<=[.?!”)] ))({_N})(?= [^\W\d_a-z])|(?<=[.?!”)] )({_N})$")
_DIGITS = str.maketrans({"o": "0", "O": "0", "l": "1", "I": "1", "!": "1", "|": "1", "i": "1", "s": "5", "S": "5", "g": "9", "b": "6"})
_ROMAN_FOLD = str.maketrans({"1": "i", "l": "i", "I": "i", "!": "i", "|": "i", "V": "v", "X": "x"})


@lru_cache(50_000)
def _number_forms(page: int | None, label: str | None) -> frozenset[str]:
    forms = {str(page)} if page is not None else set()
    if label and label.strip():
        forms.add(label.strip())
    return frozenset({f.translate(_DIGITS) if f.isdigit() else f.translate(_ROMAN_FOLD) for f in forms})


def _is_number(shown: str | None, forms: frozenset[str]) -> bool:
    return shown is not None and (shown.translate(_DIGITS) in forms or shown.translate(_ROMAN_FOLD) in forms)


_END = re.compile(r"[.?!。！？:…][\"'”’»)\]]*$")


_STOP = re.compile(r" {2,}| (?=\[|[—–\-·•] ?\d)")
_SENTENCE = re.compile(r" (?=[^\W\d_a-z])")


def chapter_end(text: str, start: int, width: int | None) -> int:
    """Where a chapter's header ends, in undone lines, whose words begin at ``start``: at a wide gap or a page number,
    else at the word end nearest to the ``width`` of headers, else where a sentence starts, else at once."""
    m = _STOP.search(text, start, start + (width or 75) + 3)
    if m:
        return m.start()
    if width is not None:
        if len(text) <= start + width:
            return len(text)
        ends = [i for i in range(start + width - 2, start + width + 3) if text[i : i + 1] in (" ", "")]
        if ends:
            return min(ends + [len(text)], key=lambda i: (abs(i - start - width), i))
    s = _SENTENCE.search(text, start, start + (width or 75))
    return s.start() if s else start


def title_end(text: str, start: int, title: str) -> int:
    """Where the stream from ``start`` on stops agreeing with the title, confused signs apart; never within a word."""
    x, y = start, 0
    while x < len(text) and y < len(title):
        if text[x] == title[y]:
            x, y = x + 1, y + 1
        elif pair := next(((bad, good) for bad, good in CONFUSIONS if text.startswith(bad, x) and title.startswith(good, y)), None):
            x, y = x + len(pair[0]), y + len(pair[1])
        elif y + 4 <= len(title) and text[x] != " " != title[y] and text[x - 1] != " " and text[x + 1 : x + 4] == title[y + 1 : y + 4]:
            x, y = x + 1, y + 1
        else:
            break
    if x < len(text) and text[x].isalnum() and text[x - 1].isalnum():
        x = max(text.rfind(" ", start, x), start)
    while x > start and text[x - 1].isspace():
        x -= 1
    return x


def furniture(text: str, title: str | None, names: str | None, page: int | None, label: str | None, width: int | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of running headers and page numbers, in order, apart from each other.

    ``width`` is the length at which the corpus cuts the words of chapter headers, if it does."""
    found: list[tuple[int, int, str]] = []
    forms = _number_forms(page, label)
    lines = text.split("\n")
    if forms:
        at = 0
        for line in lines:
            t = line.strip()
            if t and len(t) <= 75:
                if len(t) <= 14 and (m := _OWN.fullmatch(t)) and _is_number(m.group(1), forms):
                    found.append((at, at + len(line), "number"))
                elif ("  " in t or "[" in t) and ((m := _SIDE_END.search(t)) and _is_number(m.group(1), forms) or (m := _SIDE_START.match(t)) and _is_number(m.group(1), forms)):
                    found.append((at, at + len(line), "header"))
            at += len(line) + 1
        for m in _WITHIN.finditer(text):
            if _is_number(next(g for g in m.groups() if g), forms):
                before, after = text[: m.start()].rstrip(), text[m.end() :].lstrip()
                if m.group()[0] in "—–-·•" or not before or not after or _END.search(before[-4:]) or before[-1:].isupper() or m.group()[0] == "[" and after[:1].isupper():
                    found.append((*m.span(), "number"))
        found += [(*m.span(), "number") for m in _PLAIN.finditer(text) if _is_number(m.group(1) or m.group(2), forms)]
    if ". " in text and ", v" in text:
        found += [(*m.span(), "header") for m in _PROCEEDINGS.finditer(text)]
    for m in _CHAPTER.finditer(text) if "hap" in text else ():
        end = text.find("\n", m.start())
        found.append((m.start(), chapter_end(text, m.end(), width) if end < 0 else end, "header"))
    wanted = _beginning(title) if title else ""
    marks = [w for n in (names or "").split("; ") for w in re.findall(r"[^\W\d_]{4,}", n)]
    capitals = {w.upper() for w in marks}
    at = 0
    for k, line in enumerate(lines):
        s = line.strip()
        if s and len(s) <= 75 and not (len(lines) == 1 and len(s) > 70):
            head = False
            if len(wanted) >= 10 and len(s) >= 10 and not s.endswith((".", ",", ";")):
                # at the start of the line, or after the author's name; a body line would start small there
                for bare in (s, _AFTER_NAME.sub("", s, count=1) if ": " in s or " — " in s else ""):
                    head = head or bare[:1].isupper() and len(s) < len(title) + 40 and skeleton(bare[:30])[:12] == wanted[:12]
            if not head and s.isupper() and len(s) > 3 and (any(w in capitals for w in re.findall(r"[^\W\d_]{4,}", s)) or len(lines) > 1 and (k == 0 or not _END.search(lines[k - 1]) or k == len(lines) - 1) and not s.endswith((".", ",", ";"))):
                head = len(_LETTER.findall(s)) > 4
            if not head and (m := _NAME_TITLE.match(s)) and not _END.search(s) and not s.endswith((",", ";")):
                head = (k == 0 or k == len(lines) - 1 or not _END.search(lines[k - 1].rstrip())) and len(lines) > 1
            if head:
                found.append((at, at + len(line), "header"))
        at += len(line) + 1
    if len(lines) == 1 or "\n\n" in text:
        # undone lines: the header stands within the stream, beside a number or in capitals
        for m in _CAPITALS.finditer(text):
            if any(w in capitals for w in re.findall(r"[^\W\d_]{4,}", m.group())) or title and len(m.group()) > 12 and skeleton(m.group())[:12] == wanted[:12]:
                found.append((*m.span(), "header"))
        if title and len(title) >= 12 and (i := text.find(title[:18])) >= 0:
            found.append((i, title_end(text, i, title), "header"))
    merged: list[tuple[int, int, str]] = []
    for x, y, kind in sorted(found):
        if merged and x <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(y, merged[-1][1]), merged[-1][2])
        else:
            merged.append((x, y, kind))
    return merged


_NAME_TITLE = re.compile(r"(?:[^\W\d_][\w’'-]*\.? ){1,3}— [^\W\d_a-z]|(?:[^\W\d_a-z][\w’'-]+ ?){1,3}: [^\W\d_a-z]")
@lru_cache(20_000)
def _beginning(title: str) -> str:
    return skeleton(title[:30])


_AFTER_NAME = re.compile(r"^[^.?!]{2,40}?(?: [—–] |: )")
_CAPITALS = re.compile(r"(?<![\w])[^\W\d_a-zà-ÿ]{2,}(?:[ '’–—:,-]+[^\W\d_a-zà-ÿ]{2,}|[ ][A-Z](?= ))*")
_WORDBREAK = re.compile(r"[^\W\d_][-‐­¬](?:[ \t]*\n\s*|[ \t]+)[^\W\d_A-ZÀ-Þ]")
_STREAM = re.compile(r"(\S+)(\s*)")


def examine(text: str, lexicon: Lexicon, title: str | None, names: str | None, page: int | None, label: str | None, width: int | None = None) -> Counter[str]:
    """How many repairs of each kind the text needs; cheap for texts of known words."""
    text = without_model(text)  # garbled hyphens and titles are still hyphens and titles
    kinds = Counter(k for *_, k in furniture(text, title, names, page, label, width))
    # words cut off at the ends of the chunk are no misread ones
    tokens = text.split()
    if tokens and text[-1:].isalnum() and not (len(tokens) > 1 and tokens[-2][-1] in HYPHENS):
        tokens.pop()
    if tokens and tokens[0][0].islower() and tokens[0][-1] not in HYPHENS:
        tokens = tokens[1:]
    if any(map(lexicon.status.__getitem__, set(tokens))) or _WORDBREAK.search(text):
        kinds.update(lexicon.decode(tokens)[1])
    return kinds


def paragraphs(lines: list[str]) -> list[list[str]]:
    """Lines grouped into paragraphs by dynamic programming: a break costs where a line runs to the margin
    without an end sign or the next starts small, a join where a line is short, blank or before a list item."""
    if not lines:
        return []
    width = sorted(len(x) for x in lines)[int(0.8 * (len(lines) - 1))] or 1
    brk, join = [], []
    for a, b in zip(lines, lines[1:]):
        ended, short, small = bool(_END.search(a.rstrip())), len(a.rstrip()) < 0.75 * width, b.lstrip()[:1].islower()
        item = bool(re.match(r"\s*(?:[-*•]|\d{1,3}[.)])\s", b)) or "|" in a or "\t" in a
        brk.append(0.0 if not a.strip() or not b.strip() else 4.0 * (not ended) + 2.0 * (not short) + 6.0 * small)
        join.append(8.0 if not a.strip() or not b.strip() else 7.0 * item + 5.0 * (short and ended) + 1.5 * short)
    n = len(lines)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        inner = 0.0
        for i in range(j - 1, -1, -1):
            cost = best[i] + inner + (brk[i - 1] if i else 0.0)
            if cost < best[j]:
                best[j], back[j] = cost, i
            if i:
                inner += join[i - 1]
                if inner > best[j]:
                    break
    out, j = [], n
    while j:
        out.append(lines[back[j] : j])
        j = back[j]
    return [p for p in reversed(out) if any(x.strip() for x in p)]


def repair(text: str, lexicon: Lexicon, title: str | None = None, names: str | None = None, page: int | None = None, label: str | None = None, width: int | None = None) -> tuple[str, Counter[str]]:
    """The text as continuous paragraphs separated by empty lines, and what was repaired."""
    text = without_model(text)
    spans = furniture(text, title, names, page, label, width)
    kinds = Counter(k for *_, k in spans)
    for a, b, _ in reversed(spans):
        text = text[:a] + text[b:].removeprefix(" ")
    if not kinds and not _WORDBREAK.search(text) and not any(map(lexicon.status.__getitem__, set(text.split()))) and "\n" not in text:
        return text, kinds
    out = []
    for block in re.split(r"\n[ \t]*\n", text):
        for group in paragraphs([x for x in block.split("\n") if x.strip()]):
            tokens = " ".join(group).split()
            words, repairs = lexicon.decode(tokens)
            kinds.update(repairs)
            out.append(" ".join(words))
    return "\n\n".join(p for p in out if p), kinds


# --- on Spark ---------------------------------------------------------------------------------------


def lexicon_of(records: DataFrame, text: str, *, most: int = LEXICON_WORDS, least: int = LEAST_COUNT) -> Vocabulary:
    """Counts of the words of all records that are seen ``least`` times.

    The ``most`` frequent of up to ``LONGEST`` signs are broadcast, which bounds that; all others stream through the driver,
    one partition at a time, into a file that Spark's file server hands to every executor."""
    spark = records.sparkSession
    ship(spark)

    def words(counts: Counter[str]) -> pa.RecordBatch:
        total: Counter[str] = Counter()
        for token, n in counts.items():
            word = _core(token)[1]
            if word and _LETTER.search(word):
                total[word] += n
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        signs = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(t.split())
                signs += len(t)
            if len(counts) > 400_000 or signs > MOST_SIGNS:
                yield words(counts)
                counts.clear()
                signs = 0
        yield words(counts)

    counted = records.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counted = counted.persist(StorageLevel.DISK_ONLY)
    try:
        long = F.length("word") > LONGEST
        kept = counted.where(~long).orderBy(F.desc("n"), "word").limit(most).toArrow()
        found = Vocabulary(zip(kept.column("word").to_pylist(), kept.column("n").to_pylist()))
        found.total = sum(found.values())
        others = F.lit(True)
        if found:
            word, n = next(reversed(found.items()))
            others = long | (F.col("n") < n) | (F.col("n") == n) & (F.col("word") > F.lit(word))
        rest = ((r.word, r.n) for r in counted.where(others).toLocalIterator())
        if first := next(rest, None):
            path = os.path.join(spark.sparkContext._temp_dir, f"lexicon-{uuid4().hex}.db")
            found.total += Filed.write(path, chain([first], rest))
            spark.sparkContext.addFile(path)
            found.filed = os.path.basename(path)
    finally:
        counted.unpersist()
    return found


def is_scan(chunk_id: str = "chunk_id"):
    """Chunks of PDF attachments, by the form of their id."""
    return F.col(chunk_id).rlike(r"^[^:]*:p[0-9]+:")


def header_width(chunks: DataFrame) -> int | None:
    """The length of the words of most chapter headers that end with their line; None where there is no such length."""
    words = r"(?m)C[hb]ap[tf][ec]r [0-9oOlI!]{1,3}\. ([^\n]+?)(?: *\[[^\n]*| {2,}[^\n]*)?\n"
    shown = chunks.where(is_scan() & F.col("text").contains("hap")).select(F.explode(F.regexp_extract_all("text", F.lit(words), F.lit(1))).alias("words"))
    counts = {r[0]: r[1] for r in shown.groupBy(F.length("words").alias("n")).count().collect()}
    most = max(counts, key=lambda n: (counts[n], -n), default=None)
    return most if most and 2 * counts[most] > sum(counts.values()) else None


def repaired(chunks: DataFrame, counts: dict[str, int], *, only_kinds: bool = False) -> DataFrame:
    """chunk_id, the repaired text (unless ``only_kinds``) and the number of repairs by kind of each affected chunk."""
    spark = chunks.sparkSession
    ship(spark)
    shared, width = spark.sparkContext.broadcast(counts), header_width(chunks)
    kinds = ("hyphen", "misread", "gap", "split", "header", "number")
    schema = T.StructType([T.StructField("chunk_id", T.StringType()), *([] if only_kinds else [T.StructField("repaired", T.StringType())]), *(T.StructField(k, T.IntegerType()) for k in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch in batches:
            at, texts, found = [], [], []
            columns = [batch.column(i).to_pylist() for i in range(1, 6)]
            for row, (text, title, names, page, label) in enumerate(zip(*columns)):
                needs = examine(text, lexicon, title, names, page, label, width)
                if needs:
                    at.append(row)
                    if not only_kinds:
                        fixed, needs = repair(text, lexicon, title, names, page, label, width)
                        texts.append(fixed)
                    found.append(needs)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *([] if only_kinds else [pa.array(texts, pa.string())]), *(pa.array([f.get(k, 0) for f in found], pa.int32()) for k in kinds)], names=schema.names)

    return chunks.where(is_scan() & F.col("text").isNotNull()).select("chunk_id", "text", "title", "creators", "page", "page_label").mapInArrow(run, schema)
