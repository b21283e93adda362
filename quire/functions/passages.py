"""From text to passages in plain Python, for Arrow batches: cleaning, paragraphs, splitting, merging.

Equal to the columns of the same names in ``functions.text``, which a test holds them against.  The folds there
copy their accumulator at every step, which is quadratic in the parts of a text, and each of the patterns
is one more pass over it; these are not."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

from quire.config import DEFAULT, EngineConfig
from quire.functions.text import CJK, CJK_LEAST, CONTROL, LATIN_MOST, SAMPLE_CHARS, SENTENCE_ENDS

# Unicode white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACED = re.compile(rf"(?<=[{SENTENCE_ENDS}])[{SPACE}]+")
_CLOSE = re.compile(rf"(?<=[{SENTENCE_ENDS}])[{SPACE}]*")
_CJK = re.compile(f"[{CJK}]")
_LATIN = re.compile("[A-Za-z]")
_SOLID = re.compile(f"[^{SPACE}]")

_GAP = SPACE.replace("\n", "")
_CONTROL = re.compile(CONTROL)
_NEWLINE = re.compile("\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
_BLANK = re.compile(rf"\n(?:[{_GAP}]*\n)+")
_HYPHEN = re.compile(rf"-[{_GAP}]*\n[{SPACE}]*")
_LINE_END = re.compile(rf"[{_GAP}]*\n[{SPACE}]*")
_RUN = re.compile(rf"[{SPACE}]+")

#: Columns of an assembled chunk: id, text, places, and what merging says of it.
Chunk = tuple[str, str, str, int, int, int | None, bool | None, int | None, str | None]


def is_cjk(text: str) -> bool:
    if not _CJK.search(text):
        return False
    solid = max(1, len(_SOLID.findall(text)))
    return len(_CJK.findall(text)) / solid >= CJK_LEAST and len(_LATIN.findall(text)) / solid <= LATIN_MOST


def clean(text: str) -> str:
    text = _CONTROL.sub("", text)
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).replace("\ufffd", "")


def paragraphs(text: str, glue: str) -> list[str]:
    out = []
    for part in _BLANK.split(_NEWLINE.sub("\n", text)):
        undone = _HYPHEN.sub("", part.strip(SPACE))
        if p := _RUN.sub(" ", _LINE_END.sub("\n", undone).replace("\n", glue)).strip(SPACE):
            out.append(p)
    return out


def is_gibberish(text: str) -> bool:
    counts = Counter(text)
    for c in SPACE:
        counts.pop(c, None)
    n = counts.total()
    if n < 50:
        return False
    kinds: Counter[str] = Counter()
    for c, times in counts.items():
        kinds[unicodedata.category(c)] += times
    shown = sum(v for k, v in kinds.items() if k[0] not in "CZ")
    written = sum(v for k, v in kinds.items() if k[0] == "L" or k == "Nd")
    return shown / n < 0.90 or written / n < 0.20


def chunks_of(owner: str, kind: str, text: str, whole_sample: bool, config: EngineConfig = DEFAULT) -> list[Chunk]:
    """The chunks of a document; a gibberish one has none, by its first paragraphs or by the whole of it."""
    text = clean(text)
    paras = paragraphs(text, "" if is_cjk(text[:SAMPLE_CHARS]) else " ")
    sample = text if whole_sample else "\n\n".join(paras[:20])[:5000]
    if not paras or is_gibberish(sample):
        return []
    least = config.min_chunk_chars_no_space if is_cjk(sample.strip(SPACE)[:SAMPLE_CHARS]) else config.min_chunk_chars
    return merge_short(records(owner, kind, paras, None, config), least, config)


def split_long(text: str | None, config: EngineConfig = DEFAULT) -> list[str] | None:
    """Parts of at most ``max_chars``; null for null."""
    if text is None:
        return None
    text, most = text.strip(SPACE), config.max_chars
    if len(text) <= most:
        return [text]
    cjk = is_cjk(text)
    glue, back = "" if cjk else " ", config.overlap_chars or (config.overlap_chars_cjk if cjk else config.overlap_chars_latin)
    pieces = _SPACED.split(text)
    if len(pieces) == 1:
        pieces = _CLOSE.split(text)
    packed: list[str] = []
    buffer: list[str] = []
    size = 0
    for s in filter(None, (p.strip(SPACE) for p in pieces)):
        if buffer and size + len(glue) + len(s) > most:
            packed.append(glue.join(buffer))
            buffer, size = [], 0
        size += len(s) + (len(glue) if buffer else 0)
        buffer.append(s)
    if buffer:
        packed.append(glue.join(buffer))
    out: list[str] = []
    before = ""
    step = max(1, most - most // 4 if back >= most else most - back)
    for part in packed:
        keep = max(0, min(back, most - len(part)))
        before = (before[-keep:] if keep else "") + part
        if len(before) <= most:
            out.append(before)
        else:
            out += [before[i * step : i * step + most].strip(SPACE) for i in range(-(-(len(before) - most) // step) + 1)]
    return [x for x in out if x]


def records(owner: str, kind: str, paras: list[str], chapters: list[int] | None, config: EngineConfig = DEFAULT) -> list[Chunk]:
    """The parts with the hard minimum length; part indexes of shorter ones stay consumed."""
    out: list[Chunk] = []
    for i, para in enumerate(paras):
        locator = f"{kind}:para{i}"
        for j, part in enumerate(split_long(para, config) or ()):
            if len(part := part.strip(SPACE)) >= config.hard_min_chars:
                out.append((f"{owner}:{locator}:part{j}", part, locator, i, j, chapters[i] if chapters is not None else None, None, None, locator))
    return out


def merge_short(found: list[Chunk], least: int, config: EngineConfig = DEFAULT) -> list[Chunk]:
    """Short chunks grow by the next as long as they fit; a short tail joins the chunk before it."""

    def grown(a: Chunk, text: str, end: str | None) -> Chunk:
        return (*a[:1], f"{a[1]}\n\n{text}", *a[2:6], True, (a[7] or 1) + 1, end or a[8])

    done: list[Chunk] = []
    current: Chunk | None = None
    for r in found:
        if current is None:
            current = r
        elif len(current[1]) < least and len(current[1]) + 2 + len(r[1]) <= config.max_chars:
            current = grown(current, r[1], r[2])
        else:
            done.append(current)
            current = r
    if current is not None:
        if done and len(current[1]) < least and len(done[-1][1]) + 2 + len(current[1]) <= config.max_chars:
            done[-1] = grown(done[-1], current[1], current[8])
        else:
            done.append(current)
    return [(*c[:8], c[8] if c[6] else None) for c in done]
