"""Problem 5: markup residue of up to four families, sometimes mixed, in notes.

A lexer cuts a note into signs and tags and masks code samples.  It accepts none of them: a dollar sign, star
or unknown ``<word>`` is only proposed.  Each is differentiated by its context (what stands on either side of
it), and within a note openings and closings are matched in order and nested.  Over all notes, openings and
closings whose occurrence vectors (how often in which note) agree form an equivalence class; a class whose
tokens nest is valid, and only the matched tokens of valid classes are markup.  Tokens that only open
belong to the class in whose slots they always stand, where their own vector equals that of the class.
Signs that have no partner by nature (entities, headings, list marks, single tags) are
taken by the grammar of their family.  The valid classes of a note, nested, are its template; what stands in
the slots, with headings, lists, code and formulas marked, is the clean text.

Vectors are compared note by note and by sums of hashes, so no vector is ever gathered.  Defined results: a
null note has a null clean text and no family, an empty or blank one an empty text and none; repeated rows
of a note give its rows once; of several sightings with different texts, each counts.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import checkpointed, ship

# Names of HTML elements, and commands of LaTeX that stand without braces.
ELEMENTS = frozenset("a abbr acronym address article aside b base bdi bdo big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript o:p object ol option p param picture pre q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr track tt u ul var video wbr w:p st1:place".split())
BARE_COMMANDS = frozenset("item alpha beta gamma delta epsilon lambda mu pi sigma omega leq geq neq times cdot sum int infty ldots dots LaTeX TeX par newline noindent centering hline maketitle tableofcontents footnotesize small large bf it em pm approx rightarrow to in".split())
#: Most rounds of nested templates.
ROUNDS = 20

#: Share of the notes with a token in which its openings and closings must agree, for its class to be valid.
LEAST_AGREEMENT = 0.8

_COMMENT = re.compile(r"<!--.*?(?:-->|$)", re.S)
_TAG = re.compile(r"</?([A-Za-z][\w:]*)((?:\s+[^<>]*)?)/?>")
_CODE = re.compile(
    r"(?P<open><(?P<tag>pre|code|script|style|kbd|samp|source|syntaxhighlight|nowiki|verbatim)\b(?![^<>]*class\s*=\s*[\"']?math)[^<>]*>)(?P<body>.*?)(?P<close></(?P=tag)\s*>)"
    r"|(?P<fence>(?:^|(?<=>))(?:```|~~~)[^\n`]*$)(?P<fbody>.*?)(?P<fclose>^(?:```|~~~)[ \t]*(?=$|</)|\Z)"
    r"|(?P<lopen>\\begin\{(?P<env>verbatim|lstlisting)\})(?P<lbody>.*?)(?P<lclose>\\end\{(?P=env)\})"
    r"|(?P<tick>(?<!`)`(?!`))(?P<tbody>[^`\n]+)(?P<tclose>`)",
    re.S | re.M | re.I,
)
_CODE_MARK = re.compile(r"`|~~~|<(?:pre|code|script|style|kbd|samp|source|syntaxhighlight|nowiki|verbatim)\b|\\begin\{(?:verbatim|lstlisting)", re.I)
_MATH = re.compile(r"\$\$(?P<a>.+?)\$\$|\\\[(?P<b>.+?)\\\]|\\\((?P<c>.+?)\\\)|(?<![\\$\w])\$(?P<d>(?=[^$\n]*[\\^_={}])[^\s$](?:[^$\n]*[^\s$\\])?)\$(?![\d$])|(?P<e>\\begin\{(?P<env>equation|align|displaymath|eqnarray|math|gather)\*?\}.+?\\end\{(?P=env)\*?\})", re.S)
# Accent commands, the letters they stand on and the combining marks they make.
_ACCENT = re.compile(r"(?<=[^\W\d_])\\(?P<mark>[\"'`^~])(?:\{(?P<in>[AEIOUYNCSZaeiouyncsz])\}|(?P<on>[AEIOUYNCSZaeiouyncsz]))|\\(?P<mark2>[\"'`^~cvu])\{(?P<in2>[A-Za-z])\}")
_MARKS = {'"': "̈", "'": "́", "`": "̀", "^": "̂", "~": "̃", "c": "̧", "v": "̌", "u": "̆"}
# Marks at the start of a line, which have no partner, and the signs of pairs and single signs within lines.
_LINE = re.compile(
    r"^(?:(?P<heading>[ ]{0,3}\#{1,6}[ ]+(?=\S))|(?P<under>(?<=\S\n)[ ]{0,3}(?:={3,}|-{3,})[ ]*$)"
    r"|(?P<rule>[ ]*\|?[ ]*:?-{3,}:?[ ]*(?:\|[ ]*:?-{3,}:?[ ]*)*\|?[ ]*$(?<=\|)|[ ]*\|?[ ]*:?-{3,}:?[ ]*\|.*-{3,}:?[ ]*\|?[ ]*$)"
    r"|(?P<task>[ ]*[-*+][ ]\[[ xX]\][ ])|(?P<quote>[ ]{0,3}>[ ]?(?=\S))|(?P<number>[ ]{0,3}\d{1,3}\.[ ]+(?=\S))|(?P<item>[ ]{0,3}[-*+][ ]+(?=\S))"
    r"|(?P<line>\*+(?=[ ]*[^\s*])(?![^*\n]+\*)|[\#:;]+[ ]+(?=\S))|(?P<magic>\#REDIRECT)|(?P<link>\[[^\[\]\n]+\]:[ ]+\S+))",
    re.M,
)
_CANDIDATE = re.compile(r"[&\\_~!\[\]={}'*$|]")
_SIGN = re.compile(
    r"(?P<entity>&(?:\#\d{2,7}|\#[xX][0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,30});)"
    r"|(?P<accent>(?<=[^\W\d_])\\[\"'`^~](?:\{[AEIOUYNCSZaeiouyncsz]\}|[AEIOUYNCSZaeiouyncsz])|\\[\"'`^~cvu]\{[A-Za-z]\})"
    r"|(?P<env>\\(?:begin|end)\{[^{}\n]*\})|(?P<display>\\[\[\]()])"
    r"|\\(?P<command>[A-Za-z]+)\*?(?P<brace>(?:\[[^\[\]\n]*\])?(?=\{))?"
    r"|(?P<magic>__[A-Z]{3,}__|~{3,5})"
    r"|(?P<link>!?\[[^\[\]\n]*\]\([^()\s]*(?:[ ]+\"[^\"\n]*\")?\)|(?<!\[)\[[^\[\]\n]+\]\[[^\[\]\n]*\])|(?P<outer>\[https?://\S+[ ][^\[\]\n]+\])"
    r"|(?P<level>^={1,6}(?=[ ]*[^=\s])|(?<!=)={1,6}(?=[ ]*$))"
    r"|(?P<sign>\*{1,3}|_{1,2}|~~|'{2,5}|\[\[|\]\]|\{\{|\}\}|^\{\||^\|\}|\${1,2})",
    re.M,
)
# Family of each sign of a pair, and of the single signs; signs that need a free side.
_PAIRS = {"*": "markdown", "**": "markdown", "***": "markdown", "_": "markdown", "__": "markdown", "~~": "markdown", "''": "wiki", "'''": "wiki", "''''": "wiki", "'''''": "wiki", "[[": "wiki", "]]": "wiki", "{{": "wiki", "}}": "wiki", "{|": "wiki", "|}": "wiki", "$": "latex", "$$": "latex"}
_SINGLES = {"heading": "markdown", "under": "markdown", "rule": "markdown", "task": "markdown", "quote": "markdown", "link": "markdown", "magic": "wiki", "outer": "wiki", "accent": "latex"}
_OPENS = {"]]": "[[", "}}": "{{", "|}": "{|", "\\]": "\\[", "\\)": "\\("}
_FREE_SIDE = frozenset(("*", "_", "__", "$"))
_WIKI_TAGS = frozenset("ref references gallery nowiki math".split())
_VOID = frozenset("br hr img wbr meta link input col".split())
_BLOCK_OPEN = re.compile(r"<(?:p|div|td|blockquote)\b[^<>]*>", re.I)


@dataclass(frozen=True)
class Token:
    start: int
    end: int
    family: str
    name: str
    role: str  # open and close of a matched pair; loose: without its partner; single: has none by nature
    context: str = ""


def code_spans(text: str) -> list[tuple[int, int, int, int, str]]:
    """(start, body start, body end, end, kind) of code samples; kind is html, wiki, markdown or latex."""
    out = []
    for m in _CODE.finditer(text) if _CODE_MARK.search(text) else ():
        if m.group("tag"):
            kind = "wiki" if m.group("tag").lower() in ("nowiki", "syntaxhighlight") else "html"
            out.append((m.start(), m.start("body"), m.end("body"), m.end(), kind))
        elif m.group("fence"):
            out.append((m.start(), m.start("fbody"), m.end("fbody"), m.end(), "markdown"))
        elif m.group("env"):
            out.append((m.start(), m.start("lbody"), m.end("lbody"), m.end(), "latex"))
        else:
            out.append((m.start(), m.start("tbody"), m.end("tbody"), m.end(), "markdown"))
    return out


def _masked(s: str) -> str:
    return "\n".join("\x00" * len(x) for x in s.split("\n"))


def _context(text: str, a: int, b: int, name: str) -> tuple[str, bool, bool]:
    """Context of a sign, and whether it can open and close there: it must face its slot."""
    before, after = text[a - 1 : a] or "\n", text[b : b + 1] or "\n"
    opens, closes = not after.isspace(), not before.isspace()
    if name in _FREE_SIDE:
        opens, closes = opens and not (before.isalnum() or before == "_"), closes and not (after.isalnum() or after == "_")
    side = "both" if opens and closes else "left" if opens else "right" if closes else "none"
    return side + (" digit" if opens and after.isdigit() else ""), opens, closes


class _Matcher:
    """Openings and closings of one note, matched in order."""

    def __init__(self, text: str) -> None:
        self.text, self.out = text, []
        self.waiting: dict[str, tuple[int, int, str]] = {}
        self.stack: list[tuple[str, str, int, int]] = []

    def pair(self, family: str, name: str, first: tuple[int, int, str], second: tuple[int, int, str]) -> None:
        self.out += [Token(first[0], first[1], family, name, "open", first[2]), Token(second[0], second[1], family, name, "close", second[2])]

    def loose(self, family: str, name: str, at: tuple[int, int, str]) -> None:
        self.out.append(Token(at[0], at[1], family, name, "loose", at[2]))

    def drop(self, family: str, name: str) -> None:
        if at := self.waiting.pop(name, None):
            self.loose(family, name, at)

    def alike(self, family: str, name: str, a: int, b: int, *, lines: bool = False) -> None:
        """A sign that opens and closes; its partner is the next of its kind, on its line unless ``lines``."""
        context, opens, closes = _context(self.text, a, b, name)
        at, last = (a, b, context), self.waiting.get(name)
        if last and closes and last[1] < a and (lines or "\n" not in self.text[last[1] : a]):
            self.pair(family, name, self.waiting.pop(name), at)
            return
        self.drop(family, name)
        if opens:
            self.waiting[name] = at
        else:
            self.loose(family, name, at)

    def level(self, a: int, b: int) -> None:
        """Signs of a wiki heading, at both ends of a line."""
        name = self.text[a:b]
        first = a == 0 or self.text[a - 1] == "\n"
        last = self.waiting.pop("=", None)
        if not first and last and last[1] - last[0] == b - a and "\n" not in self.text[last[1] : a]:
            self.pair("wiki", "=", last, (a, b, "end"))
            return
        if last:
            self.loose("wiki", "=", last)
        if first and name:
            self.waiting["="] = (a, b, "start")
        else:
            self.loose("wiki", "=", (a, b, "end"))

    def opening(self, family: str, name: str, a: int, b: int) -> None:
        self.stack.append((family, name, a, b))

    def closing(self, family: str, name: str, a: int, b: int, *, line: bool = False) -> None:
        """Closes the innermost opening of the name; what was opened within it stays loose."""
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][:2] == (family, name)), None)
        if at is None or line and "\n" in self.text[self.stack[at][3] : a]:
            self.loose(family, name, (a, b, "close"))
            return
        for f, n, x, y in self.stack[at + 1 :]:
            self.loose(f, n, (x, y, "open"))
        _, _, x, y = self.stack[at]
        del self.stack[at:]
        self.pair(family, name, (x, y, "open"), (a, b, "close"))

    def finish(self) -> list[Token]:
        for name, at in self.waiting.items():
            self.loose("wiki" if name == "=" else _PAIRS[name], name, at)
        for f, n, x, y in self.stack:
            self.loose(f, n, (x, y, "open"))
        return self.out


def _signs(text: str) -> Iterator[re.Match[str]]:
    """Marks of lines and signs, apart from each other, in order."""
    marks = {m.start(): m for m in _LINE.finditer(text)}
    starts = sorted(marks)
    at = nth = 0
    while True:
        c = _CANDIDATE.search(text, at)
        here = c.start() if c else len(text) + 1
        if nth < len(starts) and starts[nth] <= here:
            m, nth = marks[starts[nth]], nth + 1
        elif c is None:
            return
        elif (m := _SIGN.match(text, here)) is None:
            at = here + 1
            continue
        yield m
        at = max(at, m.end())


def lex(text: str) -> list[Token]:
    """Proposed tokens of all families, in order; code samples hold none, formulas only those of LaTeX."""
    out: list[Token] = []
    work = text
    for a, body, end, b, kind in code_spans(text):
        name = re.match(r"<(\w+)", text[a:b]).group(1).lower() if kind in ("html", "wiki") else "`" if kind == "markdown" else "code"
        out += [Token(a, body, kind, name, "open", "code"), Token(end, b, kind, name, "close", "code")]
        work = work[:a] + _masked(work[a:b]) + work[b:]
    if "<" in work:
        out += [Token(m.start(), m.end(), "html", "!--", "single") for m in _COMMENT.finditer(work)]
        work = _COMMENT.sub(lambda m: _masked(m.group()), work)
        tags = _Matcher(work)
        for m in _TAG.finditer(work):
            name = m.group(1).lower()
            family = "wiki" if name in _WIKI_TAGS else "html"
            if name in _VOID or m.group().endswith("/>"):
                out.append(Token(m.start(), m.end(), family, name, "single"))
            elif m.group()[1] == "/":
                tags.closing(family, name, m.start(), m.end())
            else:
                tags.opening(family, name, m.start(), m.end())
        out += tags.finish()
        # signs within tags are none of other families; a block starts a line
        work = _BLOCK_OPEN.sub(lambda m: "\x00" * (len(m.group()) - 1) + "\n", work)
        work = _TAG.sub(lambda m: _masked(m.group()), work)
    signs, lines = _Matcher(work), []
    for m in _signs(work):
        kind, (a, b) = m.lastgroup, m.span()
        if kind == "sign":
            name = m.group()
            if name in ("[[", "{{", "{|"):
                signs.opening("wiki", name, a, b)
            elif name in _OPENS:
                signs.closing("wiki", _OPENS[name], a, b, line=name == "]]")
            else:
                signs.alike(_PAIRS[name], name, a, b, lines=name == "$$")
        elif kind == "entity":
            if m.group()[1] == "#" or m.group()[1:] in html5:
                out.append(Token(a, b, "html", "&", "single"))
        elif kind == "env":
            name = f"env {m.group().partition('{')[2][:-1]}"
            (signs.opening if m.group()[1] == "b" else signs.closing)("latex", name, a, b)
        elif kind == "display":
            (signs.closing if m.group() in _OPENS else signs.opening)("latex", _OPENS.get(m.group(), m.group()), a, b)
        elif kind in ("command", "brace"):
            name = m.group("command")
            if m.group("brace") is not None:
                end = work.find("}", b)
                out += [Token(a, b, "latex", name, "open", "command"), Token(end, end + 1, "latex", name, "close", "command")] if end >= 0 else [Token(a, b, "latex", name, "loose", "command")]
            elif not re.match(r"[\w{\\]", work[b : b + 1] or " "):
                out.append(Token(a, b, "latex", name, "single"))
        elif kind == "level":
            signs.level(a, b)
        elif kind in ("item", "number", "line"):
            lines.append((kind, m))
        else:
            out.append(Token(a, b, _SINGLES[kind], kind, "single"))
    out += signs.finish()
    # within formulas only LaTeX is left
    spans = _formulas(out)
    if spans:
        out = [t for t in out if t.family == "latex" or not any(a < t.start < b for a, b in spans)]
    sure = {t.family for t in out if t.role in ("open", "single")}
    wiki, marked = "wiki" in sure, "markdown" in sure
    numbers = sum(kind == "number" for kind, _ in lines)
    for kind, m in lines:
        sign = m.group().strip()
        if kind == "number":
            if numbers > 1 or marked:
                out.append(Token(*m.span(), "markdown", "item", "single"))
        elif wiki and (kind == "line" and (sign[0] in "#:;" or len(sign) > 1) or sign == "*" and not marked):
            out.append(Token(*m.span(), "wiki", "item", "single"))
        elif kind == "item":
            out.append(Token(*m.span(), "markdown", "item", "single"))
    return sorted(set(out), key=lambda t: (t.start, -t.end, t.role))


def _formulas(tokens: list[Token]) -> list[tuple[int, int]]:
    """Spans between matched dollar signs and display brackets."""
    out, opened = [], {}
    for t in sorted((t for t in tokens if t.name in ("$", "$$", "\\[", "\\(") and t.role in ("open", "close")), key=lambda t: t.start):
        if t.role == "open":
            opened[t.name] = t.end
        elif t.name in opened:
            out.append((opened.pop(t.name), t.start))
    return out


def grammatical(t: Token) -> bool:
    """Tokens without a partner by nature that the grammar of their family knows; tags may stay unclosed."""
    if t.family == "html":
        return t.name in ELEMENTS or t.name in ("!--", "&")
    return t.role == "single" and (t.family != "latex" or t.name == "accent" or t.name in BARE_COMMANDS) or t.name in _WIKI_TAGS or t.context == "code"


def surroundings(tokens: list[Token]) -> dict[tuple[str, str], set[str]]:
    """The names of the innermost matched openings around the tokens of each name."""
    stack: list[tuple[str, str]] = []
    around: dict[tuple[str, str], set[str]] = {}
    for t in tokens:
        key = (t.family, t.name)
        if t.role == "close":
            if key in stack:
                del stack[len(stack) - 1 - stack[::-1].index(key) :]
        else:
            outer = [k for k in stack if k[0] == t.family]
            around.setdefault(key, set()).add(outer[-1][1] if outer else "")
            if t.role == "open":
                stack.append(key)
    return around


# --- clean text -----------------------------------------------------------------------------------------

_BLOCKS = frozenset("p div section article header footer main aside ul ol dl table tr blockquote pre h1 h2 h3 h4 h5 h6 figure hr o:p".split())


def clean(text: str | None, template: frozenset[str] | None = None) -> str | None:
    """Text of the slots between the tokens of ``template`` (``family name`` each; None for all the grammar knows),
    with ``# `` headings, ``- `` and ``1. `` lists, fenced code and ``$`` formulas, without other markup."""
    if text is None:
        return None
    has = (lambda family: True) if template is None else {t.partition(" ")[0] for t in template}.__contains__
    emphasis = template is None or not template.isdisjoint(("markdown *", "markdown _"))
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x01{len(kept) - 1}\x02"

    def code(m: re.Match[str]) -> str:
        body = next(g for g in (m.group("body"), m.group("fbody"), m.group("lbody"), m.group("tbody")) if g is not None)
        if m.group("tag"):
            body = html.unescape(re.sub(r"</?(?:code|span|pre)\b[^<>]*>", "", body))
            if m.group("tag").lower() in ("script", "style"):
                return " "
        inline = m.group("tbody") is not None or m.group("tag") and "\n" not in body and m.group("tag").lower() != "pre"
        return keep(f"`{body}`") if inline else "\n\n" + keep("```\n" + body.strip("\n") + "\n```") + "\n\n"

    s = _CODE.sub(code, text) if _CODE_MARK.search(text) else text
    s = _COMMENT.sub("", s)
    s = s if not has("latex") else _MATH.sub(lambda m: "\n\n" + keep("$$" + (m.group("a") or m.group("b") or re.sub(r"\\(?:begin|end)\{[^{}]*\}", "", m.group("e") or "")).strip() + "$$") + "\n\n" if m.group("a") or m.group("b") or m.group("e") else keep("$" + (m.group("c") or m.group("d")) + "$"), s)
    for _ in range(3):  # tags written as entities
        if not re.search(r"&lt;/?[A-Za-z][^&<>]{0,80}&gt;", s):
            break
        s = re.sub(r"&lt;(/?[A-Za-z][^&<>]{0,80})&gt;", r"<\1>", s)
    number: list[int] = []

    def tag(m: re.Match[str]) -> str:
        name, closing = m.group(1).lower(), m.group()[1] == "/"
        if name in ("ref", "references"):
            return ""
        if name not in ELEMENTS and (template is None or f"html {name}" not in template) and name not in ("gallery", "math", "nowiki"):
            return m.group()
        if name == "br":
            return "\n"
        if name in ("ol", "ul"):
            if closing and number:
                number.pop()
            elif not closing:
                number.append(0 if name == "ol" else -1)
            return "\n\n"
        if name == "li":
            if closing:
                return "\n"
            if number and number[-1] >= 0:
                number[-1] += 1
                return f"\n{number[-1]}. "
            return "\n- "
        if re.fullmatch(r"h[1-6]", name):
            return "\n\n" if closing else "\n\n" + "#" * int(name[1]) + " "
        if name in ("td", "th"):
            return " | " if closing else ""
        return "\n" if name == "tr" else "\n\n" if name in _BLOCKS else ""

    if has("html") or has("wiki"):
        s = html.unescape(_TAG.sub(tag, s))
    s = s.replace("\xa0", " ")
    if has("wiki"):
        s = re.sub(r"^(={2,6}) *(.*?) *\1 *$", lambda m: "\n" + "#" * (len(m.group(1)) - 1) + " " + m.group(2) + "\n", s, flags=re.M)
        s = re.sub(r"\[\[(?:File|Image|Category):[^\[\]]*\]\]", "", s)
        s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", s)
        s = re.sub(r"\[https?://\S+ ([^\[\]\n]+)\]", r"\1", s)
        s = re.sub(r"'''?(?!')(.*?)'''?(?!')", r"\1", s)
        for _ in range(ROUNDS):
            s, n = re.subn(r"\{\{[^{}]*\}\}", "", s)
            if not n:
                break
        s = re.sub(r"^\{\|.*$|^\|[}-].*$", "", s, flags=re.M)
        s = re.sub(r"^[|!] *(.*)$", lambda m: re.sub(r" *(?:\|\||!!) *", " | ", m.group(1)), s, flags=re.M) if "|-" in text else s
    if has("latex"):
        s = _ACCENT.sub(lambda m: unicodedata.normalize("NFC", (m.group("in") or m.group("on") or m.group("in2")) + _MARKS[m.group("mark") or m.group("mark2")]), s)
        s = re.sub(r"\\(?:chapter|(?:sub)*section)\*?\{([^{}]*)\}", lambda m: "\n\n" + "#" * (1 + m.group().count("sub", 0, 16)) + " " + m.group(1) + "\n\n", s)
        s = re.sub(r"\\item(?:\[[^\[\]]*\])? *", "\n- ", s)
        s = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\[\]]*\])?", "\n", s)
        s = re.sub(r"~?\\(?:cite[a-z]*|ref|label|eqref|pageref|bibliography\w*)(?:\[[^\[\]]*\])?\{[^{}]*\}", "", s)
        for _ in range(ROUNDS):
            s, n = re.subn(r"\\[A-Za-z]+\*?(?:\[[^\[\]]*\])?\{([^{}]*)\}", r"\1", s)
            if not n:
                break
    if has("markdown"):
        s = re.sub(r"^ {0,3}(.+)\n {0,3}={3,} *$", r"# \1", s, flags=re.M)
        s = re.sub(r"^ {0,3}(\S.*)\n {0,3}-{3,} *$", r"## \1", s, flags=re.M)
        s = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]*(?: +\"[^\"\n]*\")?\)", r"\1", s)
        s = re.sub(r"\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*|(?<!\w)__(?=[^\s_])([^_\n]+?)__(?!\w)", lambda m: m.group(1) or m.group(2), s)
        s = s if not emphasis else re.sub(r"(?<![\w*])\*(?=[^\s*])([^*\n]*?)(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])([^_\n]*?)(?<=[^\s_])_(?![\w_])", lambda m: m.group(1) or m.group(2), s)
        s = re.sub(r"^ *\|? *:?-{3,}:? *(?:\| *:?-{3,}:? *)+\|? *$\n?", "", s, flags=re.M)
        s = re.sub(r"^( *)[*+] +(?:\[[ xX]\] )?", r"\1- ", s, flags=re.M)
        s = re.sub(r"^( *)- \[[ xX]\] ", r"\1- ", s, flags=re.M)
        s = re.sub(r"^ {0,3}> ?", "", s, flags=re.M)
    s = re.sub(r"[ \t]+", " ", s)
    s = re.sub(r" *\n *", "\n", s)
    s = re.sub(r"\n{3,}", "\n\n", s).strip()
    return re.sub("\x01(\\d+)\x02", lambda m: kept[int(m.group(1))], s)


# --- on Spark -------------------------------------------------------------------------------------------


def tokens_of(notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, family, name, context, n, matched, around, known) of the proposed tokens of each distinct text of a note:
    how many there are, how many of them have their partner, the one opening around all of them if there is one, and
    whether the grammar knows them as tokens without a partner."""
    ship(notes.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f[key], f[text]):
                tokens = lex(t)
                around = surroundings(tokens) if "<" in t else {}
                counts: dict[tuple[str, str, str], list] = {}
                for x in tokens:
                    outer = around.get((x.family, x.name), ())
                    c = counts.setdefault((x.family, x.name, x.context), [0, 0, next(iter(outer)) if len(outer) == 1 else "", False])
                    c[0] += 1
                    c[1] += x.role in ("open", "close")
                    c[3] |= grammatical(x)
                rows += [(k, *names, *c) for names, c in counts.items()]
            yield pd.DataFrame(rows, columns=["key", "family", "name", "context", "n", "matched", "around", "known"])

    kept = notes.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text).distinct()
    return checkpointed(kept.mapInPandas(run, "key string, family string, name string, context string, n int, matched int, around string, known boolean"))


def valid_classes(tokens: DataFrame, least: float = LEAST_AGREEMENT) -> DataFrame:
    """(family, name, context, class) of the tokens in valid equivalence classes.

    The matched openings and closings of a name are a class where their occurrence vectors agree: in at least
    ``least`` of the notes that hold the token in this context, each of them has its partner.  An HTML name the grammar
    does not know must do so in two notes.  A tag that never closes belongs to the class of a tag whose vector
    it shares (compared by sums of hashes) and within which it always stands."""
    per = tokens.groupBy("family", "name", "context").agg(
        F.count("*").alias("notes"), F.sum((F.col("matched") == F.col("n")).cast("int")).alias("agree"), F.sum("matched").alias("matched"), F.bool_or("known").alias("known"),
        F.sum(F.xxhash64("key", "n").cast("decimal(38,0)")).alias("class"), F.min("around").alias("around"), F.max("around").alias("other"),
    )
    enough = (F.col("family") != "html") | F.col("known") | (F.col("notes") > 1)
    pairs = per.where((F.col("matched") > 0) & (F.col("agree") >= least * F.col("notes")) & enough).select("family", "name", "context", "class")
    outer = pairs.where("family = 'html' AND context = 'open'").select("class", F.col("name").alias("around"))
    held = per.where("family = 'html' AND context = 'open' AND matched = 0 AND notes > 1 AND around = other").join(outer, ["class", "around"]).select("family", "name", "context", "class")
    return pairs.unionByName(held)


def accepted(tokens: DataFrame) -> DataFrame:
    """The tokens of valid classes, and those without a partner by nature."""
    classes = valid_classes(tokens).select("family", "name", "context", F.lit(True).alias("valid"))
    held = F.col("valid") & ((F.col("matched") > 0) | (F.col("family") == "html"))
    return tokens.join(classes, ["family", "name", "context"], "left").where(F.col("known") | held)


def families(notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, family) of every family of markup in a note."""
    return accepted(tokens_of(notes, key, text)).select("key", "family").distinct()


def cleaned(notes: DataFrame, key: str, text: str, out: str = "clean") -> DataFrame:
    """key and clean text of every distinct (key, text), the slots of the note's template; null texts stay null."""
    ship(notes.sparkSession)

    @F.pandas_udf("string")
    def run(s: pd.Series, template: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else clean(t, frozenset(n if n is not None else ())) for t, n in zip(s, template)], dtype=object)

    names = accepted(tokens_of(notes, key, text)).groupBy(F.col("key").alias(key)).agg(F.collect_set(F.concat_ws(" ", "family", "name")).alias("template"))
    return notes.select(key, text).distinct().join(names, key, "left").select(key, run(text, "template").alias(out))
