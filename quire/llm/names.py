"""Problem 1: variant spellings of names typed by people.

A name is parsed into full tokens (folded, titles and particles dropped, familiar given names replaced
by formal ones) and abbreviations.  Full names are blocked by the phonetic codes of their sorted
tokens, one of which may lack a sound, and by their letters, one of which may be missing; overfull blocks
by sound are subdivided by all that an accepted pair must share; candidates in a block are compared by Jaro-Winkler and edit
distance of the aligned tokens; connected components of the accepted pairs are the people and
bodies.  Abbreviated names ("Doe, J.", "ABC Town") then join the one component they can stand for;
an abbreviation that two components could stand behind stays apart.

Defined results: null, empty and blank names, and names without a letter, are no names; repeated names
count once; spellings that differ only in case, spaces, signs, accents or look-alike letters are one name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.components import connected_components
from quire.runtime import checkpointed, ship

#: Least Jaro-Winkler similarity of aligned tokens; blocks by sound above this many names are subdivided.
LEAST_SIMILARITY, HOT_BLOCK = 0.85, 500

# Familiar forms of given names in general use, beside those of the table given.
FAMILIAR = {
    "abby": "abigail", "al": "albert", "alex": "alexander", "andy": "andrew", "angie": "angela", "barb": "barbara", "basti": "sebastian", "becky": "rebecca", "bella": "isabella", "bert": "albert", "beth": "elizabeth", "betsy": "elizabeth", "bill": "william",
    "bob": "robert", "cathy": "katherine", "charlie": "charles", "chris": "christopher", "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "debbie": "deborah", "don": "donald", "drew": "andrew", "ed": "edward", "eddie": "edward", "ellie": "eleanor",
    "ernie": "ernest", "frank": "francis", "fritz": "friedrich", "gerry": "gerald", "gianni": "giovanni", "ginny": "virginia", "grisha": "grigori", "hank": "henry", "ike": "isaac", "izzy": "isabella", "jenny": "jennifer", "jerry": "gerald", "jimmy": "james",
    "jo": "joanna", "judy": "judith", "kathy": "katherine", "katie": "katherine", "kim": "kimberly", "len": "leonard", "leni": "magdalena", "lenny": "leonard", "leo": "leonard", "lola": "dolores", "liz": "elizabeth", "lizzie": "elizabeth", "maggie": "margaret",
    "mandy": "amanda", "manny": "emanuel", "marty": "martin", "matt": "matthew", "meg": "margaret", "mel": "melanie", "mickey": "michael", "molly": "mary", "nancy": "anne", "ned": "edward", "nell": "eleanor", "nellie": "eleanor", "nick": "nicholas", "paddy": "patrick",
    "pam": "pamela", "pat": "patricia", "patty": "patricia", "peggy": "margaret", "pepe": "jose", "polly": "mary", "ray": "raymond", "rick": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel", "sandy": "alexander", "sasha": "alexander", "sepp": "josef",
    "sergio": "sergei", "seryozha": "sergei", "stan": "stanislaw", "staszek": "stanislaw", "sue": "susanna", "susie": "susanna", "tanya": "tatiana", "terry": "terence", "tina": "christina", "toby": "tobias", "tom": "thomas", "tommy": "thomas", "toni": "anthony",
    "tony": "anthony", "uli": "ulrich", "uschi": "ursula", "val": "valerie", "vanya": "ivan", "vince": "vincent", "wally": "walter", "wendy": "gwendolyn", "will": "william", "zack": "zachary", "zach": "zachary",
}
# Titles, particles of surnames, kinds of bodies, words that a body's name may lack.
TITLES = frozenset("prof dr phd md mr mrs ms sir dame rev hon jr sr dipl ing msc bsc mag".split())
PARTICLES = frozenset("van der den von zu zur de del della di da dos du la le les af av ten ter el al bin ibn".split())
BODIES = ("academy", "association", "board", "centre", "college", "commission", "committee", "council", "department", "faculty", "foundation", "institute", "laboratory", "library", "museum", "office", "school", "society", "university")
BODY_FORMS = {"center": "centre", "dept": "department", "univ": "university", "assn": "association", "cttee": "committee", "ctr": "centre"}
LINKING = frozenset("the of for and in at on und der des".split())
# Letters that decomposition does not fold, and look-alikes of other scripts.
FOLDED = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h"})
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнАЕОРСУХІЈЅКМТВНοαινυρκΟΑΕΙΚΜΝΡΤΧΥΒΗΖ", "aeopcyxijsdhkmtbhAEOPCYXIJSKMTBHoaivupkOAEIKMNPTXYBHZ")
# Sounds that count as one in the phonetic code.
SOUNDS = str.maketrans({"p": "b", "q": "k", "c": "k", "t": "d", "v": "f", "w": "f", "z": "s", "x": "s", "m": "n"})

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?")
_ACRONYM = re.compile(r"[A-Z]{2,6}")


def fold(word: str) -> str:
    if not word.isascii():
        if any(c < "ɐ" and c.isalpha() for c in word):  # look-alikes count only beside Latin letters
            word = word.translate(LOOKALIKES)
        word = "".join(c for c in unicodedata.normalize("NFKD", word.lower().translate(FOLDED)) if not unicodedata.combining(c))
    return word.lower().replace("'", "").replace("’", "")


@lru_cache(200_000)
def sound(token: str) -> str:
    """Phonetic code: consonant classes without doubles, h and vowels, but for a mark of a leading vowel."""
    out = "" if token[:1] not in "aeiouy" else "a"
    for c in token.translate(SOUNDS):
        if c not in "aeiouyh" and (not out or out[-1] != c):
            out += c
    return out


def shortened(code: str) -> set[str]:
    """The code and the code without any one of its signs."""
    return {code} | {code[:i] + code[i + 1 :] for i in range(len(code))}


def near(a: str, b: str) -> bool:
    """At most one letter added, left out, replaced or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    swapped = sum(c != d for c, d in zip(hits, (b[j] for j in range(len(b)) if used[j]))) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    lead = 0
    while lead < min(4, len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    return jaro + lead * 0.1 * (1 - jaro)


def _body_word(word: str) -> str | None:
    w = fold(word.rstrip("."))
    if w in BODIES:
        return w
    if w in BODY_FORMS:
        return BODY_FORMS[w]
    return next((b for b in BODIES if word.endswith(".") and len(w) >= 3 and b.startswith(w)), None)


def parse(name: str, familiar: dict[str, str]) -> tuple[str, list[str], str | None, str | None] | None:
    """(kind, full tokens, anchor, abbreviation): full names have no anchor; abbreviated ones have no tokens.

    kind is ``body`` or ``person``; the anchor is the surname or town, the abbreviation the folded
    initials or the truncated given name (marked by a full stop)."""
    text = unicodedata.normalize("NFKC", name).replace("&", " and ")
    words = _WORD.findall(text)
    if not words:
        return None
    bodies = [_body_word(w) for w in words]
    lowered = [fold(w.rstrip(".")) for w in words]
    if len(words) > 2 and (any(bodies) or "of" in lowered or "for" in lowered):
        content = [(w, b) for w, b, low in zip(words, bodies, lowered) if low and low not in LINKING]
        tokens = [b or fold(w.rstrip(".")) for w, b in content]
        initials = sorted(t[0] for t in tokens)
        kept = [t for t, (w, _) in zip(tokens, content) if not (_ACRONYM.fullmatch(w) and not text.isupper() and all(c.lower() in initials for c in w))]
        return "body", sorted(kept), None, None
    cut = re.search(r"[,/;]", text)
    if not cut and len(words) == 2 and words[0].endswith(".") and len(words[0]) > 5:
        cut = re.search(r"\.", text)
    sides = [text[: cut.start()], text[cut.end() :]] if cut else [text]
    sides = [[w for w in _WORD.findall(s) if fold(w.rstrip(".")) not in TITLES] for s in sides]
    # particles may be mistyped: short words in small letters beside a capitalised one
    sides = [[w for w in s if not (w.islower() and len(w) <= 4 and any(x[:1].isupper() for x in s))] or s for s in sides]
    # what remains: [surname words, given words], or words of unknown order
    if len(sides) == 2 and sides[0] and sides[1]:
        surname, given = sides
    else:
        rest = sides[0] or sides[-1]
        if not rest:
            return None
        if len(rest) == 2 and _ACRONYM.fullmatch(rest[0]) and rest[1][:1].isupper() and rest[1][1:2].islower() and not cut:
            return "body", [], fold(rest[1]), "".join(sorted(rest[0].lower()))
        caps = [w for w in rest if len(w) > 2 and w.isupper()]
        core = [w for w in rest if fold(w) not in PARTICLES]
        if len(rest) == 1 or not core:
            return "person", [fold(w.rstrip(".")) for w in rest], None, None
        if caps and len(caps) < len(rest):
            surname, given = [w for w in rest if w in caps], [w for w in rest if w not in caps]
        elif len(core[-1].rstrip(".")) == 1 or _ACRONYM.fullmatch(core[-1]) and len(core[-1]) < 4 and not core[0].isupper():
            surname, given = core[:1], core[1:]
        else:
            surname, given = core[-1:], core[:-1]
    last = [fold(w.rstrip(".")) for w in surname if fold(w.rstrip(".")) not in PARTICLES] or [fold(w.rstrip(".")) for w in surname]
    given = [w for w in given if fold(w.rstrip(".")) not in PARTICLES]
    full = [w for w in given if len(w.rstrip(".")) > 2 and not w.endswith(".") or len(w) == 2 and w[1].islower()]
    if len(full) == 1 and _ACRONYM.fullmatch(full[0]) and len(full[0]) == 3 and not surname[0].isupper():
        full = []
    if not full:
        short = [w for w in given if w.endswith(".") and len(w) > 2] if given else []
        if short:
            return "person", [], " ".join(last), fold(short[0].rstrip(".")) + "."
        letters = "".join(fold(w.rstrip(".")) for w in given)
        return ("person", [], " ".join(last), letters) if letters else ("person", sorted(last), None, None)
    first = fold(full[0].rstrip("."))
    first = familiar.get(first, first)
    return "person", sorted([" ".join(last), first, *(fold(w) for w in full[1:])]), None, None


def _blocks(kind: str, tokens: list[str]) -> list[str]:
    codes = [sound(t) for t in tokens]
    out = set()
    for i, code in enumerate(codes):
        others = " ".join(sorted(codes[:i] + codes[i + 1 :]))
        out |= {f"{kind}:{others}|{v}" for v in shortened(code)}
    return sorted(out)


def _letter_blocks(kind: str, tokens: list[str]) -> list[str]:
    out = set()
    for i, t in enumerate(tokens):
        others = " ".join(sorted(tokens[:i] + tokens[i + 1 :]))
        out |= {f"{kind}:{others}|{v}" for v in shortened(t)}
    return sorted(out)


def _inner_blocks(kind: str, tokens: list[str], blocks: list[str]) -> list[str]:
    """Parts of overfull ``blocks`` by sound, such that every pair ``same_name`` accepts there and that no
    block by letters holds shares one: one token sounds the same at equal length, or two tokens sound the
    same a letter apart, and the others are equal."""
    codes, n, out = [sound(t) for t in tokens], len(tokens), set()
    for i in range(n):
        others = " ".join(sorted({*tokens[:i], *tokens[i + 1 :]}))
        out.add(f"{kind}={others}|{codes[i]}|{len(tokens[i])}")
        if len(set(tokens)) < n:  # a name with a token twice may lack it once
            out |= {f"{b}={others}|{v}" for b in blocks for v in shortened(tokens[i])}
        for j in range(i + 1, n):
            others = " ".join(sorted({*tokens[:i], *tokens[i + 1 : j], *tokens[j + 1 :]}))
            first, second = ([f"{c}/{v}" for v in shortened(t)] for c, t in ((codes[i], tokens[i]), (codes[j], tokens[j])))
            out |= {f"{kind}={others}|" + "|".join(sorted((u, v))) for u in first for v in second}
    if len(set(tokens)) < n:
        out |= {f"{b}={' '.join(sorted(set(tokens)))}" for b in blocks}
    return sorted(out)


def same_name(a: str, b: str, least: float = LEAST_SIMILARITY) -> bool:
    """Tokens, aligned by sound and spelling, all similar: one letter apart in all, or sounding the same."""
    x, y = a.split("\t"), b.split("\t")
    if len(x) != len(y):
        return False
    left, right = [t for t in x if t not in y], [t for t in y if t not in x]
    if len(left) != len(right) or len(left) > 2:
        return not left and not right
    if len(left) == 2 and jaro_winkler(left[0], right[0]) + jaro_winkler(left[1], right[1]) < jaro_winkler(left[0], right[1]) + jaro_winkler(left[1], right[0]):
        right.reverse()
    for s, t in zip(left, right):
        if jaro_winkler(s, t) < (least if len(s) > 4 else 0.7) and not (near(s, t) and len(s) > 3):
            return False
    edits = sum(not near(s, t) for s, t in zip(left, right))
    alike = all(sound(s) == sound(t) for s, t in zip(left, right))
    return edits == 0 and (len(left) == 1 or alike) or alike and all(len(s) == len(t) for s, t in zip(left, right)) and len(left) == 1 and jaro_winkler(left[0], right[0]) >= 0.93


PARSED = "name string, kind string, key string, tokens array<string>, anchor string, short string"


def parsed(names: DataFrame, familiar: dict[str, str]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(n, *p) for n in f["name"] if (p := parse(n, familiar))]
            yield pd.DataFrame([(n, k, f"{k}\t" + "\t".join(t) if t else None, t, a, s) for n, k, t, a, s in rows], columns=["name", "kind", "key", "tokens", "anchor", "short"])

    return names.mapInPandas(run, PARSED)


def accepted_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) keys of accepted pairs among ``nodes`` (key, kind, tokens; distinct)."""

    def keyed(make, df: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = [(k, b) for k, kind, t in zip(f["key"], f["kind"], f["tokens"]) for b in make(kind, list(t))]
                yield pd.DataFrame(rows, columns=["key", "block"])

        return df.select("key", "kind", "tokens").mapInPandas(run, "key string, block string")

    def divided(df: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = [(k, b) for k, kind, t, hot in zip(f["key"], f["kind"], f["tokens"], f["hot"]) for b in _inner_blocks(kind, list(t), list(hot))]
                yield pd.DataFrame(rows, columns=["key", "block"])

        return df.select("key", "kind", "tokens", "hot").mapInPandas(run, "key string, block string")

    by_sound = checkpointed(keyed(_blocks, nodes))
    sizes = checkpointed(by_sound.groupBy("block").count().where("count > 1"))
    usual = by_sound.join(sizes.where(F.col("count") <= HOT_BLOCK).select("block"), "block")
    hot = by_sound.join(sizes.where(F.col("count") > HOT_BLOCK).select("block"), "block").groupBy("key").agg(F.collect_list("block").alias("hot"))
    # every name is blocked by its letters, too: exact for one edit, however full the blocks by sound are,
    # and small by construction, since the names of a block differ in one letter of one token
    blocks = usual.unionByName(keyed(_letter_blocks, nodes).select("block", "key")).unionByName(divided(nodes.join(hot, "key")).select("block", "key"))
    left, right = blocks.select("block", F.col("key").alias("a")), blocks.select("block", F.col("key").alias("b"))
    pairs = left.join(right, "block").where("a < b").select("a", "b").distinct()

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[[same_name(a.split("\t", 1)[1], b.split("\t", 1)[1]) for a, b in zip(f["a"], f["b"])]]

    return pairs.mapInPandas(compare, "a string, b string")


def _expanded(nodes: DataFrame) -> DataFrame:
    """(component, anchor, rest) with each token in turn as the anchor: the other token of a person, sorted initials of a body."""
    t = nodes.select("component", "kind", "tokens", F.posexplode("tokens").alias("pos", "anchor"))
    others = F.filter(F.col("tokens"), lambda x, i: i != F.col("pos"))
    rest = F.when(F.col("kind") == "person", F.array_join(others, " ")).otherwise(F.array_join(F.array_sort(F.transform(others, lambda x: F.substring(x, 1, 1))), ""))
    return t.select("component", "kind", "anchor", rest.alias("rest"))


def _attach(short: DataFrame, full: DataFrame, keys: list[str], fits) -> DataFrame:
    """(anchor, short, kind, component) of the abbreviations that fit exactly one component, and n > 1 of those that fit more."""
    hits = short.join(full, keys).where(fits)
    return hits.groupBy("kind", "anchor", "short").agg(F.min("component").alias("component"), F.max("component").alias("other"))


def clusters(names: DataFrame, familiar: dict[str, str] | None = None) -> DataFrame:
    """(name, component) for every name (a column of distinct strings)."""
    spark = names.sparkSession
    ship(spark)
    table = FAMILIAR | {fold(k): fold(v) for k, v in (familiar or {}).items()}
    forms = checkpointed(parsed(names, table))
    nodes = checkpointed(forms.where("key IS NOT NULL").select("key", "kind", "tokens").distinct())
    labels = connected_components(accepted_pairs(nodes))
    nodes = checkpointed(nodes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")))
    named = forms.join(nodes.select("key", "component"), "key").select("name", "component")

    short = forms.where("anchor IS NOT NULL").select("kind", "anchor", "short").distinct()
    dotless = F.rtrim(F.col("short"), F.lit("."))
    prefix = F.when(F.col("short").endswith("."), dotless).otherwise(F.substring("short", 1, 1))
    short = short.withColumn("letter", F.substring("short", 1, 1)).withColumn("prefix", prefix)
    full = _expanded(nodes).withColumn("letter", F.substring("rest", 1, 1))
    people, bodies = full.where("kind = 'person'"), full.where("kind = 'body'").withColumn("short", F.col("rest"))
    exact = _attach(short.where("kind = 'person'"), people.drop("kind").distinct(), ["anchor", "letter"], F.col("rest").startswith(F.col("prefix")))
    acronyms = _attach(short.where("kind = 'body'").drop("letter"), bodies.drop("letter", "kind", "rest").distinct(), ["anchor", "short"], F.lit(True))
    first = checkpointed(exact.unionByName(acronyms))

    # anchors with a slip: no full name has them as they are
    missing = short.join(first, ["kind", "anchor", "short"], "left_anti")

    def slips(df: DataFrame, columns: list[str]) -> DataFrame:
        schema = T.StructType([*(df.schema[c] for c in columns), T.StructField("code", T.StringType())])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = [(*r, v) for r in f[columns].itertuples(index=False) for v in shortened(sound(r[columns.index("anchor")]))]
                yield pd.DataFrame(rows, columns=[*columns, "code"])

        return df.select(*columns).mapInPandas(run, schema)

    lost = slips(missing, ["kind", "anchor", "short", "letter", "prefix"])
    sought = full.withColumn("letter", F.when(F.col("kind") == "person", F.col("letter")).otherwise(F.substring("rest", 1, 1)))
    found = slips(sought.select("kind", "anchor", "rest", "letter", "component").distinct(), ["kind", "anchor", "rest", "letter", "component"]).withColumnRenamed("anchor", "whole")
    fits = (F.levenshtein("anchor", "whole") <= 2) & F.when(F.col("kind") == "person", F.col("rest").startswith(F.col("prefix"))).otherwise(F.col("rest") == F.col("short"))
    hits = lost.join(found, ["kind", "code", "letter"]).where(fits)
    second = hits.groupBy("kind", "anchor", "short").agg(F.min("component").alias("component"), F.max("component").alias("other"))
    attached = first.unionByName(second)
    # abbreviations of one anchor and letter that stand for no full name belong together
    alone = short.join(attached, ["kind", "anchor", "short"], "left_anti").withColumn("component", F.concat_ws("\t", F.lit("short"), "kind", "anchor", F.when(F.col("kind") == "person", F.col("letter")).otherwise(F.col("short"))))
    settled = attached.withColumn("component", F.when(F.col("component") == F.col("other"), F.col("component")).otherwise(F.concat_ws("\t", F.lit("several"), "kind", "anchor", "short"))).drop("other").unionByName(alone.select("kind", "anchor", "short", "component"))
    rest = forms.where("anchor IS NOT NULL").join(settled, ["kind", "anchor", "short"]).select("name", "component")
    return named.unionByName(rest)


def pairs_of(clustered: DataFrame) -> DataFrame:
    """Every pair of different names of one component, the smaller in code-point order first."""
    return clustered.select("component", F.col("name").alias("name_a")).join(clustered.select("component", F.col("name").alias("name_b")), "component").where("name_a < name_b").select("name_a", "name_b")


def all_names(attachments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct elements of attachments.creators and pieces of chunks.creators between ``"; "``."""
    listed = attachments.select(F.explode("creators").alias("name"))
    written = chunks.select("creators").distinct().select(F.explode(F.split("creators", "; ")).alias("name"))
    return listed.unionByName(written).where("name IS NOT NULL").distinct()
