import html
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as t


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "s string").select(make(F.col("s")).alias("r")).first().r


def paragraphs_of(raw, glue):
    """Brute force over lines."""
    out, block = [], []
    for line in [*re.split(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", raw), ""]:
        if line.strip():
            block.append(line.strip())
            continue
        text = ""
        for i, x in enumerate(block):
            text = text[:-1] + x if text.endswith("-") else text + (glue if i else "") + x
        if block and (text := re.sub(r"\s+", " ", text).strip()):
            out.append(text)
        block = []
    return out


def parts_of(p, most=1200):
    """Brute force of the split."""
    p = p.strip()
    if len(p) <= most:
        return [p]
    solid = re.sub(r"\s", "", p)
    cjk = len(re.findall(f"[{t.CJK}]", solid)) / max(1, len(solid)) >= 0.2 and len(re.findall("[A-Za-z]", solid)) / max(1, len(solid)) <= 0.4
    glue, lap = ("", 60) if cjk else (" ", 80)
    pieces = re.split(r"(?<=[.?!。！？])\s+", p)
    if len(pieces) < 2:
        pieces = re.split(r"(?<=[.?!。！？])\s*", p)
    packed = []
    for s in filter(None, map(str.strip, pieces)):
        if packed and len(packed[-1]) + len(glue) + len(s) <= most:
            packed[-1] += glue + s
        else:
            packed.append(s)
    for i in range(1, len(packed)):
        room = min(lap, max(0, most - len(packed[i])))
        packed[i] = (packed[i - 1][-room:] if room else "") + packed[i]
    out = []
    for part in packed:
        if len(part) <= most:
            out.append(part)
            continue
        i = 0
        while True:
            out.append(part[i : i + most].strip())
            if i + most >= len(part):
                break
            i += most - lap
    return [x for x in out if x]


CASES = ["", "   ", "foo-\nbar baz\n\n  qux  ", "a-\nb-\nc\r\n\r\nd", "x  y", "one -\n two", "漢字\n仮名\n\n次", "tab\there\n \t\nend-", "-\n-\n-"]


@pytest.mark.parametrize("raw", CASES)
def test_paragraphs(spark, raw):
    for glue in (" ", ""):
        assert one(spark, raw, lambda c: t.paragraphs(c, F.lit(glue))) == paragraphs_of(raw, glue)


def test_split_against_brute_force(spark):
    sentence = "The bed near the shore was measured in 1901, and the list was kept. "
    texts = ["", " ", "short", sentence * 60, "x" * 3000, "字" * 3000, "字。" * 900, " ".join("y" * 599 + "." for _ in range(3)), sentence * 3 + "z" * 2500 + ". " + sentence * 20, "a.b!c?" * 500, "q" * 1200, "q" * 1201]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string").select("i", t.split_long(F.col("s")).alias("p")).collect()
    assert {r.i: r.p for r in rows} == {i: parts_of(x) for i, x in enumerate(texts)}
    assert [len(x) for x in parts_of(texts[7])] == [600, 680, 680]
    assert [len(x) for x in parts_of(texts[4])] == [1200, 1200, 760]
    assert [len(x) for x in parts_of(texts[5])] == [1200, 1200, 720]


def test_null_texts_stay_null_or_false(spark):
    for make in (t.strip, t.clean, t.text_of_html, lambda c: t.paragraphs(c, F.lit(" "))):
        assert one(spark, None, make) is None
    assert one(spark, None, t.is_gibberish) is False and one(spark, None, t.is_cjk) is False


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=200), min_size=1, max_size=30))
def test_clean_is_nfkc_without_controls(spark, texts):
    texts = [x for x in texts if not any("\ud800" <= c <= "\udfff" for c in x)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string").select("i", t.clean(F.col("s")).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: unicodedata.normalize("NFKC", re.sub(t.CONTROL, "", x)).replace("�", "") for i, x in enumerate(texts)}


def merged(spark, lengths, least=200):
    records = [(f"i{i}", "y" * n, f"l{i}", i, 0, None) for i, n in enumerate(lengths)]
    out = spark.createDataFrame([(records,)], f"r array<{t.RECORD}>").select(t.merge_short(F.col("r"), F.lit(least)).alias("m")).first().m
    return [(r.chunk_id, len(r.text), r.merge_count, r.locator_end) for r in out]


def test_merge(spark):
    assert merged(spark, [50, 30, 60]) == [("i0", 112, 2, "l2")]
    assert merged(spark, [250, 50]) == [("i0", 302, 2, "l1")]
    assert merged(spark, [50, 1190]) == [("i0", 50, None, None), ("i1", 1190, None, None)]
    assert merged(spark, [50, 60, 300, 20]) == [("i0", 414, 3, "l2")]
    assert merged(spark, [300, 90, 90]) == [("i0", 300 + 2 + 182, 2, "l2")]  # a tail of two counts once
    assert merged(spark, []) == [] and merged(spark, [10, 20]) == []
    assert merged(spark, [1150, 60]) == [("i0", 1150, None, None), ("i1", 60, None, None)]


def test_gibberish(spark):
    assert [one(spark, "!" * n, t.is_gibberish) for n in (49, 50)] == [False, True]
    assert not one(spark, "word " * 20, t.is_gibberish) and one(spark, "​" * 30 + "a" * 30, t.is_gibberish)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("<body><p>A</p><br>B&amp;C<script>x</script></body>", " A\n\n\nB&C"),
        ("no tags", "no tags"),
        ("<p>open <b", " open "),
        ("<HTML><BODY class='x'>in</BODY>out", "in"),
        ("<body>rest <style>p{}</style>of it", "rest of it"),
        ("a > b &lt;i&gt;", "a > b <i>"),
        ("", ""),
    ],
)
def test_html(spark, raw, want):
    assert one(spark, raw, t.text_of_html) == want
    assert html.unescape(one(spark, raw, t.strip_html)) == want


def test_years_and_creators(spark):
    assert [one(spark, d, t.year_of) for d in ("2021-03", "c. 1999", None, "20", "１９９９")] == [2021, None, None, None, None]
    rows = spark.createDataFrame([(["a", " ", None, "b"],), ([],), (None,), ([" "],)], "n array<string>").select(t.creators_text(F.col("n")).alias("r")).collect()
    assert [r.r for r in rows] == ["a; b", None, None, None]


def test_main_text_is_pluggable(spark):
    def extractor(page):
        if "broken" in page:
            raise ValueError
        return page.partition("<main>")[2].partition("</main>")[0]

    df = spark.createDataFrame([("<p>menu</p><main>body</main>",), ("<p>no main</p>",), ("broken<b>x</b>",), (None,), ("",)], "html string")
    got = [r[0] for r in df.select(t.main_text_of_html(F.col("html"), extractor)).collect()]
    assert [g if g is None else g.strip() for g in got] == ["body", "no main", "broken x", None, ""]
    assert df.select(t.main_text_of_html(F.col("html"))).first()[0].split() == ["menu", "body"]
