import numpy as np
import pytest

from quire.llm import scans as s
from quire.llm import spam as p

WORDS = "the warden measured reed bed near harbour and kept list in that year which was found again before reform survey of under dry conditions follow-up call sous-évalue chapter document gull colony quality between".split()


@pytest.fixture(scope="module")
def lexicon():
    return s.Lexicon({w: 5000 for w in WORDS} | {"thc": 12, "rare": 4})


def kinds(lexicon, text, title=None, names=None, page=None, label=None):
    return dict(s.examine(text, lexicon, title, names, page, label))


def test_hyphens(lexicon):
    for sign in "-‐­¬":
        assert kinds(lexicon, f"the war{sign}\nden measured the reed") == {"hyphen": 1}
        assert kinds(lexicon, f"the war{sign} den measured") == {"hyphen": 1}
    assert kinds(lexicon, "the follow-\nup call was found") == {}  # a compound that merely wraps
    assert kinds(lexicon, "pre- and later list") == {} and kinds(lexicon, "1901-\n1905") == {}


def test_misread_signs(lexicon):
    assert kinds(lexicon, "The warden rneasured tbe rced bed.") == {"misread": 3}
    assert kinds(lexicon, "rneasured the bed and thc") == {}  # words cut off at the ends
    assert kinds(lexicon, "the l!st 0f the s1rvey") != {}
    assert kinds(lexicon, "Gor0burg and Tormer9a are names") == {"misread": 2}
    assert kinds(lexicon, "the rare unknownword Xyzburg was found iii 4th H2O") == {}
    assert lexicon.decode("thc warden".split())[0] == ["the", "warden"]


def test_headers_and_page_numbers(lexicon):
    body = "the warden kept the list\nin that year which was found"
    assert kinds(lexicon, f"{body}\n— 57 —", page=57) == {"number": 1}
    assert kinds(lexicon, f"{body}\n— 57 —", page=58) == {}
    assert "number" in kinds(lexicon, f"[xii]\n{body}", page=3, label="xii")
    assert "header" in kinds(lexicon, f"Reed beds of the northern sho    12\n{body}", title="Reed beds of the northern shores", page=12)
    assert "header" in kinds(lexicon, f"MULLIGAN\n{body}", names="Mulligan, Ann")
    assert "header" in kinds(lexicon, f"Pelmere Proceedings, vol. 12\n{body}") and "header" in kinds(lexicon, f"Chapter 4. On the reed be\n{body}")
    assert kinds(lexicon, "1. the list\n2. the survey\n3. the reed", page=9) == {}
    assert kinds(lexicon, body) == {} and kinds(lexicon, "") == {}


def test_repair_gives_continuous_paragraphs(lexicon):
    text = "Pelmere Proceedings, vol. 12    7\nthe warden mea-\nsured tbe reed bed near the\nharbour.\n— 7 —"
    fixed, found = s.repair(text, lexicon, page=7)
    assert fixed == "the warden measured the reed bed near the harbour." and found["hyphen"] == 1 and found["misread"] == 1
    assert s.repair("the warden", lexicon)[0] == "the warden" and s.repair("", lexicon)[0] == ""


def test_headers_in_undone_lines_end_where_the_body_goes_on(lexicon):
    title = "Reed and survey: notes on the gull colony"
    body = "The warden kept the list in that year which was found again before reform."
    for head in ("Reed and survey: notes on", "Reed and survey: notes on t", "Reed and survey: n0tes", "Reed and survey: notes on the gull colony"):
        assert s.repair(f"{head} {body}", lexicon, title)[0] == body, head
    assert s.repair(f"Reed and survey: notes {body.lower()}", lexicon, title)[0] == body.lower()
    for after in ("    157 ", " [157] "):
        assert s.repair(f"kept the Chapter 12. On the reed be{after}list in that year which was", lexicon, page=157)[0].endswith("list in that year which was")
    assert s.repair("kept the Chapter 2. A reed survey under dry con list in that year", lexicon, width=27)[0] == "kept the list in that year"
    assert s.repair("Chapter 2. A reed survey The warden kept the list in that year", lexicon)[0] == "The warden kept the list in that year"


def test_header_width_is_read_from_the_lines(spark):
    rows = [(f"A:p{i}:para0:part0", f"Chapter {i}. On the reed beds of Torf{end}\nthe list") for i, end in enumerate(["", "  12", " [12]"], 1)]
    assert s.header_width(spark.createDataFrame([*rows, ("B:p1:para0:part0", "Chapter 4. Reed\nthe list")], "chunk_id string, text string")) == 24
    assert s.header_width(spark.createDataFrame([("B:p1:para0:part0", "the list")], "chunk_id string, text string")) is None


def test_paragraph_boundaries():
    lines = ["The warden kept the list of that year and of the", "year before it, which was long.", "A second paragraph starts here and runs on to the", "margin of the page, as they do."]
    assert [len(x) for x in s.paragraphs(lines)] == [2, 2]
    assert s.paragraphs([]) == [] and len(s.paragraphs(["- a", "- b", "- c"])) == 3


def test_joint_decoding_prefers_the_cheapest(lexicon):
    assert lexicon.decode("re ed bed".split())[0][-1] == "bed"
    assert lexicon.decode("thewarden kept".split())[0] == ["the", "warden", "kept"]
    assert lexicon.decode([])[0] == []


def test_scans_of_tables(spark):
    rows = [("A:p1:para0:part0", " ".join(WORDS) + " mea-\nsured", None, None, 1, "", "k")] * 2 + [("B:html:para0:part0", "mea-\nsured", None, None, None, None, "k"), ("C:p1:para0:part0", None, None, None, None, None, "k"), ("D:p1:para0:part0", "", None, None, None, None, "k")] + [(f"E{i}:note:para0:part0", " ".join(WORDS), None, None, None, None, "k") for i in range(5)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, title string, creators string, page int, page_label string, hyphen string")
    out = s.repaired(df, s.lexicon_of(df, "text")).dropDuplicates(["chunk_id"]).collect()
    assert [(r.chunk_id, r.hyphen) for r in out] == [("A:p1:para0:part0", 1)] and out[0].repaired.endswith("measured")
    assert s.repaired(df.limit(0), s.lexicon_of(df.limit(0), "text")).count() == 0


def test_words_out_of_memory_are_read_from_the_file(spark):
    schema = "chunk_id string, text string, title string, creators string, page int, page_label string"
    long = "Torvarenfjord" + "reedbedgullcolonysurvey" * 2
    texts = [" ".join(WORDS), f"the {long} was found"] * 4 + ["the warden rneasured tbe rced bed near thc harbour", "The harb0ur and Gull c0lony, the list of that year", "the thewarden kept re-\nform and sur-\nvey"]
    texts += [f"the {long.replace('e', 'c', 1).replace('n', 'ri', 1)} was found", f"the {long[:20]}-\n{long[20:]} was found"]
    df = spark.createDataFrame([(f"A:p{i}:para0:part0", t, None, None, None, None) for i, t in enumerate(texts)], schema)
    whole = s.lexicon_of(df, "text")
    rows = sorted(s.repaired(df, whole).collect())
    fixed = {r.chunk_id: r.repaired for r in rows}
    assert fixed["A:p8:para0:part0"] == "the warden measured the reed bed near the harbour"
    assert fixed["A:p11:para0:part0"] == fixed["A:p12:para0:part0"] == f"the {long} was found"
    for most in (0, 1, 3, len(whole) - 1):
        few = s.lexicon_of(df, "text", most=most)
        assert sorted(s.repaired(df, few).collect()) == rows, most
        assert len(few) == most and few.total == whole.total and few.items() <= whole.items()
    assert whole["warden"] == 5 and whole.total == sum(whole.values()) + 4  # the long word alone is in the file


def test_confusions_of_long_words_against_trying_all():
    assert all(s.fold_key(bad) == s.fold_key(good) for bad, good in s.CONFUSIONS) and s.fold_key("Chili") == s.fold_key("chili")
    for word in ("rnvvhcl", "6illmrn", "C0ri|bot", "iiiiii"):
        least, layer = {word: 0}, [word]
        for k in (1, 2, 3):
            following = {w[:i] + good + w[i + len(bad) :] for w in layer for bad, good in s.CONFUSIONS for i in range(len(w)) if w.startswith(bad, i)}
            layer = [v for v in following if v not in least]
            least.update(dict.fromkeys(layer, k))
        del least[word]
        assert all(s.confusions_between(word, v) == k and s.fold_key(v) == s.fold_key(word) for v, k in least.items())
        assert all(s.confusions_between(word, v[::-1]) == least.get(v[::-1]) for v in least if v[::-1] != word)


SPAM = [
    "cheap reed mats, reed mats Torford, buy reed mats, cheap reed mats, reed mats online, " * 8, "#reed #mats #reed_mats " * 20, '<a href="http://a.invalid/x">reed mats</a> ' * 20, "http://a.invalid/reed http://b.invalid/reed " * 15, "r33d m@ts ~ buy re3d mat5 ~ " * 20, "\n".join(f"TORV-{i} reed mat {i}.50 EUR in stock Add to cart" for i in range(20)), "Looking for reed mats? Our reed mats are the best reed mats in Torford. Why reed mats? Because reed mats beat every other mats for reed mats fans. " * 5, "where to buy reed mats near me\nbest way to buy reed mats cheap\n" * 10, "дешёвые лампы Торфорд, купить лампы, скидка лампы, " * 12, "便宜盐灯 正品盐灯 二手盐灯 批发盐灯 " * 12,
]
PROSE = ["The warden measured the reed bed in the spring, and the list was kept in the harbour office for a year. ", "Nobody asked why the {} of the shore had changed, though the survey of that year says so plainly. ", "It was {} before the reform, and the author returned to the village to measure it again. ", "The record of the {} is older than the mill, and the map of the coast shows both of them. "]
FINE = [
    "References\n" + "\n".join(f"Torv{x}en, A. (19{i}0). The {x} of the shore. Papers 4(2), {i}–{i + 9}." for i, x in enumerate("abcdefghi")), "\n".join(f"{w}, {i}, {i + 100}–{i + 130}; see also mill {i}" for i, w in enumerate(["reed bed", "salt pan", "tide gauge", "wool bale", "organ loft", "stone wall"])), "Contents\n" + "\n".join(f"{i}  On the {w} of the shore .......... {i * 7}" for i, w in enumerate("bed mill list wall pan".split())),
    "\n\n".join(f"http://a.invalid/{w} — A page on the {w} of the shore, with a map of it and a list of what was found there. It was read in the spring." for w in ("bed", "mill", "wall")), "def f(x):\n    return {'k': [i**2 for i in x if i != 0]}\n" * 8, "414 933 120 " * 60, "", None, "   ", "four words are few",
]


def prose(i):
    return "".join(q.format(f"place {chr(97 + (i * 7 + k) % 26)}{chr(97 + (i * 3 + k) % 26)}") for k, q in enumerate(PROSE * 2))


def test_spam_and_its_neighbours(spark):
    docs = [(i, t) for i, t in enumerate(SPAM + FINE)] + [(1000 + i, prose(i)) for i in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, spam string")
    found = {r.doc_id for r in p.spam(df, "doc_id", "text").where("spam").collect()}
    assert found == set(range(len(SPAM))), (found ^ set(range(len(SPAM))))
    assert p.spam(df.limit(0), "doc_id", "text").count() == 0


def test_distance_and_direction_decide(spark):
    docs = [(i, t) for i, t in enumerate(SPAM + FINE)] + [(1000 + i, prose(i)) for i in range(300)]
    rows = p.measured(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").cache()
    estimates = p.robust_estimates(rows)
    axes = p.directions(rows, estimates)
    f = rows.toPandas()
    w = p.deviations(f, estimates)
    spam = f["doc_id"].to_numpy() < len(SPAM)
    outliers = (w**2).sum(axis=1) > p.OUTLIER
    assert (p.is_spam(w, axes) == spam).all()
    assert (outliers & ~spam).sum() >= 3  # the distance alone takes pages that are no spam
    assert (~outliers & p.seeds()[1][(w @ axes.T).argmax(axis=1)]).any()  # so does the direction alone
    assert (p.is_spam(w / 100, axes) == False).all()  # noqa: E712
    assert np.allclose(np.linalg.norm(axes, axis=1), 1)


def test_estimates_shrink_smoothly(spark):
    rng = np.random.default_rng(1)
    rows = [("en", *map(float, r)) for r in rng.normal(0.2, 0.1, size=(2000, len(p.FEATURES)))]
    columns = "language string, " + ", ".join(f"{f} double" for f in p.FEATURES)
    small, large = ([("pl", *map(float, r)) for r in rng.normal(0.6, 0.1, size=(n, len(p.FEATURES)))] for n in (10, 1000))
    few = p.robust_estimates(spark.createDataFrame(rows + small, columns))["pl"][0]
    many = p.robust_estimates(spark.createDataFrame(rows + large, columns))["pl"][0]
    assert (few < 0.27).all() and (many > 0.45).all()


def test_estimates_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0.4, 0.2, size=(400, len(p.FEATURES)))
    df = spark.createDataFrame([(i, "en", *map(float, r)) for i, r in enumerate(x)], "doc_id long, language string, " + ", ".join(f"{f} double" for f in p.FEATURES))
    centre, scale, root = p.robust_estimates(df)["en"]
    assert np.allclose(centre, np.median(x, axis=0), atol=0.01)
    mad = 1.4826 * np.median(np.abs(x - centre), axis=0)
    assert np.allclose(scale, mad, atol=0.01)
    z = np.clip((x - centre) / scale, -3, 3)
    assert np.allclose(np.linalg.inv(root @ root), 0.7 * np.cov(z.T, bias=True) + 0.3 * np.eye(len(p.FEATURES)), atol=0.02)
