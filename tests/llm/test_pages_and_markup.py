import itertools
import math

import numpy as np
import pytest

from quire.llm import boilerplate as b
from quire.llm import markup as m

PROSE = ["The survey of the reed bed was repeated in the second year, and the list was kept by the warden of the shore.", "Der Bericht beschreibt die Lage der Mühle, und der Anhang nennt die Namen der Dörfer.", "Le registre décrit la récolte de la vallée, et la carte en donne les limites.", "El informe describe la cosecha del valle, y el mapa da sus límites."]


@pytest.fixture(scope="module")
def classifier():
    body = [f"{p} {q}" for p, q in itertools.product(PROSE, PROSE)] * 8
    return b.fit_on_labelled(["The reed bed of Torford", "Die Mühle von Pelburg", "La carte de Gorville"], body, [])


def test_held_out_furniture_and_body(classifier):
    furniture = ["Home | About | Press | Shop | Contact", "We use cookies to count visitors. Accept all Reject all", "© 2011 Pelmere Journal. All rights reserved. Privacy | Imprint", "Teilen · drucken · {n} Kommentare", "Inscrivez-vous à la lettre. Votre adresse. Valider", "You are here: Home > Archive > The reed bed of Torford"]
    body = ["The reed bed of Torford", "The warden sold the reed in that year, and the money went to the school of the village.", "Die Mühle wurde im Herbst verkauft, und der Müller zog in die Stadt.", "• Reed bed, Torford\n• Mill pond, Gorburg\n• Salt pan, Helmere", "Fig. 3. The growth of the reed by year.", "Her comments were printed, and the rights were sold to the society."]
    assert (classifier.logits(furniture) < 0).all() and (classifier.logits(body) > 0).all()
    assert classifier.logits([]).shape == (0,)


def brute_marginals(pages):
    """Sums over all states of each page's tree."""
    out = {}
    for sections in pages.values():
        names = sorted(sections)
        blocks = [(s, i) for s in names for i in range(len(sections[s]))]
        weight = np.zeros(len(blocks))
        total = 0.0
        for page in (1, 0):
            for states in itertools.product((1, 0), repeat=len(names)):
                for marks in itertools.product((1, 0), repeat=len(blocks)):
                    w = 1.0
                    for s in states:
                        w *= b.PAGE_SECTION if s == page else 1 - b.PAGE_SECTION
                    for (s, i), x in zip(blocks, marks):
                        w *= b.SECTION_BLOCK if x == states[names.index(s)] else 1 - b.SECTION_BLOCK
                        w *= math.exp(sections[s][i]) if x else 1.0
                    total += w
                    weight += w * np.array(marks)
        out |= {k: v / total for k, v in zip(blocks, weight)}
    return out


def test_sum_product_against_all_states(spark):
    pages = {"p": {"a": [2.0, -1.0], "b": [0.3], "c": [-3.0, 0.0]}, "q": {"d": [1.0, 1.5, -0.2]}}
    df = spark.createDataFrame([(p, s, v) for p, ss in pages.items() for s, v in ss.items()], "page string, section string, logits array<double>")
    got = {(r.section, r.block_no): r.body for r in b.marginals(df, "page", "section").collect()}
    want = brute_marginals(pages)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_ties_are_counted():
    page, section = b.fit_ties([("p", [0.9, 0.9, 0.9, 0.9]), ("p", [0.8, 0.9, 0.7]), ("q", [0.1, 0.1, 0.2]), ("q", [0.2])] * 20)
    assert section == b.MOST_TIE and page == b.MOST_TIE
    page, section = b.fit_ties([("p", [0.9, 0.1])] * 50)
    assert section == b.LEAST_TIE
    assert b.fit_ties([]) == (0.5, 0.5)


def test_blocks_of_tables(spark, classifier):
    rows = [("A:html:para0:part0", "A", f"Home | News | Shop | Contact\n\n{PROSE[0]}", 1), ("A:html:para0:part0", "A", f"Home | News | Shop | Contact\n\n{PROSE[0]}", 2), ("B:html:para0:part0", None, PROSE[1], 3), ("C:html:para0:part0", "C", None, 4), ("D:html:para0:part0", "D", "", 5)]
    df = spark.createDataFrame(rows, "chunk_id string, attachmentKey string, text string, body int")
    out = {(r.chunk_id[0], r.block_no): r.body for r in b.judged(df, classifier).collect()}
    assert out["A", 0] < 0.5 < out["A", 1] and out["B", 0] > 0.5 and ("D", 0) in out and len(out) == 4
    assert b.judged(df.limit(0), classifier).count() == 0


FAMILIES = [
    ("<p>a <b>b</b></p>", {"html"}), ("R &amp; D", {"html"}), ("&lt;b&gt;x&lt;/b&gt;", {"html"}), ("open <br> only", {"html"}), ("text</p>\nmore", {"html"}), ("<!-- c --> x", {"html"}), ("<P CLASS='x'>a<o:p></o:p></P>", {"html"}),
    ("# Head\n\ntext", {"markdown"}), ("Head\n====\n\ntext", {"markdown"}), ("a **b** c", {"markdown"}), ("- one\n- two", {"markdown"}), ("see [a](http://b.invalid/c)", {"markdown"}), ("| a | b |\n|---|---:|\n| 1 | 2 |", {"markdown"}), ("```\nx = [[1]]\n```", {"markdown"}), ("> quoted line\n> another", {"markdown"}), ("a `code` b", {"markdown"}), ("- [ ] task\n- [x] done", {"markdown"}), ("word *em* word", {"markdown"}),
    ("== Head ==\ntext", {"wiki"}), ("a [[link|b]] c", {"wiki"}), ("'''b''' is ''i''", {"wiki"}), ("x{{cite|a=b}}", {"wiki"}), ('{| class="w"\n! a !! b\n|-\n| 1 || 2\n|}', {"wiki"}), ("* one\n* two\n'''b'''", {"wiki"}),
    ("\\section{A}\ntext", {"latex"}), ("so $x^{2}$ holds", {"latex"}), ("a~\\cite{b}", {"latex"}), ("\\begin{equation}\ny = a_b\n\\end{equation}", {"latex"}), ("\\[ E = m_1 \\]", {"latex"}), ("\\emph{x} y", {"latex"}), ("M\\\"orvik and the caf\\'e", {"latex"}),
    ("<p>a [[b]]</p>", {"html", "wiki"}), ("**a** and $\\beta_1$", {"markdown", "latex"}), ("<pre><code># no head\n**no bold** [[0]] $x^2$</code></pre>", {"html"}),
    ('<div>x</div><pre class="math">$$\\int_0^{3} f(x)\\,dx$$</pre>', {"html", "latex"}), ("~~gone~~ text", {"markdown"}),
    ("plain text", set()), ("p < 0.05 and n > 30, so a < b", set()), ("2 * 3 * 4 boxes; R & D budget [sic].", set()), ("It cost $5 to $10 in 2004.", set()), ("Range ~5–7, x_1 unknown {draft}.", set()), ("1) check dates\n 2) ask the editor", set()), ('"Quoted" -- then nothing.', set()), ("a <- b and c -> d <draft>", set()), ("(C# and F# major)", set()), ("say \\\"open\\\" here", set()), ("", set()),
]


def test_families(spark):
    df = spark.createDataFrame([(f"k{i}", t, "x") for i, (t, _) in enumerate(FAMILIES)] + [("none", None, "x"), (None, "<p>x</p>", "x"), ("k0", FAMILIES[0][0], "again")], "noteKey string, note_html string, family string")
    out = {}
    for r in m.families(df, "noteKey", "note_html").collect():
        out.setdefault(r.key, set()).add(r.family)
    wrong = {t: (out.get(f"k{i}", set()), want) for i, (t, want) in enumerate(FAMILIES) if out.get(f"k{i}", set()) != want}
    assert not wrong and set(out) <= {f"k{i}" for i in range(len(FAMILIES))}
    assert m.families(df.limit(0), "noteKey", "note_html").count() == 0


def test_classes_decide_what_the_lexer_proposes(spark):
    texts = [t for t, _ in FAMILIES] * 2 + ["so $a = b$ holds", "a * b", "it costs $7 and $8", "x_1 and x_2"]
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "noteKey string, note_html string")
    tokens = m.tokens_of(df, "noteKey", "note_html").cache()
    right = {(f"k{i}", f) for i, (_, fs) in enumerate(FAMILIES * 2) for f in fs} | {(f"k{2 * len(FAMILIES)}", "latex")}
    found = {(r.key, r.family) for r in m.accepted(tokens).select("key", "family").distinct().collect()}
    proposed = {(r.key, r.family) for r in tokens.select("key", "family").distinct().collect()}
    alone = {(r.key, r.family) for r in tokens.where("known").select("key", "family").distinct().collect()}
    assert found == right and proposed > right and len(proposed - right) >= 10  # without classes: either false rows
    assert len(right - alone) >= 20  # or rows lost


def test_classes_of_unknown_tags(spark):
    rows = [(f"n{i}", f"<note-{'x' if i < 3 else 'y'}>a{'</note-x>' if i < 3 else ''}") for i in range(5)]
    df = spark.createDataFrame([(k, t.replace("note-", "note")) for k, t in rows], "noteKey string, note_html string")
    out = {r.key for r in m.families(df, "noteKey", "note_html").collect()}
    assert out == {"n0", "n1", "n2"}  # pairs that nest in several notes are a template, a lone word is not


def test_classes_of_different_names(spark):
    rows = [(f"n{i}", "<card><pic>a</card> <draft> b") for i in range(2)] + [("n2", "<draft> c"), ("n3", "<one><two></one></two>"), ("n4", "<one><two></one></two>"), ("n5", None)]
    df = spark.createDataFrame(rows, "noteKey string, note_html string")
    classes = {(r.name, r["class"]) for r in m.valid_classes(m.tokens_of(df, "noteKey", "note_html")).collect()}
    assert {n for n, _ in classes} == {"card", "pic", "one"} and len({c for n, c in classes if n != "one"}) == 1  # crossed tags nest for one name at most
    out = {r.noteKey: r.clean for r in m.cleaned(df, "noteKey", "note_html").collect()}
    assert out["n0"] == out["n1"] == "a <draft> b" and out["n2"] == "<draft> c" and out["n5"] is None


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("<h2>Head</h2><p>a <b>b</b> &amp; c<br>d</p><ul><li>x</li><li>y</li></ul>", "## Head\n\na b & c\nd\n\n- x\n\n- y"),
        ("<pre><code># keep\nx = 1\n</code></pre>", "```\n# keep\nx = 1\n```"),
        ("== Head ==\n'''a''' [[b|c]]{{cite|x}}", "# Head\n\na c"),
        ("\\section{H}\n\\emph{a} $x^{2}$ b~\\cite{k}", "# H\n\na $x^{2}$ b"),
        ("M\\\"orvik, caf\\'e, fa\\c{c}ade", "Mörvik, café, façade"),
        ("Head\n===\n\n**a** [b](http://c.invalid) `k`", "# Head\n\na b `k`"),
        ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", "- a\n\n- b"),
        ("p < 0.05, 2 * 3 * 4, x_1 {draft}", "p < 0.05, 2 * 3 * 4, x_1 {draft}"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_text(raw, want):
    got = m.clean(raw)
    squeeze = lambda s: s if s is None else s.replace("\n\n- ", "\n- ")
    assert squeeze(got) == squeeze(want)
