import pytest

from quire.llm import encoding as e

CLEAN = [
    "Die Größe der Gebäude wurde geprüft, und die Häufigkeit der Vögel änderte sich über die Jahre.", "Les récits d’élèves précisent l’évolution des péages à l’échelle du delta, où la forêt a été coupée.", "El año pasado la región pequeña añadió señales según la encuesta, y también más mapas.", "Książka uzupełnia ceny zboża według świadków, a rozdział pomija ścieżki handlowe.",
    "Таможенная книга измеряет цены на зерно в северных долинах, и ранний отчёт уточняет сезонные изменения.", "调查小组在北部山谷比较了地名的写法，后来的版本二十年间测量了贝类的分布。", "The author writes of “uneven quality” — before the reform — and it’s the reader’s café that was naïve.", "A informação da edição não confirma a duração da estação, e a região não é só uma ligação.",
] * 60


@pytest.fixture(scope="module")
def model():
    return e.CharModel.of(*e.count_bigrams(CLEAN))


@pytest.mark.parametrize(("written", "read"), [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "cp1251"), ("cp1252", "cp437"), ("iso8859-2", "latin-1"), ("cp1251", "latin-1"), ("utf-8", "gbk")])
def test_chains_are_found_and_undone(model, written, read):
    tried = found = exact = 0
    for t in CLEAN[:8]:
        g = e.garble(t, written, read)
        if g and g != t and "�" not in g:
            tried += 1
            fixed, gain = e.restore(g, model, 8.0)
            found += gain > 8.0
            exact += fixed == t
    assert tried == 0 or found == tried and exact >= 0.6 * tried, (tried, found, exact)


def test_models_in_one_session_do_not_share_readings(model):
    other = e.CharModel.of(*e.count_bigrams(["Таможенная книга измеряет цены на зерно в северных долинах."] * 40))
    texts = [t.encode("cp1252").decode("cp1251") for t in CLEAN[:3]] + ["cafй", "naпve"]
    fresh = [e.restore(t, e.CharModel(*m.packed()[:-1]), 8.0) for m in (model, other) for t in texts]
    shared = [e.CharModel.unpacked(m.packed()) for m in (model, other, model)]
    assert [e.restore(t, m, 8.0) for m in shared[:2] for t in texts] == fresh
    assert [e.restore(t, m, 8.0) for m in (model, other) for t in texts] == fresh
    assert e.CharModel.unpacked(model.packed()) is shared[2]
    assert fresh[: len(texts)] != fresh[len(texts) :]


def test_every_reading_in_utf8_goes_on(model):
    t = CLEAN[1]
    for first, second in [(("utf-8", "mac_roman"), ("utf-8", "cp1252")), (("utf-8", "latin-1"), ("utf-8", "cp850"))]:
        g = e.garble(e.garble(t, *first), *second)
        assert e.restore(g, model, 8.0)[0] == t, (first, second)


def test_twice_garbled(model):
    t = CLEAN[0]
    twice = e.garble(e.garble(t, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert e.restore(twice, model, 8.0)[0] == t


def test_only_the_passage_is_restored(model):
    t = "An “early” naïve list. " + CLEAN[2].encode().decode("cp1252")
    assert e.restore(t, model, 8.0)[0] == "An “early” naïve list. " + CLEAN[2]


def test_lost_signs_are_found_and_filled(model):
    t = CLEAN[0].encode("cp1252").decode("utf-8", "replace")
    fixed, gain = e.restore(t, model, 8.0)
    assert gain > 8.0 and fixed.count("�") < t.count("�") and "Größe" in fixed or "Gr" in fixed


def test_clean_and_foreign_texts_stay(model):
    for t in [*CLEAN[:8], "ÎN MÂNĂ und CÂMP", "Â la carte", "NÃO HÁ TRADUÇÃO", "It’s £15 – § 4: «ça»", "x² ≈ 5 µm ± 3 °C", "© 2020", "", "plain ascii", "🙂👩‍🔬"]:
        fixed, gain = e.restore(t, model, 8.0)
        assert fixed == t and gain <= 8.0, (t, fixed, gain)


def test_margin_lies_between(model):
    margin = e.validated_margin(CLEAN[:80], model)
    assert e.LEAST_MARGIN <= margin < 30
    assert e.validated_margin([], model) == e.LEAST_MARGIN


def test_margin_rests_on_all_held_out_texts(spark, model):
    assert e.margin_of({0.0: 1999, 50.0: 1}, {60.0: 9}, 8.0, 0.0005) == 8.0  # one text in 2,000 may lie above it
    assert e.margin_of({0.0: 1998, 12.0: 2}, {60.0: 9}, 8.0, 0.0005) == 13.0
    held = [CLEAN[i % 6] + f" {i}" for i in range(60)]
    rows = [(t, "x") for t in [*held, *held[::-1], "plain", None, ""]]
    got = e.distributed_margin(spark.createDataFrame(rows, "text string, evidence string"), "text", model)
    assert abs(got - e.validated_margin([*held, *held], model)) <= 0.01
    df = spark.createDataFrame([(f"Größe {i}",) for i in range(400)], "text string")
    kept = {r.text for r in df.where(e.held_out("text")).collect()}
    assert 0 < len(kept) < 60 and {r.text for r in df.orderBy(e.F.desc("text")).where(e.held_out("text")).collect()} == kept


def test_on_tables(spark):
    rows = [(f"c{i}", t, "x") for i, t in enumerate(CLEAN[:80])] + [("bad", CLEAN[0].encode().decode("cp1252"), "x"), ("bad", CLEAN[0].encode().decode("cp1252"), "y"), ("none", None, "x"), ("empty", "", "x")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, evidence string")
    model, margin = e.trained(df, "text")
    out = e.repaired(df, ["chunk_id"], "text", model, margin).distinct().collect()
    assert [(r.chunk_id, r.restored) for r in out] == [("bad", CLEAN[0])]
    empty = df.limit(0)
    assert e.repaired(empty, ["chunk_id"], "text", *e.trained(empty, "text")).count() == 0


def test_without_a_model():
    t = CLEAN[1]
    assert e.without_model(t.encode().decode("cp1252", "replace")) != "" and e.without_model("wie schön") == "wie schön"
    assert e.without_model("été".encode().decode("latin-1")) == "été"
