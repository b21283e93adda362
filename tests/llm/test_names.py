import pytest

from quire.llm import names
from quire.llm.components import connected_components

SAME = [
    ["Torvalen, Kenneth B.", "torvalen, kenneth", "Kenneth TORVALEN", "TORVALEN, Kenneth", "Torvalen/Kenneth", "Torvalen, K.", "K. B. Torvalen", "Torvalen, KB", "Prof. Kenneth Torvalen", "Torvalen, Kenneth, PhD", "Torvlaen, Kenneth", "Torvalen, Ken", "Torvаlen, Kenneth", "Torvalen. Kenneth", "Torvalen, Ken.", "Torvalen  K"],
    ["van der Mullig, Małgorzata", "Gosia van der Mullig", "Mullig, Małgorzata van der", "Mullig, Malgorzata"],
    ["Brisk, Robert", "Bob Brisk"],
    ["Institute of Reed Survey, Gorwick", "Inst. Reed Survey, Gorwick", "The Institute of Reed Survey (Gorwick)", "Gorwick Institute of Reed Survey", "Reed Survey Institute, Gorwick", "Institute of Reed Survey Gorwick (IRS)", "IRS Gorwick", "INSTITUTE OF REED SURVEY, GORWICK", "Institute of Reed Survay, Gorwick", "Institute Reed Survey - Gorwick"],
    ["Academy of Soil & Water, Gorwick", "Academy of Soil and Water, Gorwick"],
]
APART = ["Torvalen, Zachary", "Brisk, Ursula", "Institute of Wool Trade, Gorwick", "Society for Reed Survey, Gorwick", "Institute of Reed Survey, Pelmere", "Harkonen, Judith"]


@pytest.fixture(scope="module")
def clustered(spark):
    every = [n for group in SAME for n in group] + APART + ["", "  ", "..."]
    df = spark.createDataFrame([(n,) for n in every], "name string")
    return {r.name: r.component for r in names.clusters(df, {"Gosia": "Małgorzata", "Ken": "Kenneth"}).collect()}


def test_variants_are_linked_and_others_stay_apart(clustered):
    for group in SAME:
        assert len({clustered[n] for n in group}) == 1, {n: clustered[n] for n in group}
    assert len({clustered[g[0]] for g in SAME} | {clustered[n] for n in APART}) == len(SAME) + len(APART)
    assert not {"", "  ", "..."} & set(clustered)


def test_ambiguous_abbreviations_stay_apart(spark):
    df = spark.createDataFrame([(n,) for n in ["Orvik, James", "Orvik, Judith", "Orvik, J.", "Orvik, Jam."]], "name string")
    out = {r.name: r.component for r in names.clusters(df).collect()}
    assert len(set(out.values())) == 3 and out["Orvik, Jam."] == out["Orvik, James"]


def test_pairs_are_all_pairs_in_code_point_order(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("Ä", 1), ("z", 2)], "name string, component int")
    assert {tuple(r) for r in names.pairs_of(df).collect()} == {("a", "b"), ("a", "Ä"), ("b", "Ä")}


def test_names_of_the_tables(spark):
    a = spark.createDataFrame([(["x", None, "y"],), (None,), ([],)], "creators array<string>")
    c = spark.createDataFrame([("y; z",), (None,)], "creators string")
    assert {r.name for r in names.all_names(a, c).collect()} == {"x", "y", "z"}
    assert names.clusters(names.all_names(a.limit(0), c.limit(0))).count() == 0


def test_overfull_blocks_are_blocked_by_letters(spark, monkeypatch):
    monkeypatch.setattr(names, "HOT_BLOCK", 1)
    df = spark.createDataFrame([(n,) for n in ["Tarlen, Walter", "Tarlem, Walter", "Torlan, Walter", "Tarlen, Patrick"]], "name string")
    out = {r.name: r.component for r in names.clusters(df).collect()}
    assert out["Tarlen, Walter"] == out["Tarlem, Walter"] != out["Torlan, Walter"]


def test_overfull_blocks_lose_no_pair(spark, monkeypatch):
    written = ["Torvalen, Kenneth", "Torvelen, Kennath", "Montgameriston, Walter", "Montgomereston, Walter", "Brisk, Robert", "Brisk Brisk, Robert", "Brisk, Robert Robert", "Brysk, Robert Robert", "Tarlen, Patrick", "Torlan, Patrick"]
    nodes = names.parsed(spark.createDataFrame([(n,) for n in written], "name string"), {}).select("key", "kind", "tokens").distinct()
    whole = {tuple(r) for r in names.accepted_pairs(nodes).collect()}
    monkeypatch.setattr(names, "HOT_BLOCK", 1)
    assert {tuple(r) for r in names.accepted_pairs(nodes).collect()} == whole
    assert {("person\tkennath\ttorvelen", "person\tkenneth\ttorvalen"), ("person\tmontgameriston\twalter", "person\tmontgomereston\twalter")} <= whole


def test_a_block_over_the_limit_against_brute_force(spark):
    from itertools import combinations, product

    written = [f"T{a}rv{b}l{c}n{d}s, {g}" for a, b, c, d in product("aeiou", "aeio", "aeiou", "ae") for g in ("Walter", "Wolter", "Walder")]
    forms = {names.parse(n, {})[1][0] + "\t" + names.parse(n, {})[1][1] for n in written}
    assert len(forms) > names.HOT_BLOCK and len({tuple(map(names.sound, f.split("\t"))) for f in forms}) == 1  # all of one sound
    nodes = names.parsed(spark.createDataFrame([(n,) for n in written], "name string"), {}).select("key", "kind", "tokens").distinct()
    got = {(r.a.split("\t", 1)[1], r.b.split("\t", 1)[1]) for r in names.accepted_pairs(nodes).collect()}
    assert got == {(a, b) for a, b in combinations(sorted(forms), 2) if names.same_name(a, b)}


def test_jaro_winkler():
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert names.jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-2)
    assert names.jaro_winkler("", "a") == 0.0 and names.jaro_winkler("a", "a") == 1.0


def test_components_of_chains_and_stars(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    star = [("hub", f"s{i:03}") for i in range(40)]
    odd = [("x", "x"), (None, "y"), ("p", "q"), ("q", "p"), ("p", "q")]
    df = spark.createDataFrame(chain + star + odd, "a string, b string")
    out = {r.node: r.component for r in connected_components(df).collect()}
    assert {out[f"n{i:03}"] for i in range(61)} == {"n000"} and {out[f"s{i:03}"] for i in range(40)} == {"hub"}
    assert out["p"] == out["q"] == "p" and "x" not in out and "y" not in out
    assert connected_components(df.limit(0)).count() == 0
