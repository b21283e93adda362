import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import splitting as s


def brute_cuts(text, limit, overlap, at, cost):
    """All ways through the same boundaries."""
    room = limit - overlap
    n = len(text)
    pieces = -(-(n - overlap) // room)
    even = (n - overlap) / pieces + overlap
    best = {0: (0.0, [])}
    for j in range(1, len(at)):
        found = []
        for i in range(j):
            size = at[j] - at[i] + (overlap if i else 0)
            sizes = [size] if i else [at[j], at[j] + overlap if at[j] + overlap <= limit else at[j]]
            if i in best and size <= limit:
                found.append((min(best[i][0] + s.BALANCE * ((z - even) / even) ** 2 for z in sizes) + cost[j], best[i][1] + [at[j]]))
        if found:
            best[j] = min(found)
    return best[len(at) - 1]


def total_cost(text, cuts, limit, overlap, at, cost):
    price = dict(zip(at, cost))
    n = len(text)
    even = (n - overlap) / (-(-(n - overlap) // (limit - overlap))) + overlap
    return sum(price[b] + s.BALANCE * ((b - a + overlap - even) / even) ** 2 if a else price[b] + min(s.BALANCE * ((z - even) / even) ** 2 for z in (b, b + overlap) if z <= limit or z == b) for a, b in zip([0, *cuts], cuts))


def test_least_cost_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "end. ", "long, ", "\n\n", "x" * 9, "。"]) for _ in range(rng.randint(12, 30)))
        limit, overlap = 40, 8
        if len(text) <= limit:
            continue
        at, cost = s.boundaries(text, limit - overlap)
        want = brute_cuts(text, limit, overlap, at, cost)
        got = s.cuts(text, limit, overlap)
        assert abs(total_cost(text, got, limit, overlap, at, cost) - want[0]) < 1e-9


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .,\n。字é́‍👩🏽"), max_size=400), st.integers(20, 60), st.integers(0, 10))
def test_pieces_join_to_the_text(text, limit, overlap):
    pieces = s.pieces(text, limit, overlap, overlap)
    assert all(len(p) <= limit for p in pieces)
    assert pieces[0] + "".join(p[overlap:] for p in pieces[1:]) == text


def test_natural_boundaries():
    sentence = "The bed was measured in the spring of that year, and the list was kept. "
    text = (sentence * 12).strip() + "\n\n" + (sentence * 8).strip()
    pieces = s.pieces(text)
    assert len(pieces) == 2 and pieces[0].endswith(".\n\n") and pieces[1][80:].startswith("The bed")
    assert len(s.pieces("x" * 5000)) == 5 and len(s.pieces("字" * 1300)) == 2
    assert s.pieces("字" * 1300)[1][:60] == s.pieces("字" * 1300)[0][-60:]
    cited = "see Doe et al. 1999, op. cit., p. 12, fig. 3 vs. No. 4 in the list of that year and of the next " * 30
    assert all(p.rstrip().split()[-1] not in {"al.", "cit.", "p.", "fig.", "vs.", "No."} for p in s.pieces(cited)[:-1])
    assert s.pieces("a" + "́" * 3000)[0] != ""


def test_only_oversized_rows_come_out(spark):
    long = "word and word. " * 100
    rows = [("a", 0, long, 1), ("b", 0, "short", 2), ("c", 0, None, 3), ("d", 0, "", 4), ("e", 0, " " * 2000 + "x" + "\t" * 2000, 5), ("f", 0, "y" * 1200 + " \n", 6), ("g", 0, "y" * 1201, 7), ("a", 0, long, 8)]
    df = spark.createDataFrame(rows, "chunk_id string, para_index int, text string, piece int")
    out = s.split_oversized(df, ["chunk_id", "para_index"], "text").collect()
    assert {r.chunk_id for r in out} == {"a", "g"} and all(len(r.piece) <= 1200 for r in out)
    assert sorted(r.part_index for r in out if r.chunk_id == "g") == [0, 1]
    every = s.split_all(df, ["chunk_id", "para_index"], "text")
    assert every.where("chunk_id = 'c'").first().piece is None and every.where("chunk_id IN ('b', 'd', 'e', 'f')").count() == 4
    assert s.split_oversized(df.limit(0), ["chunk_id"], "text").count() == 0
