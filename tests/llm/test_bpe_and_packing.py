import os
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe, packing

PATH = os.path.join(bpe.TOKENIZERS_DIR, bpe.VOCABULARY)
TEXTS = ["", None, " ", "\n\n  \t", "Hello world", "don't we'll I'M", "aaaaaaaaaaaaaaaaa" * 50, "naïve café 漢字かな 🙂👩‍🔬", "<|endoftext|> as text", "a\x00b\x1cc", "  leading", "trailing  ", "x" * 5000, "1234567890" * 30, "​﻿ ​", "ﬁ ½ ²"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def ours(coder, texts):
    ids, bounds = coder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_ids_equal_the_library(reference):
    coder = bpe.PairIndexBPE(PATH)
    assert ours(coder, TEXTS) == reference(TEXTS)
    assert coder.count(TEXTS).tolist() == [len(x) for x in reference(TEXTS)]
    assert ours(coder, TEXTS[::-1]) == reference(TEXTS[::-1])  # from the table of known words
    assert ours(coder, []) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=8))
def test_any_text(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    assert ours(bpe.encoder(PATH), texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_table_starts_anew_when_full(reference):
    coder = bpe.PairIndexBPE(PATH, max_words=3)
    for _ in range(3):
        assert ours(coder, TEXTS) == reference(TEXTS)


def test_columns(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    out = {r.doc_id: r.ids for r in bpe.encode_column(df, "doc_id", "text").collect()}
    assert out[0] == [] and out[1] == [] and len(out) == len(TEXTS)
    assert {r.doc_id: r.n_tokens for r in bpe.count_column(df, "doc_id", "text").collect()} == {i: len(v) for i, v in out.items()}
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0


def check_plan(histogram, capacity):
    runs = packing.plan(histogram, capacity)
    load, given_ = Counter(), Counter()
    for s, a, b, c in runs:
        assert a == given_[s]
        given_[s] += b - a + 1
        for i in range(b - a + 1):
            load[c + i] += s
    assert given_ == {s: n for s, n in histogram if 0 < s <= capacity and n}
    assert all(v <= capacity for v in load.values()) and sorted(load) == list(range(len(load)))
    return len(load)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_plans_are_feasible_and_whole(histogram):
    used = check_plan(sorted(histogram.items()), 64)
    total = sum(s * n for s, n in histogram.items())
    # two containers under half full would have been one
    assert used <= 2 * total / 64 + 1


def test_plan_is_near_the_bound():
    import random

    rng = random.Random(1)
    h = Counter(rng.randint(1, 300) for _ in range(20_000))
    used = check_plan(sorted(h.items()), 1024)
    assert used <= 1.01 * sum(s * n for s, n in h.items()) / 1024 + 1
    assert check_plan([], 10) == 0 and check_plan([(0, 5)], 10) == 0


def test_the_fit_places_most_and_beats_the_greedy_rule():
    import random

    rng = random.Random(2)
    h = dict(Counter(min(256, max(1, round(rng.lognormvariate(4.6, 0.6)))) for _ in range(100_000)))
    bound = -(-sum(s * n for s, n in h.items()) // 256)
    fitted, greedy = packing._Plan(h, 256).fitted(), packing._Plan(h, 256).filled()
    assert fitted.by_fit == fitted.containers >= 0.9 * bound  # each of them full
    fitted.filled()
    assert fitted.containers < greedy.containers
    assert check_plan(sorted(h.items()), 256) == fitted.containers
    for capacity in (64, 1024):  # never worse than greedy, whatever the histogram
        few = dict(Counter(rng.randint(1, 64) for _ in range(500)))
        assert check_plan(sorted(few.items()), capacity) <= packing._Plan(few, capacity).filled().containers


def test_sub_groups_number_alike(spark):
    sizes = [7] * 500 + [3] * 90 + [10] * 40 + [23] * 60
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    for rows in (10_000, 13):
        load, pieces = Counter(), Counter()
        for r in packing.pack(df, "doc_id", "n_tokens", 10, rows_a_task=rows).collect():
            load[r.container] += r.piece_size
            pieces[r.doc_id] += r.piece_size
        assert pieces == dict(enumerate(sizes)) and max(load.values()) <= 10 and sorted(load) == list(range(len(load)))


def test_documents_in_containers(spark):
    sizes = [0, None, 1, 5, 10, 10, 11, 25, 30] + [4] * 400 + [3] * 7
    df = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(sizes)], "doc_id long, n_tokens long, container string")
    rows = packing.pack(df, "doc_id", "n_tokens", 10).collect()
    load, whole = Counter(), Counter()
    for r in rows:
        load[r.container] += r.piece_size
        whole[r.doc_id] += r.piece_size
    assert all(v <= 10 for v in load.values())
    assert {k: v for k, v in whole.items()} == {i: s or 0 for i, s in enumerate(sizes)}
    pieces = Counter(r.doc_id for r in rows)
    assert all(pieces[i] == max(1, -(-(s or 0) // 10)) for i, s in enumerate(sizes))
    assert packing.pack(df.limit(0), "doc_id", "n_tokens", 10).count() == 0
