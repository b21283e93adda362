from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.engine import Engine
from quire.functions.embedding import HashingEmbedder, cosine_distance, embed
from quire.operators import context, items, search, where

HITS = "q int, rank int, chunk_id string, itemKey string, distance double, title string"


def hits(spark, lists):
    return spark.createDataFrame([(q, r + 1, c, c.upper() if c != "z" else None, 0.1 * r, c) for q, cs in enumerate(lists) for r, c in enumerate(cs)], HITS)


def fused(spark, lists):
    return [r.chunk_id for r in search.best_first(search.fuse_passages(hits(spark, lists)), 10).collect()]


def test_fusion_order_and_ties(spark):
    assert fused(spark, [["a", "b"], ["b", "c"]]) == ["b", "a", "c"]
    assert fused(spark, [["a", "b"], ["b", "a"]]) == ["a", "b"]
    one = search.fuse_passages(hits(spark, [["a"]])).first()
    assert one.rrf_score == 1 / 61
    assert search.best_first(search.fuse_passages(hits(spark, [["a"]])), 0).count() == 0


def test_items_add_up_and_keep_the_first_metadata(spark):
    rows = [(0, 1, "c1", "X", 0.3, "first"), (0, 2, "c2", "X", 0.2, "second"), (0, 3, "c3", None, 0.1, "none"), (0, 4, "c4", "Y", 0.4, "y")]
    out = search.fuse_items(spark.createDataFrame(rows, HITS), meta=("title",)).orderBy(F.desc("rrf_score")).collect()
    assert [(r.itemKey, r.title, r.distance) for r in out] == [("X", "first", 0.2), ("Y", "y", 0.4)]
    assert out[0].rrf_score == 1 / 61 + 1 / 62 and out[1].rrf_score == 1 / 64


def test_nearest_is_exact_whatever_the_partitions(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8))
    m[200:230] = m[5]  # ties
    data = [(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 8), (902, [1.0])]
    rows = spark.createDataFrame(data, "k long, v array<double>")
    queries = spark.createDataFrame([(i, m[i].tolist()) for i in (5, 17)], "q long, vec array<double>")
    want = {}
    for q in (5, 17):
        d = np.round(1 - m @ m[q] / np.linalg.norm(m, axis=1) / np.linalg.norm(m[q]), 9)
        want[q] = sorted(range(300), key=lambda i: (d[i], i))[:40]
    for n in (1, 7):
        out = search.nearest(queries, rows.repartition(n), 40, key="k", vector="v").collect()
        for q in (5, 17):
            assert [r.k for r in sorted((r for r in out if r.q == q), key=lambda r: r["rank"])] == want[q]
    assert search.nearest(queries, rows, 0, key="k", vector="v").count() == 0
    assert search.nearest(queries, rows.limit(0), 3, key="k", vector="v").count() == 0


def test_distance_in_the_jvm_agrees(spark):
    r = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>").select(cosine_distance(F.col("a"), F.col("b")).alias("d")).first()
    assert abs(r.d - (1 - 1 / 2**0.5)) < 1e-9


def test_filters(spark):
    rows = spark.createDataFrame([("pdf", 1990, "a"), ("note", 2000, None), (None, None, "b")], "source_type string, year int, itemKey string")
    count = lambda w: rows.where(where.compile_where(w)).count()
    assert count(None) == 3 and count({"source_type": "pdf"}) == 1 and count({"source_type": {"$ne": "note"}}) == 2
    assert count({"$or": [{"year": {"$gte": 2000}}, {"itemKey": {"$in": ["b"]}}]}) == 2 and count({"$not": {"year": {"$lt": 1995}}}) == 2
    assert count({"$and": []}) == 3 and count({"$or": []}) == 0 and count({"itemKey": {"$in": []}}) == 0 and count({"year": {"$gt": 1, "$lt": 1995}}) == 1
    with pytest.raises(ValueError):
        where.compile_where({"year": {"$near": 1}})


@pytest.mark.parametrize(
    ("filter_", "asks"),
    [
        ({"$or": [{"source_type": "note"}, {"itemKey": "K"}]}, True),
        ({"$not": {"source_type": "note"}}, False),
        ({"source_type": {"$in": ["pdf", "note"]}}, True),
        ({"$not": {"$not": {"source_type": "note"}}}, True),
        ({"$not": {"source_type": {"$ne": "note"}}}, False),
        ({"source_type": "pdf"}, False),
        (None, False),
    ],
)
def test_asks_for_notes(filter_, asks):
    assert where.asks_for_notes(filter_) is asks


def test_effective_filters():
    assert where.effective(None) == {"source_type": {"$ne": "note"}}
    assert where.effective(None, include_notes=True) is None
    assert where.effective({"a": 1}, item_keys=["k"]) == {"$and": [{"a": 1}, {"source_type": {"$ne": "note"}}, {"itemKey": {"$in": ["k"]}}]}


def test_ids_and_neighbours(spark):
    f = lambda i, w: spark.createDataFrame([(i,)], "i string").select(context.neighbour_ids(F.col("i"), w).alias("n")).first().n
    assert f("K:p12:para0:part0", 2) == [f"K:p12:para{i}:part0" for i in (0, 1, 2)]
    assert f("K:html:para3:part2", 1) == [f"K:html:para{i}:part0" for i in (2, 3, 4)]
    assert f("K:p1:para1", 2) == [] and f("K:p1:para1:part0", 0) == [] and f("K:pdf:para1:part0", 1) == [] and f("", 1) == []


def test_citations(spark):
    rows = [("T", 2020, 12, "xii"), ("T", None, 12, " "), ("T", 2020, None, None), ("T", None, None, None), (None, 2020, 1, "i"), ("", 2020, 1, "i"), ("T", 0, 3, None)]
    df = spark.createDataFrame(rows, "title string, year int, page int, page_label string").coalesce(1)
    assert [r.c for r in df.select(items.citation(*map(F.col, df.columns)).alias("c")).collect()] == ["T (2020) p.xii", "T p.12", "T (2020)", "T", "", "", "T p.3"]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    config = EngineConfig(index_dir=str(tmp_path_factory.mktemp("index")), min_return_chars=50)
    e = Engine(spark, embedder=HashingEmbedder(64), config=config)
    chunks = spark.read.parquet("/root/testdata/sf0.001/chunks.parquet").dropDuplicates(["chunk_id"]).drop("indexed_at")
    e.collection.write(chunks.withColumn("embedding", embed(F.col("text"), e.embedder)))
    return e


def test_search_laws(engine):
    items_found = engine.search_items("harbour survey of the reed bed", k=2).collect()
    keys = [r.itemKey for r in items_found]
    assert 0 < len(keys) <= 2
    inside = engine.rag_search(["harbour", "the survey lists"], k=10, include_item_keys=keys).collect()
    assert inside and {r.meta.itemKey for r in inside} <= set(keys)
    scores = [r.rrf_score for r in inside]
    assert scores == sorted(scores, reverse=True) and all(len(r.text.strip()) >= 50 for r in inside)
    first = [r.id for r in engine.rag_search("the survey lists", k=3).collect()]
    again = [r.id for r in engine.rag_search("the survey lists", k=5, exclude_chunk_ids=first).collect()]
    assert first and not set(first) & set(again)
    assert all(r.meta.source_type != "note" for r in engine.rag_search("note", k=10).collect())
    assert engine.rag_search("x", k=0).count() == 0 and engine.search_items("x", k=0).count() == 0


def test_context_round_trip(engine):
    hit = engine.rag_search("the survey lists", k=1, context_window=2).first()
    got = engine.get_chunk_context(hit.id, 2)
    assert got["chunk_ids_included"] and [c.id for c in hit.context] == got["chunk_ids_included"]
    assert "error" in engine.get_chunk_context("bad", 2) and "error" in engine.get_chunk_context(hit.id, 0) and "error" in engine.get_chunk_context("NONE:html:para0:part0", 1)


def test_inverted_file_reaches_its_recall(spark, tmp_path):
    from quire.operators import ann

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec"))
    centroids = ann.fit_centroids(rows, 16)
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, [0.0] * 64), (10**6 + 2, [1.0])], "vec_id long, embedding array<float>")
    ann.assign(rows.unionByName(odd), centroids).write.partitionBy("cell").parquet(str(tmp_path / "ivf"))
    indexed = spark.read.parquet(str(tmp_path / "ivf"))
    assert indexed.count() == rows.count() + 3
    got = {(r.q, r.vec_id) for r in ann.search(queries, indexed, centroids, 10, 12, key="vec_id").collect()}
    want = {(r.q, r.vec_id) for r in search.nearest(queries, rows, 10, key="vec_id").collect()}
    recall = len(got & want) / len(want)
    print(f"recall {recall:.3f}")
    assert recall >= 0.9
    full = {(r.q, r.vec_id, r.distance) for r in ann.search(queries, indexed, centroids, 10, 16, key="vec_id").collect()}
    assert full == {(r.q, r.vec_id, r.distance) for r in search.nearest(queries, rows, 10, key="vec_id").collect()}
    assert ann.search(queries, indexed, ann.fit_centroids(rows.limit(0), 4), 10, 3, key="vec_id").count() == 0


def test_models_are_resolved(tmp_path):
    from quire.functions import embedding

    c = EngineConfig(models_dir=str(tmp_path))
    assert isinstance(embedding.embedder_of(c), HashingEmbedder)
    fast = replace(c, embed_profile="fast", embed_device="cuda")
    assert embedding.resolve_model(fast) == ("sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2", "cuda") and embedding.embedder_of(fast).dim == 384
    assert embedding.resolve_model(replace(c, embed_profile="bge")) == (f"{tmp_path}/bge-m3", "cpu")
    with pytest.raises(FileNotFoundError):
        embedding.resolve_model(replace(fast, embed_offline=True))
    (tmp_path / "paraphrase-multilingual-MiniLM-L12-v2").mkdir()
    assert embedding.resolve_model(replace(fast, embed_offline=True))[0] == f"{tmp_path}/paraphrase-multilingual-MiniLM-L12-v2"
    assert embedding.resolve_model(replace(fast, embed_model="own/model"))[0] == "own/model"
    with pytest.raises(ValueError):
        embedding.resolve_model(replace(c, embed_profile="other"))


def test_texts_are_not_shuffled_for_bounded_hits(spark, small):
    from quire.plans import catalogue

    queries, chunks = catalogue._library(spark, small)
    fused = search.fuse_passages(search.nearest(queries, chunks, 25))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(chunks.join(search._bounded(fused, queries, 25), "chunk_id"))
    assert "strategy=broadcast" not in plan(chunks.join(search._bounded(fused, queries, search.BROADCAST_HITS), "chunk_id"))
