import pytest

from quire.llm import queries

COLUMNS = {
    "p1_found": {"name_a": "string", "name_b": "string"},
    "p2_found": {"chunk_id": "string"},
    "p3_found": {"chunk_id": "string"},
    "p4_found": {"chunk_id": "string", "block_no": "int"},
    "p5_found": {"note_key": "string", "family": "string"},
    "p6_found": {"chunk_id": "string"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p10_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_distinct_rows(spark, small, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.01" if name == "p3_found" else small)
    assert dict(df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert rows and len({str(r) for r in rows}) == len(rows)


def test_every_document_is_packed_whole(spark, small):
    from quire.llm import bpe

    df = queries.QUERIES["p9_containers"](spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = {r.doc_id: r.n_tokens for r in bpe.count_column(docs, "doc_id", "text").collect()}
    capacity = {r.capacity_name: r.capacity_tokens for r in spark.read.parquet(f"{small}/pack_capacities.parquet").collect()}
    got, load = {}, {}
    for r in df.collect():
        got[r.capacity_name, r.doc_id] = got.get((r.capacity_name, r.doc_id), 0) + r.piece_size
        load[r.capacity_name, r.container] = load.get((r.capacity_name, r.container), 0) + r.piece_size
    assert got == {(c, d): n for c in capacity for d, n in sizes.items()}
    assert all(v <= capacity[c] for (c, _), v in load.items())


def test_p3_pieces(spark):
    rows = queries.QUERIES["p3_pieces"](spark, "/root/testdata/sf0.01").collect()
    assert rows and all(len(r.piece) <= 1200 for r in rows)
