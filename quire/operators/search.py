"""Search: nearest vectors per query, reciprocal-rank fusion by passage and by item."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.config import DEFAULT, EngineConfig
from quire.operators.context import with_context
from quire.operators.items import citation
from quire.operators.where import compile_where, effective
from quire.runtime import ship

#: Bytes of query vectors that one pass over the chunks may carry; more queries take more passes.
QUERY_BLOCK_BYTES = 32 << 20
#: Digits to which distances are compared, so that equal vectors tie on every machine.
DIGITS = 12


def _block_of_queries(queries: DataFrame, q: str, vector: str) -> list[tuple[list, np.ndarray]]:
    """Query ids and unit vectors in blocks of bounded size.  Queries are stated by the caller, not data that grows."""
    blocks, ids, rows, size = [], [], [], 0
    for r in queries.select(q, vector).toLocalIterator():
        v = np.asarray(r[1] if r[1] is not None else [], dtype=np.float64)
        ids.append(r[0])
        rows.append(v)
        size += v.nbytes
        if size >= QUERY_BLOCK_BYTES:
            blocks.append((ids, rows))
            ids, rows, size = [], [], 0
    if ids:
        blocks.append((ids, rows))
    return blocks


def nearest(queries: DataFrame, rows: DataFrame, n: int, *, q: str = "q", query_vector: str = "vec", key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(q, rank, key, distance): the ``n`` rows nearest to each query by cosine distance, exactly.

    Each task keeps the n nearest of each Arrow batch by one matrix product, so what is shuffled is
    n rows per query and batch; the final rank is a window over those, ties by key.  Rows without a
    vector, with a null in it, of another length or of length zero are no neighbours; n <= 0 gives none."""
    ship(rows.sparkSession)
    schema = T.StructType([T.StructField(q, queries.schema[q].dataType), T.StructField(key, rows.schema[key].dataType), T.StructField("distance", T.DoubleType())])
    spark = rows.sparkSession
    out = spark.createDataFrame([], schema)
    if n <= 0:
        return out.withColumn("rank", F.lit(0)).select(q, "rank", key, "distance")
    kept = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector)
    for ids, vectors in _block_of_queries(queries, q, query_vector):
        dim = max((len(v) for v in vectors), default=0)
        usable = [i for i, v in enumerate(vectors) if len(v) == dim and dim and np.isfinite(v).all() and np.linalg.norm(v) > 0]
        if not usable:
            continue
        unit = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in usable])
        names = [ids[i] for i in usable]

        def run(batches: Iterator[pa.RecordBatch], unit: np.ndarray = unit, names: list = names, dim: int = dim) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(1)
                lengths = np.diff(np.asarray(column.offsets))
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                good = np.flatnonzero(lengths == dim)
                if not len(good):
                    continue
                m = flat.reshape(-1, dim) if len(good) == len(lengths) else flat[np.repeat(lengths == dim, lengths)].reshape(-1, dim)
                norms = np.linalg.norm(m, axis=1)
                fine = np.isfinite(norms) & (norms > 0)
                m, good, norms = m[fine], good[fine], norms[fine]
                if not len(good):
                    continue
                distance = np.round(1.0 - (unit @ m.T) / norms, DIGITS) + 0.0
                keys = batch.column(0).take(pa.array(good))
                order = np.argsort(np.asarray(keys.to_pylist(), dtype=object), kind="stable")
                rank = np.empty(len(good), dtype=np.int64)
                rank[order] = np.arange(len(good))
                for i, name in enumerate(names):
                    d = distance[i]
                    near = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1]) if len(d) > n else np.arange(len(d))
                    near = near[np.lexsort((rank[near], d[near]))][:n]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(near), schema_arrow[0]), keys.take(pa.array(near)), pa.array(d[near])], names=schema.names)

        schema_arrow = [pa.int64() if isinstance(schema[0].dataType, T.LongType) else pa.int32() if isinstance(schema[0].dataType, T.IntegerType) else pa.string()]
        out = out.unionByName(kept.mapInArrow(run, schema))
    rank = F.row_number().over(Window.partitionBy(q).orderBy("distance", key))
    return out.withColumn("rank", rank).where(F.col("rank") <= n).select(q, "rank", key, "distance")


def _score(pairs: Column, k: int) -> Column:
    """Sum of 1 / (k + rank) in the order of (query, rank), so that equal hits give equal sums."""
    return F.aggregate(F.array_sort(pairs), F.lit(0.0), lambda a, p: a + 1.0 / (k + p["rank"]))


def fuse_passages(hits: DataFrame, *, q: str = "q", key: str = "chunk_id", k: int = DEFAULT.rrf_k) -> DataFrame:
    """(key, distance, rrf_score, first_q, first_rank): fused over queries; order by score, ties by first sighting."""
    pairs = F.struct(F.col(q).alias("q"), F.col("rank"))
    fused = hits.groupBy(key).agg(F.min("distance").alias("distance"), F.collect_list(pairs).alias("__pairs"), F.min(pairs).alias("__first"))
    return fused.select(key, "distance", _score(F.col("__pairs"), k).alias("rrf_score"), F.col("__first.q").alias("first_q"), F.col("__first.rank").alias("first_rank"))


def fuse_items(hits: DataFrame, *, q: str = "q", item: str = "itemKey", meta: tuple[str, ...] = ("title", "year", "creators", "source_type"), k: int = DEFAULT.rrf_k) -> DataFrame:
    """(item, meta..., distance, rrf_score, first_q, first_rank): every hit of an item adds up; the metadata is that
    of its first hit; hits without an item are left out here, though they kept their rank."""
    pairs = F.struct(F.col(q).alias("q"), F.col("rank"))
    first = F.min_by(F.struct(*meta), pairs) if meta else F.lit(None)
    fused = hits.where(F.coalesce(F.col(item).cast("string"), F.lit("")) != "").groupBy(item).agg(F.min("distance").alias("distance"), F.collect_list(pairs).alias("__pairs"), F.min(pairs).alias("__first"), first.alias("__meta"))
    return fused.select(item, *(F.col(f"__meta.{m}").alias(m) for m in meta), "distance", _score(F.col("__pairs"), k).alias("rrf_score"), F.col("__first.q").alias("first_q"), F.col("__first.rank").alias("first_rank"))


def best_first(fused: DataFrame, k: int) -> DataFrame:
    return fused.orderBy(F.desc("rrf_score"), "first_q", "first_rank").limit(max(0, k))


HIT_META = ["title", "year", "creators", "page", "page_label", "pdf_path", "path", "itemKey", "attachmentKey", "noteKey", "source_type", "locator", "contentType", "filename"]


#: Fused hits up to which they are sent to every executor; more are joined by a shuffle.
BROADCAST_HITS = 200_000


def _bounded(hits: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """Hits of ``queries`` (n each, at most) as the small side of a join, where the bound is small indeed: then the
    chunks and their texts are not shuffled."""
    return F.broadcast(hits) if queries.count() * max(0, n) <= BROADCAST_HITS else hits


def search_passages(
    queries: DataFrame, chunks: DataFrame, k: int = 5, where: dict | None = None, context_window: int = 0, include_notes: bool = False, include_item_keys: list[str] | None = None, exclude_chunk_ids: list[str] | None = None, *, config: EngineConfig = DEFAULT
) -> DataFrame:
    """id, distance, rrf_score, citation, text, context, meta of the best passages for a table of queries (q, vec).

    The filter restricts candidates before ranking; 5k of each query (and one more for every excluded
    id) are fused; exclusion and the minimum length come after fusion, as they bound which ranks count.
    Text and metadata join only for fused hits."""
    excluded = list(exclude_chunk_ids or [])
    eligible = chunks.where(compile_where(effective(where, include_notes=include_notes, item_keys=include_item_keys)))
    n = 5 * k + len(excluded) if k > 0 else 0
    fused = fuse_passages(nearest(queries, eligible, n), k=config.rrf_k)
    if excluded:
        fused = fused.where(~F.col("chunk_id").isin(excluded))
    rich = chunks.join(_bounded(fused, queries, n), "chunk_id").where(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")) >= config.min_return_chars)
    top = best_first(rich, k)
    out = with_context(top, chunks, context_window, bounded=k <= BROADCAST_HITS).orderBy(F.desc("rrf_score"), "first_q", "first_rank")
    return out.select(F.col("chunk_id").alias("id"), "distance", "rrf_score", citation(F.col("title"), F.col("year"), F.col("page"), F.col("page_label")).alias("citation"), "text", "context", F.struct(*HIT_META).alias("meta"))


def search_items(queries: DataFrame, chunks: DataFrame, k: int = 10, where: dict | None = None, include_notes: bool = False, include_item_keys: list[str] | None = None, *, config: EngineConfig = DEFAULT) -> DataFrame:
    """itemKey, title, year, creators, source_type, distance, rrf_score of the best items; texts are never read."""
    eligible = chunks.where(compile_where(effective(where, include_notes=include_notes, item_keys=include_item_keys)))
    n = max(10 * k, 100) if k > 0 else 0
    meta = chunks.select("chunk_id", "itemKey", "title", "year", "creators", "source_type")
    fused = fuse_items(meta.join(_bounded(nearest(queries, eligible, n), queries, n), "chunk_id"), k=config.rrf_k)
    return best_first(fused, k).drop("first_q", "first_rank")
