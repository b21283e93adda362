"""Approximate nearest vectors: an inverted file over k-means cells.

The centroids are fitted on a bounded sample (``FIT_ROWS``, a parameter); every row is assigned to its
cell by a narrow map, so no row is left out.  A table written with the cell as partition column lets a
search read only the cells it probes.  Cells are never gathered: a cell with a third of all rows is
scanned by as many tasks as its files have splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.search import nearest
from quire.runtime import ship

FIT_ROWS, ROUNDS = 50_000, 12


def fit_centroids(rows: DataFrame, cells: int, vector: str = "embedding", *, most: int = FIT_ROWS, seed: int = 7) -> np.ndarray:
    """Unit centroids of spherical k-means on at most ``most`` rows, chosen by a hash of the vector."""
    picked = rows.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(vector)).limit(most)
    data = [np.asarray(r[0], dtype=np.float64) for r in picked.collect()]
    dim = max((len(v) for v in data), default=0)
    m = np.array([v for v in data if len(v) == dim and np.isfinite(v).all() and np.linalg.norm(v) > 0])
    if not len(m):
        return np.empty((0, dim))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    centroids = m[rng.choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(ROUNDS):
        at = np.argmax(m @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, m)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray, vector: str = "embedding", cell: str = "cell") -> DataFrame:
    """Every row with its cell; -1 for rows without a usable vector, which no search finds."""
    ship(rows.sparkSession)

    @F.pandas_udf(T.IntegerType())
    def of(s):
        out = np.full(len(s), -1, dtype=np.int32)
        dim = centroids.shape[1]
        good = [i for i, v in enumerate(s) if v is not None and len(v) == dim]
        if good and len(centroids):
            m = np.array([s.iloc[i] for i in good], dtype=np.float64)
            fine = np.isfinite(m).all(axis=1) & (np.linalg.norm(m, axis=1) > 0)
            out[np.array(good)[fine]] = np.argmax(m[fine] @ centroids.T, axis=1)
        return type(s)(out)

    return rows.withColumn(cell, of(F.col(vector)))


def probed(queries: DataFrame, centroids: np.ndarray, probes: int, q: str = "q", vector: str = "vec") -> dict[int, list]:
    """Cell -> queries that look into it; queries are stated by the caller and bounded."""
    out: dict[int, list] = {}
    for r in queries.select(q, vector).toLocalIterator():
        v = np.asarray(r[1] if r[1] is not None else [], dtype=np.float64)
        if len(v) == centroids.shape[1] and len(centroids):
            for c in np.argsort(-(centroids @ v), kind="stable")[:probes].tolist():
                out.setdefault(int(c), []).append(r[0])
    return out


def search(queries: DataFrame, indexed: DataFrame, centroids: np.ndarray, n: int, probes: int, *, q: str = "q", query_vector: str = "vec", key: str = "chunk_id", vector: str = "embedding", cell: str = "cell") -> DataFrame:
    """(q, rank, key, distance) of the nearest rows among each query's ``probes`` nearest cells.

    Only probed cells are read (the filter on the cell prunes partitions); within them distances are
    exact, and a hit counts only for queries that probed its cell."""
    by_cell = probed(queries, centroids, probes, q, query_vector)
    spark = indexed.sparkSession
    ship(spark)
    schema = T.StructType([T.StructField(q, queries.schema[q].dataType), T.StructField(key, indexed.schema[key].dataType), T.StructField("distance", T.DoubleType())])
    vectors = {r[0]: np.asarray(r[1], dtype=np.float64) for r in queries.select(q, query_vector).toLocalIterator() if r[1] is not None}
    if n <= 0 or not by_cell:
        return nearest(queries.limit(0), indexed, 0, q=q, query_vector=query_vector, key=key, vector=vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.asarray(batch.column(2))
            for c in np.unique(cells).tolist():
                at = np.flatnonzero(cells == c)
                keys = batch.column(0).take(pa.array(at))
                m = np.array(batch.column(1).take(pa.array(at)).to_pylist(), dtype=np.float64)
                names = by_cell.get(c, [])
                unit = np.array([vectors[x] / np.linalg.norm(vectors[x]) for x in names])
                distance = np.round(1.0 - (unit @ m.T) / np.linalg.norm(m, axis=1), 12) + 0.0
                for name, d in zip(names, distance):
                    near = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1]) if len(d) > n else np.arange(len(d))
                    yield pa.RecordBatch.from_pydict({q: [name] * len(near), key: keys.take(pa.array(near)), "distance": d[near]})

    from pyspark.sql.window import Window

    hits = indexed.where(F.col(cell).isin(sorted(by_cell))).select(key, vector, cell).mapInArrow(run, schema)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(q).orderBy("distance", key))).where(F.col("rank") <= n).select(q, "rank", key, "distance")
