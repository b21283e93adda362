"""Problem 8: byte-level BPE over the whole corpus with a pair occurrence index.

One Arrow batch at a time, the distinct pre-tokens that the worker has not met yet are laid out as
one flat array of byte tokens.  An index maps the rank of every mergeable pair to all its positions
in that array; a heap hands out the active ranks in ascending order, each rank is applied to all its
positions at once, and only the lists of the pairs that the merges touched are updated.  Pre-tokens
met before are looked up, so the index is built once per distinct pre-token and worker.

Defined results: a null text and an empty text have the empty list of ids (and 0 tokens); strings that
spell a special token are ordinary text; lone surrogates cannot occur in Arrow strings.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quire.runtime import ship

#: Folder of the public vocabularies on the driver, a parameter of every operator here.
TOKENIZERS_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Distinct pre-tokens a worker keeps; beyond that its table starts anew.
MAX_WORDS = 1_500_000

# Fixed value: the published pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte in the vocabulary file: printable Latin-1 bytes
    stand for themselves, the others take the code points from 256 on in ascending order."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(spare)) for b in range(256)]


class _WordTable(dict):
    """Word -> row; an unknown word gets the next row and waits in ``fresh``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.fresh.append(word)
        return row


class PairIndexBPE:
    """Encoder with the vocabulary and merges of a ``tokenizers`` JSON file of the byte-level BPE kind."""

    def __init__(self, path: str, max_words: int = MAX_WORDS) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)
        self.width = 1 << max(vocab.values()).bit_length()
        self.rank: dict[int, int] = {}
        left, right, made = [], [], []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault(vocab[a] * self.width + vocab[b], len(made))
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        self.left, self.right, self.made = left, right, made
        keys = np.fromiter(self.rank.keys(), dtype=np.int64, count=len(self.rank))
        ranks = np.fromiter(self.rank.values(), dtype=np.int64, count=len(self.rank))
        order = np.argsort(keys)
        self.sorted_keys, self.sorted_ranks = keys[order], ranks[order]
        self.find = regex.compile(PATTERN).findall
        self.max_words = max_words
        self._reset()

    def _reset(self) -> None:
        self.words = _WordTable()
        self.flat = np.empty(1 << 16, dtype=np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.lengths = np.zeros(1 << 14, dtype=np.int64)

    def _merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after another, and the number of tokens of each."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        # A word is followed by a barrier that no pair matches.
        data = np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)
        ends = np.cumsum(sizes + 1) - 1
        start_tokens = self.byte_ids[data]
        start_tokens[ends] = -1
        keys = start_tokens[:-1] * self.width + start_tokens[1:]
        keys[(start_tokens[:-1] < 0) | (start_tokens[1:] < 0)] = -1
        at = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        hit = np.flatnonzero(self.sorted_keys[at] == keys)
        ranks = self.sorted_ranks[at[hit]]
        order = np.argsort(ranks, kind="stable")
        ranks, hit = ranks[order], hit[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        occurrences = {int(r[0]): p.tolist() for r, p in zip(np.split(ranks, cuts), np.split(hit, cuts)) if len(r)}
        active = list(occurrences)
        heapq.heapify(active)
        n = len(start_tokens)
        token, after, before = start_tokens.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, width = self.rank.get, self.width
        while active:
            r = heapq.heappop(active)
            places = occurrences.pop(r)
            places.sort()
            a, b, c = self.left[r], self.right[r], self.made[r]
            for p in places:
                q = after[p]
                if token[p] != a or token[q] != b:
                    continue  # an earlier merge took one of the two
                token[p], token[q] = c, -2
                q = after[p] = after[q]
                before[q] = p
                left = before[p]
                if left >= 0 and (s := rank_of(token[left] * width + c)) is not None:
                    if s in occurrences:
                        occurrences[s].append(left)
                    else:
                        occurrences[s] = [left]
                        heapq.heappush(active, s)
                if (s := rank_of(c * width + token[q])) is not None and token[q] >= 0:
                    if s in occurrences:
                        occurrences[s].append(p)
                    else:
                        occurrences[s] = [p]
                        heapq.heappush(active, s)
        done = np.array(token, dtype=np.int64)
        live = done >= 0
        return done[live].astype(np.int32), np.diff(np.concatenate(([0], np.cumsum(live)[ends])))

    def _learn(self) -> None:
        fresh = self.words.fresh
        if not fresh:
            return
        ids, counts = self._merge_all(fresh)
        total, first = len(self.words), len(self.words) - len(fresh)
        while total > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
            self.lengths = np.concatenate((self.lengths, np.zeros_like(self.lengths)))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[first:total] = counts
        self.starts[first:total] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        fresh.clear()

    def _rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > self.max_words:
            self._reset()
        row, find = self.words.__getitem__, self.find
        per_text = [list(map(row, find(t))) if t else [] for t in texts]
        self._learn()
        counts = np.fromiter(map(len, per_text), dtype=np.int64, count=len(per_text))
        rows = np.fromiter((r for rs in per_text for r in rs), dtype=np.int64, count=int(counts.sum()))
        return rows, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offsets of each text in them."""
        rows, counts = self._rows(texts)
        sizes = self.lengths[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return self.flat[at], bounds

    def count(self, texts: list[str | None]) -> np.ndarray:
        rows, counts = self._rows(texts)
        sums = np.concatenate(([0], np.cumsum(self.lengths[rows])))
        return np.diff(sums[np.concatenate(([0], np.cumsum(counts)))])


_encoders: dict[str, PairIndexBPE] = {}


def encoder(path: str) -> PairIndexBPE:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = PairIndexBPE(path)
    return _encoders[path]


def _shipped(spark: SparkSession, directory: str, vocabulary: str) -> str:
    """The vocabulary sent from the driver to every executor, once per context; its name there."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_quire_files", set())
    path = os.path.join(directory, vocabulary)
    if path not in sent:
        sc.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def encode_column(df: DataFrame, key: str, text: str, *, out: str = "ids", directory: str = TOKENIZERS_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row of ``df``: a narrow, shuffle-free map over the two columns it needs."""
    ship(df.sparkSession)
    name = _shipped(df.sparkSession, directory, vocabulary)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(SparkFiles.get(name))
        for batch in batches:
            ids, bounds = bpe.encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, out])

    return df.select(key, text).mapInArrow(run, schema)


def count_column(df: DataFrame, key: str, text: str, *, out: str = "n_tokens", directory: str = TOKENIZERS_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row of ``df``."""
    ship(df.sparkSession)
    name = _shipped(df.sparkSession, directory, vocabulary)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(SparkFiles.get(name))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bpe.count(batch.column(1).to_pylist()), pa.int64())], names=[key, out])

    return df.select(key, text).mapInArrow(run, schema)
