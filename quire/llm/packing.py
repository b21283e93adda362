"""Problem 9: documents into containers of fixed capacity by pattern packing.

The lengths are first reduced to a histogram, whose size is bounded by the capacity.  On it, patterns of a few
documents that fill a container exactly are enumerated; non-negative least squares fits how often each is
used; the counts are rounded to what the histogram holds, and what is left is fitted again until that places
next to nothing.  The residual histogram is packed greedily, a whole multiple of each filling at a time.
Where the greedy rule alone needs fewer containers, as it may for some thousands of documents, it is
used instead.  The plan is a table of runs: the documents of one length, in the order of their ids, from one
ordinal to another, go to containers that start at one number and ascend by one.  Documents get their ordinal
by two-level counting in sub-groups of bounded size, so neither a length that a third of the
documents share nor the corpus is ever gathered in one task.

A document above the capacity is cut into full containers and a rest, and only such documents are cut.
Defined results: a document without tokens (null, empty) takes no space and has container 0, piece 0.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.runtime import ship

#: Patterns enumerated for a fit, most lengths in one, rounds of fitting, sweeps of a fit, deviations from an even
#: share that are tried for each length, and the share of containers that a round must add.
PATTERNS, MOST_ITEMS, ROUNDS, SWEEPS, TRIES, LEAST_GAIN = 4000, 12, 6, 12, 12, 0.002
#: Rows that one task may number.
ROWS_A_TASK = 500_000


def enumerate_patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int, items: int, most: int = PATTERNS) -> list[tuple[int, ...]]:
    """Multisets of up to ``items`` lengths that fill a container exactly: every length as the first, alone or beside
    lengths of an even choice, and the rest closed by lengths near an even share of it."""
    present = np.zeros(capacity + 1, dtype=bool)
    present[sizes] = True
    there = present.tolist()
    per_length = max(6, most // len(sizes))
    even = sizes[np.unique(np.linspace(0, len(sizes) - 1, num=min(len(sizes), 4 * per_length)).astype(int))]
    heavy = sizes[np.argsort(-counts, kind="stable")[:per_length]]
    seconds = np.unique(np.concatenate((even, heavy))).tolist()

    def closed(head: tuple[int, ...], rest: int, left: int) -> tuple[int, ...] | None:
        if left == 1:
            return (*head, rest) if there[rest] else None
        share = rest // left
        for off in range(min(share, TRIES)):
            for size in (share - off, share + off) if off else (share,):
                if 0 < size < rest and there[size] and (found := closed((*head, size), rest - size, left - 1)):
                    return found
        return None

    found: dict[tuple[int, ...], None] = {}
    for a in sizes.tolist():
        own = [(a,)] if a == capacity else [p for left in range(1, items) if (p := closed((a,), capacity - a, left))]
        fitting = [b for b in seconds if a + b < capacity]
        step = max(1, len(fitting) // per_length)
        for b in fitting[a % step :: step]:
            own += [p] if (p := next(filter(None, (closed((a, b), capacity - a - b, left) for left in range(1, items - 1))), None)) else []
        found |= dict.fromkeys(tuple(sorted(p, reverse=True)) for p in own)
    return sorted(found, key=lambda p: (-p[0], len(p), p))


def fit(patterns: list[tuple[int, ...]], histogram: dict[int, int], capacity: int, sweeps: int = SWEEPS) -> list[float]:
    """Non-negative least squares of the pattern counts to the histogram, weighted by length: coordinate descent from
    zero, which leaves most patterns unused."""
    weight = {s: (s / capacity) ** 2 for s in histogram}
    short = {s: float(n) for s, n in histogram.items()}
    columns = []
    for p in patterns:
        times = Counter(p)
        columns.append(([(s, m, m * weight[s]) for s, m in times.items()], sum(m * m * weight[s] for s, m in times.items())))
    x = [0.0] * len(patterns)
    for _ in range(sweeps):
        for j, (column, norm) in enumerate(columns):
            gain = 0.0
            for s, _, w in column:
                gain += short[s] * w
            new = max(0.0, x[j] + gain / norm)
            step = new - x[j]
            if abs(step) > 1e-9:
                for s, m, _ in column:
                    short[s] -= m * step
                x[j] = new
    return x


def _filled(first: int, left: dict[int, int], capacity: int) -> tuple[int, ...]:
    """A container that begins with a length and takes the largest lengths left that fit."""
    pattern, rest = [first], capacity - first
    order = sorted(left, reverse=True)
    i = bisect_left(order, -rest, key=lambda x: -x)
    while i < len(order):
        s = order[i]
        n = min(rest // s, left[s] - pattern.count(s))
        if n > 0:
            pattern += [s] * n
            rest -= n * s
        i = max(i + 1, bisect_left(order, -rest, key=lambda x: -x))
    return tuple(pattern)


class _Plan:
    """Runs of a growing plan, and what the histogram still holds."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.left, self.capacity = dict(histogram), capacity
        self.runs: list[tuple[int, int, int, int]] = []
        self.given: defaultdict[int, int] = defaultdict(int)
        self.containers = self.by_fit = 0

    def use(self, pattern: tuple[int, ...], most: int | None = None) -> int:
        """Containers filled by the pattern, as often as the histogram allows, ``most`` times at most."""
        each = Counter(pattern)
        times = min(self.left.get(s, 0) // m for s, m in each.items())
        times = times if most is None else min(times, most)
        if times <= 0:
            return 0
        for s, m in each.items():
            for _ in range(m):
                self.runs.append((s, self.given[s], self.given[s] + times - 1, self.containers))
                self.given[s] += times
            self.left[s] -= m * times
            if not self.left[s]:
                del self.left[s]
        self.containers += times
        return times

    def fitted(self) -> _Plan:
        total, n = sum(s * c for s, c in self.left.items()), sum(self.left.values())
        items = int(min(MOST_ITEMS, max(4, 2 + self.capacity * n / max(1, total))))
        for nth in range(ROUNDS):
            if not self.left:
                break
            sizes = np.array(sorted(self.left), dtype=np.int64)
            patterns = enumerate_patterns(sizes, np.array([self.left[s] for s in sizes.tolist()]), self.capacity, items)
            wanted = fit(patterns, self.left, self.capacity)
            # rounded down while every length is plentiful, to the nearest for what is left
            order = sorted(range(len(patterns)), key=lambda j: (-patterns[j][0], -wanted[j]))
            added = sum(self.use(patterns[j], math.floor(wanted[j] + (0.5 if nth else 0.0))) for j in order)
            self.by_fit += added
            if added <= LEAST_GAIN * self.by_fit and nth:
                break
        return self

    def filled(self) -> _Plan:
        """The rest: the largest length first, with the largest lengths that still fit."""
        while self.left:
            self.use(_filled(max(self.left), self.left, self.capacity))
        return self


def plan(histogram: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """Runs (size, first ordinal, last ordinal, container of the first) for lengths 1..capacity."""
    left = {int(s): int(n) for s, n in histogram if 0 < s <= capacity and n > 0}
    fitted, greedy = _Plan(left, capacity).fitted().filled(), _Plan(left, capacity).filled()
    return (fitted if fitted.containers <= greedy.containers else greedy).runs


def with_ordinal(df: DataFrame, group: str, order: str, salts: dict[int, int]) -> DataFrame:
    """``ordinal`` from 0 within each group, by sub-groups and their running sums; ``salts`` holds the number of
    sub-groups of the groups that need more than one."""
    number = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for pair in salts.items() for v in pair)), F.col(group)), F.lit(1)) if salts else F.lit(1)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(order), number).cast("int"))
    before = Window.partitionBy(group).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    start = salted.groupBy(group, "__salt").count().withColumn("__start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inner = F.row_number().over(Window.partitionBy(group, "__salt").orderBy(order)) - 1
    return salted.withColumn("__inner", inner).join(start, [group, "__salt"]).withColumn("ordinal", F.col("__start") + F.col("__inner")).drop("__salt", "__start", "__inner")


def _placed(rests: DataFrame, key: str, runs: list[tuple[int, int, int, int]]) -> DataFrame:
    """(key, piece, piece_size, container) of the rows of ``rests``, whose run is found by binary search.

    The plan is broadcast: its runs are bounded by the patterns of all rounds and the distinct lengths, whatever
    the number of documents."""
    spark = rests.sparkSession
    ship(spark)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((table[:, 0], table[:, 1], table[:, 3]))
    schema = T.StructType([rests.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("piece_size", T.LongType()), T.StructField("container", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, firsts, bases = shared.value
        # the runs of a length follow each other, ordered by their first ordinals
        begins, ends = np.searchsorted(sizes, np.arange(sizes[-1] + 2)), len(sizes)
        for batch in batches:
            size, ordinal = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 3))
            low, high = begins[size].copy(), begins[size + 1].copy()
            while (high - low > 1).any():
                middle = (low + high) // 2
                right = firsts[np.minimum(middle, ends - 1)] <= ordinal
                right &= high - low > 1
                low, high = np.where(right, middle, low), np.where(right | (high - low <= 1), high, middle)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size), pa.array(bases[low] + ordinal - firsts[low])], names=schema.names)

    return rests.select(key, "__rest", F.col("__full").cast("int"), "ordinal").mapInArrow(run, schema)


def pack(df: DataFrame, key: str, size: str, capacity: int, *, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """(key, piece, piece_size, container) of every row of ``df``, whose ``key`` is unique."""
    items = df.select(key, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__n"))
    full = F.when(F.col("__n") > capacity, F.floor(F.col("__n") / capacity).cast("long")).otherwise(F.lit(0).cast("long"))
    items = items.withColumn("__full", full).withColumn("__rest", F.col("__n") - F.col("__full") * capacity)
    # at most ``capacity`` + 1 rows
    counted = items.groupBy("__rest").agg(F.count("*").alias("n"), F.count_if(F.col("__full") > 0).alias("big")).collect()
    histogram = {r["__rest"]: r["n"] for r in counted}
    runs = plan(list(histogram.items()), capacity)
    used = max((c + b - a + 1 for _, a, b, c in runs), default=0)
    none = items.where("__n = 0").select(key, F.lit(0).alias("piece"), F.lit(0).cast("long").alias("piece_size"), F.lit(0).cast("long").alias("container"))
    # full containers: numbered after the others, by running sums over sub-groups
    salts = max(1, -(-sum(r["big"] for r in counted) // rows_a_task))
    big = items.where("__full > 0").withColumn("__one", F.lit(1)).withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    sums = big.groupBy("__one", "__salt").agg(F.sum("__full").alias("__sum")).withColumn("__start", F.coalesce(F.sum("__sum").over(Window.partitionBy("__one").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__salt", "__start")
    inside = F.coalesce(F.sum("__full").over(Window.partitionBy("__salt").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = big.withColumn("__inside", inside).join(sums, "__salt").withColumn("piece", F.explode(F.sequence(F.lit(0), (F.col("__full") - 1).cast("int"))))
    whole = whole.select(key, "piece", F.lit(capacity).cast("long").alias("piece_size"), (F.lit(used) + F.col("__start") + F.col("__inside") + F.col("piece")).cast("long").alias("container"))
    if not runs:
        return whole.unionByName(none)
    hot = {s: -(-n // rows_a_task) for s, n in histogram.items() if n > rows_a_task}
    rests = with_ordinal(items.where("__rest > 0").select(key, "__rest", "__full"), "__rest", key, hot)
    return _placed(rests, key, runs).unionByName(whole).unionByName(none)
