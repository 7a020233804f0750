"""Best-fit packing with large-item matching.

Texts become ids, texts beyond the capacity are cut into full pieces and a rest, and pieces are packed by length alone.
A sequence holds at most two pieces above a third of its capacity, so those are matched greedily: the longest with
the longest partner that fits. Smaller pieces, longest first, go into the tightest gap that holds them, and into
a new sequence only where none does.

All of that needs one number per length, so the plan is made from a histogram of at most ``capacity`` lengths in bulk
steps, whatever the number of documents; pieces then find their place by their rank among pieces of their length.
Every task numbers its own pieces of each length while it writes them; what other tasks have of a length before it is added from
a table of counts per task and length, so no frequent length is gathered anywhere.

Cases: a null text is empty and has the end id alone; repeated rows are packed like any others; an empty table gives
an empty result; further columns of ``docs`` don't matter, only the named ones are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop_kept, keep, map_texts, slices, table, texts
from tessera.llm.tokens import tokenizer_path, with_end, word_cache

MOST_COUNTS = 500_000  # counts of 16 bytes that are broadcast at most
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


class Plan:
    """Places for pieces: per length, ranges of ranks with their first sequence, pieces per sequence, and offset."""

    def __init__(self, counts: np.ndarray, capacity: int):
        """``counts[n]``: pieces of length n, for n up to ``capacity``."""
        self.capacity, self.sequences = capacity, 0
        self.places: dict[int, list[tuple[int, int, int, int, int]]] = {}
        self._rank = np.zeros(capacity + 1, np.int64)
        self._gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens: ranges of sequences
        self._sizes: list[int] = []
        left = counts.astype(np.int64).copy()
        third = capacity // 3
        for a in range(capacity, third, -1):
            while left[a]:
                b = min(a, capacity - a)
                while b > third and not left[b]:
                    b -= 1
                if b <= third:
                    first = self._open(left[a])
                    self._put(a, left[a], first, 1, 0)
                    self._gap(capacity - a, first, left[a])
                    left[a] = 0
                    continue
                n = left[a] // 2 if a == b else min(left[a], left[b])
                if not n:  # one of a length that would pair with itself
                    left_over = b - 1
                    while left_over > third and not left[left_over]:
                        left_over -= 1
                    first = self._open(1)
                    self._put(a, 1, first, 1, 0)
                    used = a
                    if left_over > third:
                        self._put(left_over, 1, first, 1, a)
                        left[left_over] -= 1
                        used += left_over
                    self._gap(capacity - used, first, 1)
                    left[a] -= 1
                    continue
                first = self._open(n)
                self._put(a, n, first, 1, 0)
                self._put(b, n, first, 1, a)
                self._gap(capacity - a - b, first, n)
                left[a] -= n
                left[b] -= n
        for s in range(third, 0, -1):
            while left[s]:
                k = bisect_left(self._sizes, s)
                if k == len(self._sizes):
                    each = capacity // s
                    first = self._open(-(-left[s] // each))
                    self._gap(capacity, first, -(-left[s] // each))
                    continue
                gap = self._sizes[k]
                first, n = self._take(gap)
                each = min(gap // s, left[s])
                full = min(n, left[s] // each)
                self._put(s, full * each, first, each, capacity - gap)
                self._gap(gap - each * s, first, full)
                if full < n:
                    self._gap(gap, first + full, n - full)
                left[s] -= full * each

    def _open(self, n: int) -> int:
        self.sequences += int(n)
        return self.sequences - int(n)

    def _gap(self, size: int, first: int, n: int) -> None:
        if size > 0 and n > 0:
            if size not in self._gaps:
                self._gaps[size] = []
                insort(self._sizes, size)
            self._gaps[size].append((first, int(n)))

    def _take(self, size: int) -> tuple[int, int]:
        out = self._gaps[size].pop()
        if not self._gaps[size]:
            del self._gaps[size]
            self._sizes.remove(size)
        return out

    def _put(self, length: int, n: int, first: int, each: int, offset: int) -> None:
        rank = int(self._rank[length])
        self.places.setdefault(int(length), []).append((rank, rank + int(n), int(first), int(each), int(offset)))
        self._rank[length] += n


def cut(docs: DataFrame, path: str, capacity: int, end: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a text's ids, with the ids' CRC, the task, and the piece's number among the task's of its length.

    A lost task that runs again gives the same rows if its input comes in the same order, as that of files does; the table is kept,
    so numbers are never taken from two runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, cache = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), word_cache(path)
        for batch in slices(batches, 1):
            flat, counts = with_end(*cache.encode(texts(batch.column(1))), end)
            pieces = -(-counts // capacity)
            owner = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(counts[owner] - start, capacity)
            at = (np.cumsum(counts) - counts)[owner] + start
            raw = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            run = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else order
            size = np.diff(run, append=len(ranked))
            nth = np.empty(len(owner), np.int64)
            nth[order] = np.arange(len(owner)) - np.repeat(run, size) + seen[ranked]
            seen[ranked[run]] += size
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array(crc, pa.int64()), pa.array(np.full(len(owner), part, np.int32)), pa.array(nth),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return map_texts(docs.select(F.col(doc).cast("bigint"), text), run, PIECES)


def pack(docs: DataFrame, *, path: str, capacity: int = 2048, end: int = 0, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all texts with ``sequence_id`` and ``offset``; sequences hold at most ``capacity`` ids, without gaps."""
    spark = docs.sparkSession
    pieces = keep(cut(docs, path, capacity, end, doc, text), "pieces")
    # the number of the last piece tells how many a task has; a row for each task and length
    tally = keep(pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n")), "tally")
    n_tally, counts = tally.count(), np.zeros(capacity + 1, np.int64)
    for n, rows in tally.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[n] = rows
    plan = Plan(counts, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = keep(tally.select("part", "length", F.coalesce(before, F.lit(0)).alias("_base")), "base")  # a row per task in a window
    drop_kept(tally)
    spot = "array<struct<low: bigint, high: bigint, first: bigint, each: bigint, offset: bigint>>"
    # entries depend on the lengths that occur, not on the number of pieces; some 2,300 for 2,048 lengths
    n_places = sum(map(len, plan.places.values()))
    places = spark.createDataFrame(list(plan.places.items()), f"length bigint, _places {spot}")
    small = lambda df, n: F.broadcast(df) if n <= MOST_COUNTS else df
    ranked = pieces.join(small(base, n_tally), ["part", "length"]).join(small(places, n_places), "length")
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("nth"))
    hit = F.filter("_places", lambda p: (F.col("_rank") >= p["low"]) & (F.col("_rank") < p["high"]))[0]
    out = ranked.withColumn("_at", hit).withColumn("_k", F.col("_rank") - F.col("_at.low"))
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("_at.first + _k div _at.each").alias("sequence_id"),
        F.expr("_at.offset + (_k % _at.each) * length").alias("offset"),
    )


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), path=tokenizer_path("word_bpe_49k.json"))
