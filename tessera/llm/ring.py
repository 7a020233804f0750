"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual`` points on a ring of 64-bit hashes; a key belongs to the arc that ends at the next
point clockwise. A shard takes keys up to its capacity; keys that overflow a full shard go on
clockwise, round by round, to the owner of the next point. Which keys of an arc stay is decided by
their rank on the arc, so the whole movement follows from one count per arc: those counts, whose number depends on the
ring and not on the data, go to the driver, and the resulting ranges of ranks come back as a small table.

Capacities add up to ``(1 + slack)`` times the rows. With no slack every shard is filled exactly and counts differ by at
most one; with slack, adding a shard moves few keys.

Cases: a null key hashes as a value of its own; repeated rows take neighbouring ranks; an empty table gives an empty
result; clashing column names are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

CELL_BITS = 12


class Ring:
    def __init__(self, shards: int, virtual: int = 128):
        """``shards * virtual`` points, each from a digest of its shard and number."""
        if shards < 1 or virtual < 1:
            raise ValueError("a ring needs a shard and a point")
        points = sorted(
            (int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s)
            for s in range(shards)
            for v in range(virtual)
        )
        self.shards = shards
        self.points = np.array([p for p, _ in points], np.int64)
        self.owner = np.array([s for _, s in points], np.int64)

    def cells(self, spark: SparkSession) -> DataFrame:
        """For each of the equal cells of the hash space: points before it, and the points inside it."""
        edge = np.arange(1 << CELL_BITS, dtype=object) * 2 ** (64 - CELL_BITS) - 2**63
        edge = np.array([int(e) for e in edge], np.int64)
        at = np.append(np.searchsorted(self.points, edge), len(self.points))
        rows = [(k, int(at[k]), [int(p) for p in self.points[at[k] : at[k + 1]]]) for k in range(1 << CELL_BITS)]
        return spark.createDataFrame(rows, "__ring_cell int, __ring_before int, __ring_points array<bigint>")

    def arc(self, df: DataFrame, position: Column) -> DataFrame:
        """Add the position and the arc. The cells are a table of fixed size, so it is broadcast."""
        cell = (F.shiftright("__ring_position", 64 - CELL_BITS) + (1 << (CELL_BITS - 1))).cast("int")
        out = df.withColumn("__ring_position", position).withColumn("__ring_cell", cell)
        out = out.join(F.broadcast(self.cells(df.sparkSession)), "__ring_cell")
        inside = F.size(F.filter("__ring_points", lambda p: p < F.col("__ring_position")))
        return out.withColumn("__ring_arc", (F.col("__ring_before") + inside) % len(self.points)).drop("__ring_cell", "__ring_before", "__ring_points")

    def place(self, load: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``(arc, first rank, end rank, shard, first slot)`` for keys per arc and room per shard."""
        n, arcs = len(self.points), np.flatnonzero(load)
        done = np.zeros(n, np.int64)
        used = np.zeros(self.shards, np.int64)
        out = []
        for step in range(n):
            if not len(arcs):
                break
            at = self.owner[(arcs + step) % n]
            left = []
            for a, s in zip(arcs.tolist(), at.tolist(), strict=True):
                take = int(min(load[a] - done[a], capacity[s] - used[s]))
                if take > 0:
                    out.append((a, int(done[a]), int(done[a]) + take, s, int(used[s])))
                    done[a] += take
                    used[s] += take
                if done[a] < load[a]:
                    left.append(a)
            arcs = np.array(left, np.int64)
        if len(arcs):
            raise ValueError("the shards have less room than there are rows")
        return out


def capacities(rows: int, shards: int, slack: float = 0.0) -> np.ndarray:
    """Room per shard: equal, at most one apart, ``(1 + slack) * rows`` in all, rounded up."""
    total = rows + int(np.ceil(rows * slack))
    return total // shards + (np.arange(shards) < total % shards)


def assign(df: DataFrame, key: str, shards: int, *, virtual: int = 128, slack: float = 0.0, tie: tuple[str, ...] = ()) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 within a shard).

    ``tie``: columns that spread rows with equal keys over the ring as well. Two shuffles of the given columns only:
    one of counts, one that ranks the rows of an arc. Arcs are hash ranges, so no arc is hot unless
    key and tie columns are all equal.
    """
    spark, ring = df.sparkSession, Ring(shards, virtual)
    position = F.xxhash64(key, *tie)
    df = df.drop("shard", "slot")
    counts = ring.arc(df.select(key, *tie), position).groupBy("__ring_arc").count().collect()  # at most shards * virtual rows
    load = np.zeros(len(ring.points), np.int64)
    for a, n in counts:
        load[a] = n
    ranges: dict[int, list[tuple]] = {}
    for a, *r in ring.place(load, capacities(int(load.sum()), shards, slack)):
        ranges.setdefault(a, []).append(tuple(r))
    places = spark.createDataFrame(
        list(ranges.items()), "__ring_arc int, __ring_ranges array<struct<low: bigint, high: bigint, shard: int, slot: bigint>>"
    )
    # number of arcs is fixed by the ring; a range ends where a shard is full, so there are at most arcs + shards * rounds
    rank = F.row_number().over(Window.partitionBy("__ring_arc").orderBy("__ring_position", key, *tie)).cast("bigint") - 1
    ranked = ring.arc(df, position).withColumn("__ring_rank", rank).join(F.broadcast(places), "__ring_arc")
    hit = F.filter("__ring_ranges", lambda r: (F.col("__ring_rank") >= r["low"]) & (F.col("__ring_rank") < r["high"]))[0]
    out = ranked.withColumn("__ring_hit", hit)
    return out.select(*df.columns, F.col("__ring_hit.shard").alias("shard"), (F.col("__ring_hit.slot") + F.col("__ring_rank") - F.col("__ring_hit.low")).alias("slot"))


SHARDS = 40


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    out = assign(rows, "doc_id", SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
