"""SimHash near-duplicates, joined by Golay-code fuzzy hashing.

A fingerprint is the bitwise majority of the XXH64 of a text's 3-word shingles. Fingerprints that differ in at most
three bits are linked, and linked ones form components.

Candidates: three wrong bits leave one of the four 16-bit quarters right, and of the other 48 bits two
disjoint 23-bit segments hold at most three errors, so one of the two has at most one. The binary Golay code is perfect:
a segment is within three bits of one codeword; segments at distance three also get the five codewords at
distance four. Segments that differ in one bit (even two) then share a codeword, so every linked pair meets in one
of eight tables under the key (exact quarter, codeword).

Equal fingerprints are one row from the start. In a table, rows of a key meet in one sorted run, which is
resolved to star-shaped links of its components, never to all pairs; a key of more than ``BLOCK`` fingerprints is split
into pairs of blocks, each a run of its own. Components of the links come from alternating large and small stars.

Cases: a null text has no words and, like every text without words, fingerprint zero; texts of fewer than three words
have one shingle; repeated rows and repeated ids get their component each; a null id is the smallest only where its
component has no other, and then the component's id is null; an empty table gives an empty result; columns
besides the named two are carried by :func:`near_dedup` and ignored by :func:`components`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_kept, fresh_name, keep, map_texts, scratch, slices, table, texts

SHINGLE, SEED, MOST = 3, 42, 3
BLOCK = 4096
SMALL = 16

# The generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY, DATA_BITS, CODE_BITS = 0b110001110101, 12, 23


def fingerprint(text: str) -> int:
    """64 bits, each the majority of the shingles' hashes; zero without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - SHINGLE + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[SHINGLE - 1 :].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64, n)
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        fp = np.array([fingerprint(t) for t in texts(batch.column(2))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "text_hash", "fp"])


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of single bits modulo the generator, and for each remainder the error of at most three bits."""
    bit = np.zeros(CODE_BITS, np.int64)
    for k in range(CODE_BITS):
        r = 1 << k
        for top in range(k, DATA_BITS - 2, -1):
            if r >> top & 1:
                r ^= GOLAY << (top - (CODE_BITS - DATA_BITS))
        bit[k] = r
    error = np.zeros(1 << (CODE_BITS - DATA_BITS), np.int64)
    for a in range(CODE_BITS):
        error[bit[a]] = 1 << a
        for b in range(a):
            error[bit[a] ^ bit[b]] = 1 << a | 1 << b
            for c in range(b):
                error[bit[a] ^ bit[b] ^ bit[c]] = 1 << a | 1 << b | 1 << c
    return bit, error


class Golay:
    """Codeword indices (the 12 data bits) of 23-bit segments."""

    def __init__(self) -> None:
        bit, self.error = _syndromes()
        byte = np.arange(256)
        self.parts = [
            np.bitwise_xor.reduce([np.where(byte >> k & 1, bit[8 * part + k], 0) for k in range(8) if 8 * part + k < CODE_BITS], axis=0)
            for part in range(3)
        ]
        # a remainder with a three-bit error: one bit more leads to five other codewords
        self.others = np.full((len(self.error), 5), -1, np.int64)
        for s in np.flatnonzero(np.bitwise_count(self.error) == 3):
            around = {int(self.error[s ^ bit[k]] ^ (1 << k)) for k in range(CODE_BITS)} - {int(self.error[s])}
            self.others[s] = sorted(e for e in around if bin(e).count("1") == 4)

    def indices(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and codeword indices: one for each segment, five more where the nearest codeword is three bits away."""
        s = self.parts[0][segments & 255] ^ self.parts[1][segments >> 8 & 255] ^ self.parts[2][segments >> 16]
        row = np.arange(len(segments))
        more = np.flatnonzero(self.others[s, 0] >= 0)
        near = segments ^ self.error[s]
        far = segments[more][:, None] ^ self.others[s[more]]
        return np.concatenate([row, np.repeat(more, 5)]), np.concatenate([near, far.ravel()]) >> (CODE_BITS - DATA_BITS)


def table_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (as ``uint64``) in the eight tables, and the row of each."""
    golay, rows, keys = Golay(), [], []
    for quarter in range(4):
        exact = (fps >> np.uint64(16 * quarter) & np.uint64(0xFFFF)).astype(np.int64)
        rest = np.zeros(len(fps), np.int64)
        for k, other in enumerate(q for q in range(4) if q != quarter):
            rest |= (fps >> np.uint64(16 * other) & np.uint64(0xFFFF)).astype(np.int64) << (16 * k)
        for half in range(2):
            row, index = golay.indices(rest >> (24 * half) & (1 << CODE_BITS) - 1)
            rows.append(row)
            keys.append((2 * quarter + half) << 28 | exact[row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        rows, keys = table_keys(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["key", "fp"])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ. Of a signed number, numpy would count the bits of its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def stars(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links from the smallest fingerprint of each component to its others."""
    left, out = np.unique(fps), []
    while len(left):
        members, front, left = [left[:1]], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for k in range(0, len(front), 256):
                near |= (apart(front[k : k + 256, None], left) <= MOST).any(axis=0)
            front, left = left[near], left[~near]
            members.append(front)
        found = np.concatenate(members)
        out += [(int(found.min()), int(x)) for x in found if x != found.min()]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of runs of equal (key, pair of blocks) in sorted input; a run may go on in the next batch."""
    empty = np.zeros(0, np.int64)
    keys, pairs, fps = empty, empty, empty

    def resolve(cut: int) -> pa.RecordBatch:
        border = np.flatnonzero((keys[1:cut] != keys[: cut - 1]) | (pairs[1:cut] != pairs[: cut - 1])) + 1
        begin, end = np.append(0, border), np.append(border, cut)
        size, out_a, out_b = end - begin, [], []
        small = np.repeat(size <= SMALL, size)
        run = np.repeat(np.arange(len(size)), size)
        for d in range(1, SMALL):  # within short runs, at most SMALL - 1 partners each
            i = np.flatnonzero(small[: cut - d] & (run[d:] == run[: cut - d])) if cut > d else empty
            if not len(i):
                break
            i = i[apart(fps[i], fps[i + d]) <= MOST]
            out_a.append(np.minimum(fps[i], fps[i + d]))
            out_b.append(np.maximum(fps[i], fps[i + d]))
        for k in np.flatnonzero(size > SMALL):
            found = stars(fps[begin[k] : end[k]])
            if found:
                a, b = np.array(found, np.int64).T
                out_a.append(a)
                out_b.append(b)
        a, b = (np.concatenate([*x, empty]) for x in (out_a, out_b))
        both = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    for batch in batches:
        keys, pairs, fps = (
            np.concatenate([x, y.to_numpy(zero_copy_only=False)]) for x, y in zip((keys, pairs, fps), batch.columns, strict=True)
        )
        if not len(keys):
            continue
        last = np.flatnonzero((keys != keys[-1]) | (pairs != pairs[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield resolve(cut)
            keys, pairs, fps = keys[cut:], pairs[cut:], fps[cut:]
    if len(keys):
        yield resolve(len(keys))


MOST_BROADCAST = 100_000


def links(classes: DataFrame) -> DataFrame:
    """Links ``(a, b)``, a < b, that connect the distinct fingerprints of ``classes`` as all linked pairs would: a kept table."""
    rows = classes.select("fp").mapInArrow(_keys, "key bigint, fp bigint")
    heavy = keep(rows.groupBy("key").count().filter(F.col("count") > BLOCK), "heavy")
    few = heavy.count() <= MOST_BROADCAST
    blocks = F.coalesce(F.ceil(F.col("count") / F.lit(BLOCK)).cast("int"), F.lit(1))
    rows = rows.join(F.broadcast(heavy) if few else heavy, "key", "left").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a row of block b is in the runs of all pairs of blocks with b
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, own).cast("bigint") * F.col("blocks") + F.greatest(o, own))
    rows = rows.select("key", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(pair)).alias("pair"), "fp")
    found = rows.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_links, "a bigint, b bigint").distinct()
    out = keep(found, "edges")
    drop_kept(heavy)
    return out


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """A large or small star step over ``(a, b)`` with a < b; the smallest neighbour of each node becomes its neighbours' link."""
    up, down = edges.select(F.col("a").alias("u"), F.col("b").alias("v")), edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    around = up.unionByName(down) if large else down
    least = keep(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    if large:
        out = up.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        out = out.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    out = keep(out.filter(F.col("a") != F.col("b")).distinct(), "edges")
    drop_kept(least)
    return out


def roots(edges: DataFrame) -> DataFrame:
    """``(a, b)`` = (root, node) for every node with a link but the root, the smallest node of its component.

    ``edges`` is a kept table, which is freed, and so is the result.
    """
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges
        before, wide = state, _star(edges, True)
        drop_kept(edges)
        edges = _star(wide, False)
        drop_kept(wide)


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp`` (the fingerprint's bits as a bigint) of every row, as a kept table."""
    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return keep(map_texts(rows, _fingerprints, "doc_id bigint, text_hash bigint, fp bigint"), "fingerprints")


def components(marks: DataFrame) -> DataFrame:
    """Add ``root``, the smallest fingerprint (as a bigint) of a row's component, and ``component_id`` to rows with ``doc_id`` and ``fp``."""
    classes = keep(marks.groupBy("fp").agg(F.min("doc_id").alias("lead")), "classes")
    edges = roots(links(classes))
    node = edges.select(F.col("a").alias("root"), F.col("b").alias("fp"))
    placed = classes.join(node, "fp", "left").select("fp", "lead", F.coalesce("root", "fp").alias("root"))
    first = placed.groupBy("root").agg(F.min("lead").alias("component_id"))
    named = keep(placed.join(first, "root").select("fp", "root", "component_id"), "components")
    drop_kept(classes)
    drop_kept(edges)
    return marks.join(named, "fp")


MOST_GONE = 500_000  # rows of 16 bytes that are broadcast at most


def near_dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id, with the columns of ``docs``.

    Ids and hashes of the rows that go are the small side, so texts aren't shuffled while at most ``MOST_GONE`` go. Rows
    equal in id and text that lead a component are merged into one; an id that leads with several texts keeps the one of the
    smallest hash. One pass more over ``docs`` is made only where such equal rows exist.
    """
    with scratch() as made:
        placed = keep(components(fingerprints(docs, doc, text)).select("doc_id", "text_hash", "component_id", "root"), "placed")
        lead = F.col("doc_id").eqNullSafe(F.col("component_id"))
        rows = placed.groupBy("doc_id", "text_hash", "root").agg(F.count(F.lit(1)).alias("n"), F.first(lead).alias("lead"))
        # the id that leads a component may come with several texts of it; few rows lead, so no component is a hot key
        leads = rows.filter("lead")
        first = leads.groupBy("root").agg(F.min("text_hash").alias("first_hash"))
        leads = leads.join(first, "root").withColumn("stays", F.col("first_hash") == F.col("text_hash"))
        marked = leads.filter("not stays or n > 1").select("doc_id", "text_hash", "stays")
        marked = marked.unionByName(rows.filter("not lead").select("doc_id", "text_hash", F.lit(False).alias("stays")))
        id_name, hash_name = fresh_name(docs, "__id"), fresh_name(docs, "__hash")
        key = [F.col("doc_id").alias(id_name), F.col("text_hash").alias(hash_name)]
        gone = keep(marked.select(*key, "stays"), "gone")
        n_gone, n_equal = gone.agg(F.count(F.lit(1)), F.count_if("stays")).first()
        made.remove(gone)
    on = F.col(doc).cast("bigint").eqNullSafe(F.col(id_name)) & (F.xxhash64(text) == F.col(hash_name))
    small = F.broadcast if n_gone <= MOST_GONE else lambda df: df
    out = docs.join(small(gone.select(id_name, hash_name)), on, "left_anti")
    if n_equal:
        equal = docs.join(small(gone.filter("stays").select(id_name, hash_name)), on)
        whole = fresh_name(docs, "__row")
        one = equal.groupBy(id_name, hash_name).agg(F.first(F.struct(*docs.columns)).alias(whole))
        out = out.unionByName(one.select(*[F.col(whole)[c].alias(c) for c in docs.columns]))
    return out


def query(spark, sf_dir):
    placed = components(fingerprints(table(spark, sf_dir, "documents")))
    return placed.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
