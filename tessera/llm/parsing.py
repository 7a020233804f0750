"""Document fingerprints by locally consistent parsing.

A text is parsed bottom-up into phrases. On each level runs of one symbol become one symbol, deterministic coin tossing
(the lowest bit in which a symbol differs from its left neighbour, and that bit's value, iterated) shrinks the names to six
labels of which neighbours differ, and a phrase begins at every local maximum of the labels. Where a phrase begins depends
on a few symbols around it, so equal substrings have equal phrases inside, wherever they stand. A phrase's name is
a hash of its symbols' names.

A fingerprint is a bottom-k sketch of the phrase names of level ``LEVEL``, each with its number among equal ones, so that repeats
count (but a run of one symbol is one phrase, however long: of a text that repeats one or two characters, nothing is kept): the ``SKETCH`` smallest 32-bit hashes in
hex, ascending (all of them if there are fewer). The likeness of two is 2J / (1 + J) for the estimated share J of
phrases that both have, so a text that keeps two thirds of another's is about 0.67 like it.

Cases: a null text is empty and, like every empty text, has the empty fingerprint; two empty fingerprints have likeness 1;
repeated rows and equal ids follow each other in order of their texts' hashes; a null id comes last; a lone
document is its own next; an empty table gives an empty result; columns besides the named two are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep, map_texts, slices, table, texts

LEVEL, SKETCH = 2, 64
CHARS = 1 << 18  # parsed at once
# Odd multipliers of the SplitMix64 finaliser and its increment.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
U = np.uint64
RUN = U(int(MIX[2]) * 2 % 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX[0]
    x = (x ^ (x >> U(27))) * MIX[1]
    return x ^ (x >> U(31))


def toss(names: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """Labels below six of symbols whose neighbours differ; ``first`` marks the first symbol of each text."""
    x = names
    while True:
        left = np.empty_like(x)
        left[1:] = x[:-1]
        left[first] = ~x[first]  # a first symbol differs from nothing in its lowest bit
        d = x ^ left
        k = np.bitwise_count((d & (~d + d.dtype.type(1))) - d.dtype.type(1))
        x = (2 * k + ((x >> k.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)).astype(np.uint8)
        if bits <= 3:
            return x
        bits = (2 * bits - 1).bit_length()


def phrases(names: np.ndarray, owner: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """One level: names and owners of the phrases of symbols."""
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    run = np.diff(at, append=len(names))
    names, owner = names[at], owner[at]
    long = np.flatnonzero(run > 1)
    if len(long):
        names[long] = mix(names[long] + RUN * run[long].astype(U)) if bits > 32 else names[long]
    first = np.ones(len(names), bool)
    first[1:] = owner[1:] != owner[:-1]
    label = toss(names, first, bits) if bits > 32 else toss(names.astype(np.uint32), first, bits)
    cut = first.copy()
    if len(names) > 2:
        same = ~first[1:-1] & ~first[2:]
        cut[1:-1] |= same & (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    begin = np.flatnonzero(cut)
    place = np.arange(len(names)) - np.repeat(begin, np.diff(begin, append=len(names)))
    value = names.copy()
    if bits <= 32 and len(long):
        value[long] += RUN * run[long].astype(U)
    value = mix(value + MIX[2] * (place + 1).astype(U))
    return mix(np.add.reduceat(value, begin)), owner[begin]


def signatures(batch: list[str], level: int = LEVEL) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the texts on a level, and the text of each."""
    points = np.frombuffer("".join(batch).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(batch), dtype=np.int32), np.fromiter(map(len, batch), np.int64, len(batch)))
    if not len(points):
        return np.zeros(0, U), owner
    names, bits = points.astype(U), 21
    for _ in range(level):
        names, owner = phrases(names, owner, bits)
        bits = 64
    return names, owner


def counted(marks: np.ndarray) -> np.ndarray:
    """Owners and short names (32 bits each) in order; the second and later of equal ones get names of their own, by occurrence."""
    marks = np.sort(marks)
    fresh = np.ones(len(marks), bool)
    fresh[1:] = marks[1:] != marks[:-1]
    begin = np.flatnonzero(fresh)
    nth = np.arange(len(marks)) - np.repeat(begin, np.diff(begin, append=len(marks)))
    again = np.flatnonzero(nth)
    if len(again):
        name = marks[again] & U(0xFFFFFFFF)
        marks[again] = (marks[again] ^ name) | (mix(name | nth[again].astype(U) << U(32)) >> U(32))
    return np.unique(marks)


def sketches(batch: list[str]) -> list[np.ndarray]:
    """Bottom-k sketches of the texts."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(batch):
        part, size = [], 0
        while k < len(batch) and (size < CHARS or not part):
            part.append(batch[k])
            size += len(batch[k])
            k += 1
        names, owner = signatures(part)
        both = counted((owner.astype(U) << U(32)) | (names >> U(32)))
        ends = np.searchsorted(both, np.arange(1, len(part) + 1, dtype=U) << U(32))
        low, begin = both.astype(np.uint32), 0
        for end in ends.tolist():
            out.append(low[begin : min(end, begin + SKETCH)])
            begin = end
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sketches, from 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)
    if len(a) == SKETCH or len(b) == SKETCH:  # beyond the end of a full sketch nothing is known
        union = union[:SKETCH]
    both = np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)
    j = float(both.mean())
    return 2 * j / (1 + j)


def as_bytes(sketch: np.ndarray) -> bytes:
    return sketch.astype(">u4").tobytes()


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as many first characters of ``following``, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


ROWS = (
    "part int, role string, doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double, text string"
)
NAMES = [c.split()[0] for c in ROWS.split(", ")]


def _finished(part: int, ids: list, own: list[str], after: list[str], marks: list | None = None) -> pa.RecordBatch:
    """Complete rows of texts and the texts after them."""
    marks = marks or sketches(own + after[-1:])
    changed = [edited(a, b) for a, b in zip(own, after, strict=True)]
    other = sketches(changed)
    values = [
        pa.array([part] * len(ids), pa.int32()), pa.array(["row"] * len(ids)), pa.array(ids, pa.int64()), pa.array(map(len, own), pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(map(as_bytes, marks[: len(ids)]), pa.binary()),
        pa.array(map(as_bytes, other), pa.binary()), pa.array([likeness(a, b) for a, b in zip(marks, other, strict=False)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(marks[:-1], marks[1:], strict=True)], pa.float64()), pa.nulls(len(ids), pa.string()),
    ]
    return pa.RecordBatch.from_arrays(values, NAMES)


def _border(part: int, role: str, doc_id: int | None, text: str) -> pa.RecordBatch:
    """A text at the border of a range, whose neighbour is in another range."""
    values = {"part": part, "role": role, "doc_id": doc_id, "text": text}
    return pa.RecordBatch.from_pylist([{n: values.get(n) for n in NAMES}], _schema())


def _schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ROWS.split(", ")])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, held = TaskContext.get().partitionId(), None
    for batch in slices(batches, 1, 2 << 20):
        ids, own = batch.column(0).to_pylist(), texts(batch.column(1))
        if not ids:
            continue
        if held is None:
            yield _border(part, "head", ids[0], own[0])
        else:
            ids, own = [held[0], *ids], [held[1], *own]
        if len(ids) > 1:
            yield _finished(part, ids[:-1], own[:-1], own[1:])
        held = ids[-1], own[-1]
    if held is not None:
        yield _border(part, "tail", *held)


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        for doc_id, own, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield _finished(0, [doc_id], [own], [after])


def compare_with_next(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness and that to the next document's.

    Texts are range-partitioned once, by descending id; a range finishes all rows but its last one, whose next is the
    first of the range after. Those two rows per range meet in a small join.
    """
    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.desc_nulls_last("doc_id"), tie).sortWithinPartitions(F.desc_nulls_last("doc_id"), tie, "text")
    found = keep(map_texts(ordered, _ranges, ROWS), "fingerprints")
    in_hex = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    out = ["doc_id", "n_chars", "edited_sha256", *in_hex, "near_edited", "near_next"]
    done = found.filter("role = 'row'").select(*out)
    filled = sorted(r[0] for r in found.filter("role = 'head'").select("part").collect())  # numbers of ranges
    if not filled:
        return done
    pairs = docs.sparkSession.createDataFrame(list(zip(filled, filled[1:] + filled[:1], strict=True)), "part int, next int")
    tail = found.filter("role = 'tail'").select("part", "doc_id", "text")
    head = found.filter("role = 'head'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    last = tail.join(pairs, "part").join(head, "next").select("doc_id", "text", "after").mapInArrow(_tails, ROWS)
    return done.unionByName(last.select(*out))


def query(spark, sf_dir):
    return compare_with_next(table(spark, sf_dir, "documents"))
