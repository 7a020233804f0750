"""Benchmark decontamination with suffix arrays.

Every Arrow batch of documents, in parts of ``SHARD`` bytes of text, is a shard. Its words become numbers of the benchmark's vocabulary (0 for any
other word, and between documents), and the shard's suffix array holds the positions at which a window
could begin, sorted by their next ``window`` words and then by the word before them: a suffix that meets a foreign word sooner can't
match and stays out. Every suffix of every test item is then binary-searched. What goes on to the left is part of a longer match
found there, so of a range only the suffixes with another word before them are taken, which are two ranges again; they
are extended to the right, word by word, to the longest verbatim match. Pairs that are no longest match are never listed.

The benchmark goes to the executors in blocks of at most ``block_bytes`` of text. One block is the usual case;
a larger benchmark takes one pass over the documents per block, so nothing that is broadcast outgrows the bound.

Cases: a null text has no words; empty texts neither; a null ``item_id`` counts as ``""``; items without words
match nothing; repeated items with one id count once; repeated document rows are judged row by row; an empty
table gives an empty result; a column named like the result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh_name, list_array, map_texts, ragged, replace_column, slices, table

#: Bytes to bytes: ASCII capitals fall, digits and letters stay, other ASCII separates, the rest of UTF-8 stays.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)

SHARD = 4 << 20

MATCHES = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.StringType()),
            T.StructField("item_word", T.IntegerType()),
            T.StructField("doc_word", T.IntegerType()),
            T.StructField("n_words", T.IntegerType()),
        ]
    )
)
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("matches", MATCHES),
    ]
)
ARROW_MATCH = pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes, ASCII letters in lower case."""
    return text.encode().translate(WORD_BYTES).split() if text else []


class Tests:
    """One block of the benchmark: numbered words, and the suffixes to search for, as sortable keys."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window, self.vocab, self.ids = window, {}, []
        flat, starts, lengths, owner = [], [], [], []
        for item_id, text in items:
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in words(text)]
            if not w:
                continue
            n = min(window, len(w))
            first = len(flat) + 1
            flat += [0, *w]
            for k in range(len(w) - n + 1):
                starts.append(first + k)
                lengths.append(n)
                owner.append(len(self.ids))
            self.ids.append((item_id, first))
        self.flat = np.array([*flat, *[0] * (window + 1)], np.int32)
        self.starts, self.lengths, self.owner = (np.array(x, np.int64) for x in (starts, lengths, owner))
        self.shortest = int(self.lengths.min()) if len(starts) else 0
        self.bits = max(1, len(self.vocab).bit_length())
        if len(starts):
            heads = self.flat[self.starts[:, None] + np.arange(window)]
            inside, most = np.arange(window) < self.lengths[:, None], (1 << self.bits) - 1
            left = self.flat[self.starts - 1]
            key = lambda fill, last: self.keys(np.column_stack([np.where(inside, heads, fill), np.broadcast_to(last, len(heads))]))
            self.low, self.high = key(0, 0), key(most, most)
            # an item's beginning and a whole short item have nothing to their left: the ranges to leave out are empty
            open_ = (left == 0) | (self.lengths < window)
            self.same = np.where(open_, self.high, key(0, left))
            self.open = open_

    def keys(self, heads: np.ndarray) -> np.ndarray:
        """Rows of word numbers as byte strings that sort like the rows."""
        per, n = 63 // self.bits, heads.shape[1]
        packed = np.zeros((len(heads), -(-n // per)), np.uint64)
        for k in range(n):
            packed[:, k // per] |= heads[:, k].astype(np.uint64) << np.uint64(self.bits * (per - 1 - k % per))
        return np.ascontiguousarray(packed.astype(">u8")).view(f"V{8 * packed.shape[1]}").ravel().view(f"S{8 * packed.shape[1]}")

    def search(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Longest matches in a shard's word numbers, which end with ``window`` zeros: positions in
        the shard and in ``flat``, lengths, and item numbers.
        """
        none = np.zeros(0, np.int64)
        if not self.shortest or len(docs) <= self.window:
            return none, none, none, none
        stop = np.flatnonzero(docs == 0)
        room = np.diff(stop, prepend=-1) - 1  # known words before each zero
        runs = np.flatnonzero(room >= self.shortest)
        suffixes = ragged(stop[runs] - room[runs], room[runs] - self.shortest + 1)
        if not len(suffixes):
            return none, none, none, none
        left = np.where(suffixes > 0, docs[suffixes - 1], 0)
        keys = self.keys(np.column_stack([docs[suffixes[:, None] + np.arange(self.window)], left]))
        order = np.argsort(keys, kind="stable")
        suffixes, keys = suffixes[order], keys[order]
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        found = np.flatnonzero(hi > lo)
        lo, hi, same = lo[found], hi[found], self.same[found]
        begin = np.where(self.open[found], hi, np.searchsorted(keys, same, "left"))
        end = np.where(self.open[found], hi, np.searchsorted(keys, same, "right"))
        at = suffixes[np.concatenate([ragged(lo, begin - lo), ragged(end, hi - end)])]
        test = np.concatenate([np.repeat(found, begin - lo), np.repeat(found, hi - end)])
        n, owner, item = self.lengths[test].copy(), self.owner[test], self.starts[test]
        going = np.flatnonzero(n >= self.window)
        while len(going):
            a, b = docs[at[going] + n[going]], self.flat[item[going] + n[going]]
            going = going[(a == b) & (a != 0)]
            n[going] += 1
        return at, item, n, owner


def blocks(benchmark: DataFrame, window: int, block_bytes: int, item: str, text: str) -> list[Tests]:
    """The benchmark in blocks of bounded size, read one partition at a time."""
    out, items, size = [], [], 0
    for row in benchmark.select(F.col(item).cast("string"), text).toLocalIterator():
        more = len(row[1].encode()) if row[1] else 0
        if items and size + more > block_bytes:
            out.append(Tests(items, window))
            items, size = [], 0
        items.append((row[0] or "", row[1]))
        size += more
    return [*out, Tests(items, window)]


def _scan(tests: Broadcast, window: int, text: str, place: int, result: str, drop_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Tests = tests.value
        get = known.vocab.get
        for batch in slices(batches, place, SHARD):
            rows, lengths = [], []
            gap = np.zeros(1, np.int32)
            for t in batch.column(place).to_pylist():
                w = words(t)
                lengths.append(len(w))
                rows += [np.array([get(x, 0) for x in w], np.int32), gap]
            ids = np.concatenate([*rows, np.zeros(window, np.int32)])
            n_words = np.array(lengths, np.int64)
            first = np.cumsum(n_words + 1) - n_words - 1
            at, item, n, owner = known.search(ids)
            doc = np.searchsorted(first, at, "right") - 1
            order = np.lexsort((item, at))
            at, item, n, owner, doc = (x[order] for x in (at, item, n, owner, doc))
            name = [known.ids[k][0] for k in owner]
            begin = np.array([known.ids[k][1] for k in owner], np.int64)
            earlier = batch.schema.get_field_index(result)
            if earlier >= 0:  # the matches of the blocks before
                old = batch.column(earlier).field("matches")
                flat, counts = old.flatten(), np.diff(old.offsets.to_numpy())
                doc = np.concatenate([np.repeat(np.arange(len(counts)), counts), doc])
                word = np.concatenate([flat.field("doc_word").to_numpy(zero_copy_only=False), at - first[doc[len(flat) :]]])
                name = [*flat.field("item_id").to_pylist(), *name]
                inner = np.concatenate([flat.field("item_word").to_numpy(zero_copy_only=False), item - begin])
                n = np.concatenate([flat.field("n_words").to_numpy(zero_copy_only=False), n]).astype(np.int64)
                order = np.argsort(doc, kind="stable")
                doc, word, inner, n, name = doc[order], word[order], inner[order], n[order], [name[i] for i in order]
            else:
                word, inner = at - first[doc], item - begin
            edge = np.zeros(len(ids) + 1, np.int32)
            np.add.at(edge, first[doc] + word, 1)
            np.add.at(edge, first[doc] + word + n, -1)
            hit = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
            pieces = pa.StructArray.from_arrays(
                [pa.array(name, pa.string()), *(pa.array(x.astype(np.int32)) for x in (inner, word, n))], fields=list(ARROW_MATCH)
            )
            found = list_array(pieces, np.bincount(doc, minlength=batch.num_rows))
            values = [pa.array(n_words), pa.array(hit[first + n_words] - hit[first]), found]
            names = ["n_words", "n_hit", "matches"]
            out = replace_column(batch, result, pa.StructArray.from_arrays(values, names))
            yield out.drop_columns([text]) if drop_text else out

    return run


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", result: str = "leak", window: int = 8,
    block_bytes: int = 32 << 20, item: str = "item_id", item_text: str = "text", drop_text: bool = False,
) -> DataFrame:
    """Add a struct ``result``: ``n_words``, ``n_hit`` (words inside an occurrence of a window of a test item) and
    ``matches`` (longest verbatim matches: item, word within it, word within the document, length).

    One narrow pass over the documents for each block of the benchmark; no shuffle.
    """
    spark = docs.sparkSession
    out = docs.drop(result)
    found = blocks(benchmark, window, block_bytes, item, item_text)
    for k, tests in enumerate(found):
        last = drop_text and k == len(found) - 1
        fields = [f for f in out.schema.fields if f.name != result and not (last and f.name == text)]
        schema = T.StructType([*fields, T.StructField(result, RESULT)])
        out = map_texts(out, _scan(spark.sparkContext.broadcast(tests), window, text, out.columns.index(text), result, last), schema)
    return out


def item_ids(result: str = "leak"):
    """The distinct items of a result column, sorted as strings."""
    return F.array_sort(F.array_distinct(F.col(f"{result}.matches.item_id")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, min_items: int = 1, **options) -> DataFrame:
    """The documents that hold windows of fewer than ``min_items`` test items, with the columns of ``docs``."""
    mark = fresh_name(docs, "_leak")
    return find_leaks(docs, benchmark, result=mark, **options).filter(F.size(item_ids(mark)) < min_items).select(*docs.columns)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"), drop_text=True)
    ids = found.select("doc_id", "leak.n_words", "leak.n_hit", item_ids().alias("ids"))
    n = F.size("ids").cast("bigint")
    return ids.select(
        "doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"),
        (n >= 2).alias("contaminated"),
    )


#: DuckDB SQL for the rows of :func:`query`: all windows as strings, joined.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS s FROM b, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT k, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT k, i, n, item_id FROM spots JOIN windows USING (n, s)),
words AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT k, i, n FROM hits) AS h, unnest(range(i, i + n)) AS t(j) GROUP BY k),
items AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""
