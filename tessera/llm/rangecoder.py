"""Token-id files, compressed by an adaptive context-mixing range coder.

Ids are cut into blocks of at most ``LANES * BLOCK`` ids that are coded independently, each with a fresh model and a CRC
of its ids. A block lies in lanes, runs of at most ``BLOCK`` ids, which step forward side by side as numpy arrays and
share the block's model; every lane has a range coder of its own.

The model mixes three predictions for the next id: the exact counts of all ids of the block so far (order 0), the id that
the one before it leads to (order 1), and the id that the two before it lead to (order 2). Every context keeps one id and
how far it can be trusted. The probability of an id is the weighted sum of what the three give it, so nothing is lost
where they agree. The weights follow the hit rates of both guesses, apart for every pair of trusts and for
whether both name the same id. Order 0 leaves a rest of the scale, sized by the number of ids seen once, to ids that the
block hasn't held. Counts, contexts and weights are renewed at the ``borders``, where both sides know every lane up to there,
so no step of a lane waits for another lane.

All of it is in integers. The range coder has a 64-bit low end and range, and moves 32-bit words; a carry goes into the
words that were sent.

A file image (little-endian): the magic, u16 version, u16 planes, u32 documents, u64 ids, u32 bytes of the directory;
the directory (zlib: i64 document ids, u8 null flags, u32 ids of each document); u32 CRC of all before; then per
plane (16 bits of the ids) and block: u32 ids, u32 bound of the plane's values, u32 CRC of its u16 values, a u16 number of
words for each lane, and the words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import keep, map_texts, slices, table, texts
from tessera.llm.tokens import tokenizer_path, with_end, word_cache

MAGIC, VERSION = b"TSID", 3  # images of other tables can't be read
BLOCK, LANES = 1024, 2048  # ids of a lane, lanes of a block
IMAGE = 4 * LANES * BLOCK  # ids of an image, about
LEAST_LANE = 512  # ids of a lane, where a block is too small for all lanes
PERIOD = 16  # ids of a lane between borders
SCALE_BITS, SHARE_BITS, TRUST, FINE = 22, 8, 8, 7
SCALE, TOTAL_BITS, SHARES = 1 << SCALE_BITS, SCALE_BITS + SHARE_BITS, 1 << SHARE_BITS
U, I = np.uint64, np.int32
WORD, HALF = U(1 << 32), U(32)
GUESS, NINE, THREE, SIXTEEN, MOST = I(0xFFFF), I(511), I(3), I(16), I((TRUST - 1) << 16)


def borders(n: int) -> list[int]:
    """Where the model is renewed: 0, 1, doubling to ``PERIOD``, then every ``PERIOD`` ids of a lane."""
    early = [0, *(1 << k for k in range(PERIOD.bit_length() - 1))]
    return [b for b in (*early, *range(PERIOD, n, PERIOD)) if b < n] + [n]


class Model:
    """The model of a block of so many lanes with values below ``high``; it knows them up to the last border."""

    def __init__(self, lanes: int, high: int = 1 << 16):
        self.high, self.count, self.every = high, np.zeros(high, np.int64), np.arange(high, dtype=I)
        self.mask = (1 << min(19, max(12, (BLOCK // 4 * lanes - 1).bit_length()))) - 1
        # the id that a context leads to, and above it the trust: 0 for a context not seen yet
        self.one, self.two = np.zeros(1 << 16, I), np.zeros(self.mask + 1, I)
        # per state: how often neither guess, that of order 1, that of order 2, or both were right
        self.right = np.tile(np.array([4, 1, 1, 0], np.int64), (2 * TRUST * TRUST, 1))
        self.right[1::2] = [2, 0, 0, 2]
        self.renew()

    @property
    def value(self) -> np.ndarray:
        """The ids so far, ascending."""
        return np.flatnonzero(self.count)

    @property
    def n(self) -> np.ndarray:
        """How often each of ``value`` came."""
        return self.count[self.value]

    def renew(self) -> None:
        """Order 0 as places on a scale, and the shares of the mixture, from the counts.

        Seen ids come first on the scale, by their counts; all ids alike share the rest, which is as much as ids
        seen once make up.
        """
        seen = np.flatnonzero(self.count)
        n = self.count[seen]
        total, once = int(n.sum()), int(np.count_nonzero(n == 1)) + 1
        self.width = max(1, (SCALE - self.high) * once // (total + once) // self.high)
        self.end = SCALE - self.width * self.high if total else 0
        if not total:
            self.width = SCALE // self.high
        self.seen = seen
        before = np.append(0, np.cumsum(n))
        at = np.arange(len(before))
        self.start = at + before * (self.end - len(seen)) // max(1, total)
        self.low, self.wide = self.every * I(self.width) + I(self.end), np.full(self.high, self.width, I)  # by id
        self.low[seen], self.wide[seen] = self.start[:-1], np.diff(self.start)
        share = self.right.copy()
        share = 1 + share[:, 1:] * (SHARES - 6) // share.sum(axis=1, keepdims=True)
        share[0::2, 2], share[1::2, :2] = 0, 0  # guesses that differ can't be right both; one that both name counts for order 2
        share[:, 1] += share[:, 2]
        self.share = (share[:, 0] | share[:, 1] << 9 | (SHARES - share[:, 0] - share[:, 1]) << 18).astype(I)

    def find(self, at: np.ndarray) -> np.ndarray:
        """The ids at places of the scale."""
        some = self.seen.take(self.start.searchsorted(at, "right") - 1, mode="clip") if len(self.seen) else at
        return np.where(at < self.end, some, np.minimum((at - self.end) // self.width, self.high - 1))

    def context(self, before: np.ndarray, before2: np.ndarray) -> np.ndarray:
        """Places of order-2 contexts."""
        return (before * 40503 + before2 * 9176 + (before >> 5)) & self.mask

    def mix(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        """Both guesses, the state of trust in them, and the mixture: parts of orders 1 and 2, and a factor of order 0."""
        guess1, guess2 = one & GUESS, two & GUESS
        state = (one >> SIXTEEN) * I(2 * TRUST) + (two >> SIXTEEN) * I(2) + (guess1 == guess2)
        share = self.share.take(state)
        return guess1, guess2, state, (share & NINE) << I(SCALE_BITS), (share >> I(9) & NINE) << I(SCALE_BITS), share >> I(18)

    def place(self, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the ids ``back[:, 2:]`` (two earlier ones lead): places and widths, in parts of ``1 << TOTAL_BITS``, their states,
        and which guesses were right (1 for order 1, 2 for order 2).
        """
        x, before = back[:, 2:], back[:, 1:-1]
        one, two = self.one.take(before), self.two.take(self.context(before, back[:, :-2]))
        guess1, guess2, state, part1, part2, factor = self.mix(one, two)
        low, wide = self.low.take(x), self.wide.take(x)
        low1, low2 = self.low.take(guess1), self.low.take(guess2)
        right1, right2 = low1 == low, low2 == low
        start = factor * low + part1 * (low1 < low) + part2 * (low2 < low)
        width = factor * wide + part1 * right1 + part2 * right2
        return start, width, state, right1 + (right2.view(np.int8) << np.int8(1))

    def learn(self, back: np.ndarray, state: np.ndarray, right: np.ndarray, fresh: np.ndarray) -> None:
        """Take in the ids ``back[:, 2:]`` (two earlier ones lead) with their states and which guesses were right;
        ``fresh`` are the ids to be counted.
        """
        self.count += np.bincount(fresh.ravel(), minlength=self.high)
        self.right += np.bincount((state * I(4) + right).ravel(), minlength=self.right.size).reshape(-1, 4)
        x, before = back[:, 2:].astype(I), back[:, 1:-1]
        for table, at in ((self.one, before), (self.two, self.context(before, back[:, :-2]))):
            old = table.take(at)
            hit = (old & GUESS) == x
            trust = old >> SIXTEEN
            # a right guess gains trust; a proven one that fails is given up at half its trust only
            kept = old - ((trust - (trust >> I(1))) << SIXTEEN)
            new = np.where(trust >= THREE, kept, x | I(1 << 16))
            np.copyto(new, np.minimum(old + I(1 << 16), MOST | (old & GUESS)), where=hit)
            table[at] = new  # of equal contexts the last counts
        self.renew()


def _led(ids: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Columns ``begin`` to ``end`` with the two before them; zeros lead a lane."""
    lead = min(2, begin)
    back = np.zeros((len(ids), end - begin + 2), np.int64)
    back[:, 2 - lead :] = ids[:, begin - lead : end]
    return back


def _carry(out: np.ndarray, pos: np.ndarray, lanes: np.ndarray) -> None:
    """Add one to the words that lanes have sent so far."""
    at = pos[lanes] - 1
    while len(lanes):
        out[at, lanes] += np.uint32(1)
        on = out[at, lanes] == 0
        lanes, at = lanes[on], at[on] - 1


def encode_lanes(ids: np.ndarray, high: int = 1 << 16) -> list[np.ndarray]:
    """Words of every row of ``ids`` (lanes x n, of values below ``high``)."""
    lanes, n = ids.shape
    model = Model(lanes, high)
    low, span = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    out, pos = np.zeros((n + 2, lanes), np.uint32), np.zeros(lanes, np.int64)
    part, cut = np.empty(lanes, U), borders(n)
    for begin, end in zip(cut[:-1], cut[1:], strict=True):
        back = _led(ids, begin, end)
        start, width, state, right = model.place(back)
        for a, w in zip(start.T.astype(U), width.T.astype(U), strict=True):
            span >>= U(TOTAL_BITS)
            np.multiply(a, span, out=part)
            low += part
            over = np.flatnonzero(low < part)
            if len(over):
                _carry(out, pos, over)
            span *= w
            i = np.flatnonzero(span < WORD)
            if len(i):
                p, down = pos.take(i), low.take(i)
                out[p, i] = down >> HALF
                pos[i], low[i], span[i] = p + 1, down << HALF, span.take(i) << HALF
        model.learn(back, state, right, back[:, 2:])
    # the range holds a number that ends with zeros, so a word more tells it
    low += WORD - U(1)
    _carry(out, pos, np.flatnonzero(low < WORD - U(1)))
    out[pos, np.arange(lanes)] = low >> HALF
    return [column[: k + 1] for column, k in zip(np.ascontiguousarray(out.T), pos.tolist(), strict=True)]


def decode_lanes(words: list[np.ndarray], n: int, high: int = 1 << 16) -> np.ndarray:
    """Inverse of :func:`encode_lanes` for rows of ``n`` ids."""
    lanes = len(words)
    feed = np.zeros((max(map(len, words)) + 2, lanes), np.uint32)
    for i, w in enumerate(words):
        feed[: len(w), i] = w
    code = (feed[0].astype(U) << HALF) | feed[1]
    feed, pos, stop = feed.ravel(), np.arange(lanes) + 2 * lanes, feed.size - 1
    span = np.full(lanes, 2**64 - 1, U)
    model, cut = Model(lanes, high), borders(n)
    ids = np.zeros((lanes, n), np.uint16)
    before = before2 = np.zeros(lanes, np.int64)
    most = U((1 << TOTAL_BITS) - 1)
    cells = (np.arange(1 << (SCALE_BITS - FINE), dtype=I) + I(1)) << I(FINE)
    # ``code`` is relative to the low end; values of a sound stream are in bounds, those of a damaged one are clipped
    for begin, end in zip(cut[:-1], cut[1:], strict=True):
        lows, wides, starts = model.low, model.wide, model.start.astype(I)
        # of every small cell of the scale the id that fills it; none where several share it
        fill = np.zeros(len(cells) + 1, I)
        fill[(starts[:-1] + I((1 << FINE) - 1)) >> I(FINE)] = np.arange(len(starts) - 1)
        fill = np.maximum.accumulate(fill[:-1])
        lone = starts[1:].take(fill) >= cells if len(starts) > 1 else np.zeros(len(fill), bool)
        fill = np.where(lone, model.seen.astype(I).take(fill), I(-1)) if len(starts) > 1 else np.full(len(fill), -1, I)
        found = np.empty((end - begin, lanes), np.int64)
        states, rights = np.empty((end - begin, lanes), I), np.empty((end - begin, lanes), np.int8)
        for t in range(end - begin):
            one, two = model.one.take(before), model.two.take(model.context(before, before2))
            guess1, guess2, states[t], part1, part2, factor = model.mix(one, two)
            at1, at2 = guess1.astype(np.int64), guess2.astype(np.int64)
            low1, low2 = lows.take(at1), lows.take(at2)
            from1 = factor * low1 + part2 * (low2 < low1)
            from2 = factor * low2 + part1 * (low1 < low2)
            span >>= U(TOTAL_BITS)
            v = np.minimum(code // span, most).astype(I)
            past1, past2 = v >= from1 + factor * wides.take(at1) + part1, v >= from2 + factor * wides.take(at2) + part2
            rest = ((v - part1 * past1 - part2 * past2) / factor).astype(np.int64)  # the floor of such a quotient is exact
            x = fill.take(rest >> FINE, mode="clip")
            np.copyto(x, guess1, where=(v >= from1) > past1)
            np.copyto(x, guess2, where=(v >= from2) > past2)
            i = np.flatnonzero(x < 0)
            if len(i):
                x[i] = model.find(rest.take(i))
            now = found[t]
            now[:] = x
            low = lows.take(now)
            right1, right2 = low1 == low, low2 == low
            np.add(right1, right2.view(np.int8) << np.int8(1), out=rights[t])
            down = (factor * low + part1 * (low1 < low) + part2 * (low2 < low)).astype(U)
            down *= span
            code -= down
            span *= (factor * wides.take(now) + part1 * right1 + part2 * right2).astype(U)
            i = np.flatnonzero(span < WORD)
            if len(i):
                p = pos.take(i)
                code[i] = (code.take(i) << HALF) | feed.take(np.minimum(p, stop))
                pos[i], span[i] = p + lanes, span.take(i) << HALF
            before2, before = before, now
        ids[:, begin:end] = found.T
        back = _led(ids, begin, end)
        model.learn(back, states.T, rights.T, back[:, 2:])
    return ids


def _parts(n: int) -> Iterator[tuple[int, int, int, int]]:
    """Blocks of ``n`` ids as (first id, ids, lanes, ids per lane); the last lane may be short."""
    most = -(-n // max(1, -(-n // (LANES * BLOCK))))  # blocks of about one size
    for first in range(0, n, max(1, most)):
        size = min(most, n - first)
        per = -(-size // min(LANES, max(1, size // LEAST_LANE)))
        yield first, size, -(-size // per), per


def encode_image(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents: their ids (as ``uint32``) in a row, ``counts`` of them each."""
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    flags = np.array([d is None for d in doc_ids], np.uint8)
    directory = zlib.compress(numbers.tobytes() + flags.tobytes() + counts.astype("<u4").tobytes())
    planes = 2 if len(ids) and int(ids.max()) > 0xFFFF else 1
    head = MAGIC + struct.pack("<HHIQI", VERSION, planes, len(doc_ids), len(ids), len(directory)) + directory
    out = [head, struct.pack("<I", zlib.crc32(head))]
    for plane in range(planes):
        values = ((ids >> np.uint32(16 * plane)) & np.uint32(0xFFFF)).astype("<u2")
        for at, size, lanes, per in _parts(len(values)):
            part = values[at : at + size]
            high = int(part.max()) + 1
            words = encode_lanes(np.append(part, np.zeros(lanes * per - size, "<u2")).reshape(lanes, per), high)
            out += [struct.pack("<III", size, high, zlib.crc32(part.tobytes())), np.fromiter(map(len, words), "<u2", lanes).tobytes()]
            out.append(np.concatenate(words).astype("<u4").tobytes())
    return b"".join(out)


def decode_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Inverse of :func:`encode_image`; a damaged image raises ``ValueError``."""
    fixed = struct.calcsize("<HHIQI")
    if image[:4] != MAGIC or len(image) < 8 + fixed:
        raise ValueError("not a token-id file")
    version, planes, n_docs, n_ids, size = struct.unpack_from("<HHIQI", image, 4)
    at = 4 + fixed + size
    if version != VERSION or len(image) < at + 4 or zlib.crc32(image[:at]) != struct.unpack_from("<I", image, at)[0]:
        raise ValueError("damaged head of a token-id file")
    raw = zlib.decompress(image[4 + fixed : at])
    numbers, flags = np.frombuffer(raw, "<i8", n_docs), np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs)
    counts = np.frombuffer(raw, "<u4", n_docs, 9 * n_docs).astype(np.int64)
    at += 4
    ids = np.zeros(n_ids, np.uint32)
    for plane in range(planes):
        for first, size, lanes, per in _parts(n_ids):
            if at + 12 + 2 * lanes > len(image):
                raise ValueError("a token-id file ends too soon")
            m, high, crc = struct.unpack_from("<III", image, at)
            n = np.frombuffer(image, "<u2", lanes, at + 12).astype(np.int64)
            at += 12 + 2 * lanes
            if m != size or not 0 < high <= 1 << 16 or at + 4 * int(n.sum()) > len(image):
                raise ValueError("damaged block of a token-id file")
            words = np.split(np.frombuffer(image, "<u4", int(n.sum()), at), np.cumsum(n)[:-1])
            at += 4 * int(n.sum())
            part = decode_lanes(words, per, high).ravel()[:size]
            if zlib.crc32(part.astype("<u2").tobytes()) != crc:
                raise ValueError("damaged block of a token-id file")
            ids[first : first + size] |= part.astype(np.uint32) << np.uint32(16 * plane)
    return [None if f else int(d) for d, f in zip(numbers, flags, strict=True)], counts, ids


def write_ids(docs: DataFrame, *, path: str, end: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """File images of the ids of all texts in ascending order of ``doc`` (null first, then by text), ``end`` after each.

    Documents are range-partitioned; every range is a run of images of about ``IMAGE`` ids. The table has
    ``part``, ``seq`` (both ascending with the documents), ``n_ids`` and ``image``, and lies in the shared folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, seq = word_cache(path), TaskContext.get().partitionId(), 0
        names, counts, ids, n = [], [], [], 0

        def image() -> pa.RecordBatch:
            data = encode_image(names, np.concatenate(counts), np.concatenate(ids))
            values = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(values, ["part", "seq", "n_ids", "image"])

        for batch in slices(batches, 1):
            flat, count = with_end(*cache.encode(texts(batch.column(1))), end)
            names += batch.column(0).to_pylist()
            counts.append(count)
            ids.append(flat)
            n += len(flat)
            if n >= IMAGE:
                yield image()
                names, counts, ids, n, seq = [], [], [], 0, seq + 1
        if names:
            yield image()

    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.asc_nulls_first("doc_id"), tie).sortWithinPartitions(F.asc_nulls_first("doc_id"), tie, "text")
    return keep(map_texts(ordered, run, "part int, seq int, n_ids bigint, image binary"), "ids")


def read_ids(images: DataFrame) -> DataFrame:
    """Documents of the images: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, counts, ids = decode_image(image)
                raw = memoryview(ids.astype("<u4")).cast("B")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                n = len(names)
                values = [np.full(n, part, np.int32), np.full(n, seq, np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, values), pa.array(names, pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    schema = "part int, seq int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint"
    found = images.select("part", "seq", "image").mapInArrow(run, schema)
    # a row per image, not per document: the running total is short
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = images.select("part", "seq", before.alias("before"))
    return found.join(offsets, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir):
    return read_ids(write_ids(table(spark, sf_dir, "documents"), path=tokenizer_path("word_bpe_49k.json"), end=2))
