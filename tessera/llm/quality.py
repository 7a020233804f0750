"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few features. Cyclic boosting visits one feature after the other and fits a shallow tree (at most four
leaves over the feature's bins) to the remaining residual; the trees of a feature add up to a lookup table. Then the
pairs of features that explain most of what is left get two-dimensional tables the same way. A score is the
logistic of a sum of table entries, so scoring is binning and adding.

The model is fitted on the driver, on at most ``SAMPLE`` labels (20,000); all documents are scored in one narrow pass.

Cases: null and empty texts have features of their own value and so a score; repeated rows are scored each; without
labels of both kinds every score is the share of ones, or 0.5; an empty table gives an empty result; columns named like
result columns are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh_name, map_texts, replace_column, slices, table
from tessera.llm.labelled import fold, labelled

SAMPLE = 20_000
BINS, LEAVES, ROUNDS, PAIR_ROUNDS, PAIRS, PAIR_BINS, RATE = 32, 4, 150, 60, 6, 8, 0.15
NAMES = [
    "log_bytes", "log_words", "upper", "digit", "symbol", "bang", "bar", "punctuation", "space", "newline", "beyond_ascii",
    "word_length", "distinct_words", "distinct_lines", "symbol_words", "upper_words", "entropy",
]

_CLASS = np.zeros((256, 9), np.float64)  # byte to class counts
for _b in range(256):
    _ch = chr(_b)
    _CLASS[_b] = [
        65 <= _b <= 90, 97 <= _b <= 122, 48 <= _b <= 57, _ch in "#$%&*@^~<>{}[]\\_=+`", _ch == "!", _ch == "|", _ch in ".,;:?'\"()-",
        _b in (9, 11, 12, 13, 32), _b == 10,
    ]


def features(text: str | None) -> list[float]:
    """The values of :data:`NAMES` for a text."""
    raw = (text or "").encode()
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit, symbol, bang, bar, punctuation, space, newline = (count @ _CLASS).tolist()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    w, size = len(words), max(1, n)
    present = count[count > 0] / size
    marked = sum(x[-1:] in b"#$%&*@|!" for x in words)
    return [
        math.log1p(n), math.log1p(w), upper / max(1.0, upper + lower), digit / size, symbol / size, bang / size, bar / size,
        punctuation / size, space / size, newline / size, float(count[128:].sum()) / size, n / max(1, w),
        len(set(words)) / max(1, w), len(set(lines)) / max(1, len(lines)), marked / max(1, w),
        sum(map(bytes.isupper, words)) / max(1, w), float(-(present * np.log2(present)).sum()) if n else 0.0,
    ]


def _tree(gradient: np.ndarray, weight: np.ndarray, least: float, leaves: int) -> np.ndarray:
    """Values of a greedy tree of at most ``leaves`` leaves over ordered bins: Newton steps, a split at a time."""
    parts, n = [(0, len(gradient))], len(gradient)
    g, h = np.append(0, np.cumsum(gradient)), np.append(0, np.cumsum(weight))
    gain_of = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)

    def split(a: int, b: int) -> tuple[float, int]:
        cut = np.arange(a + 1, b)
        left, right = h[cut] - h[a], h[b] - h[cut]
        ok = (left >= least) & (right >= least)
        if not ok.any():
            return 0.0, 0
        gain = np.where(ok, (g[cut] - g[a]) ** 2 / (left + 1.0) + (g[b] - g[cut]) ** 2 / (right + 1.0) - gain_of(a, b), 0)
        k = int(gain.argmax())
        return float(gain[k]), int(cut[k])

    while len(parts) < leaves:
        best = max(((*split(a, b), a, b) for a, b in parts), key=lambda x: x[0])
        if best[0] <= 1e-9:
            break
        parts.remove((best[2], best[3]))
        parts += [(best[2], best[1]), (best[1], best[3])]
    out = np.zeros(n)
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


class Additive:
    """Bins, lookup tables of features and of pairs, and the intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges, self.pairs, self.pair_tables = [], [], []
        ones = float(y.sum())
        prior = ones / len(y) if len(y) else 0.5
        self.constant = None if 0 < ones < len(y) else prior
        if self.constant is not None:
            return
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.base = math.log(prior / (1 - prior))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        bins = self.bins(x)
        score = np.full(len(y), self.base)
        least = max(2.0, 0.002 * len(y)) * prior * (1 - prior)

        def residual() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-score))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for k, t in enumerate(self.tables):
                g, h = residual()
                n = len(t)
                step = RATE * _tree(np.bincount(bins[k], g, n), np.bincount(bins[k], h, n), least, LEAVES)
                t += step
                score += step[bins[k]]
        self.coarse = [np.minimum(np.arange(len(t)) * PAIR_BINS // len(t), PAIR_BINS - 1) for t in self.tables]
        small = [c[b] for c, b in zip(self.coarse, bins, strict=True)]
        g, h = residual()
        found = []
        for i in range(len(small)):
            for j in range(i):
                cell = small[i] * PAIR_BINS + small[j]
                found.append(((np.bincount(cell, g, PAIR_BINS**2) ** 2 / (np.bincount(cell, h, PAIR_BINS**2) + 1.0)).sum(), i, j))
        for _, i, j in sorted(found, reverse=True)[:PAIRS]:
            self.pairs.append((i, j))
            self.pair_tables.append(np.zeros((PAIR_BINS, PAIR_BINS)))
        for _ in range(PAIR_ROUNDS):
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                g, h = residual()
                cell = small[i] * PAIR_BINS + small[j]
                gs, hs = (np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h))
                step = self._pair_step(gs, hs, least)
                t += RATE * step
                score += RATE * step[small[i], small[j]]

    @staticmethod
    def _pair_step(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
        """A tree of depth two: the best cut of one feature, then a cut of the other on each side."""
        best, out = -1.0, np.zeros_like(g)
        for flip in (False, True):
            a, b = (g.T, h.T) if flip else (g, h)
            for cut in range(1, len(a)):
                step = np.zeros_like(a)
                for rows in (slice(0, cut), slice(cut, len(a))):
                    step[rows] = _tree(a[rows].sum(axis=0), b[rows].sum(axis=0), least, 2)
                gain = float((step * a - step**2 * (b + 1e-9) / 2).sum())
                if gain > best:
                    best, out = gain, step.T if flip else step
        return out

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        bins = self.bins(x)
        out = np.full(len(x), self.base)
        for t, b in zip(self.tables, bins, strict=True):
            out += t[b]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-out))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> Additive:
    """Fit on at most ``bound`` labels outside fold 0; only features and labels reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, text, y = batch.columns
            values = pa.array([features(t) for t in text.to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([ids, values, y], ["doc_id", "x", "label"])

    rows = map_texts(labelled(docs, labels, label, bound), run, "doc_id bigint, x array<double>, label int")
    got = rows.collect()  # a row per label
    got.sort(key=lambda r: (r.doc_id, r.label, r.x))
    return Additive(np.array([r.x for r in got]).reshape(-1, len(NAMES)), np.array([r.label for r in got], np.float64))


def score(docs: DataFrame, model: Additive, text: str = "text", column: str = "score", drop_text: bool = False) -> DataFrame:
    """Add the score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed number of bins
    out = docs.drop(column)
    fields = [f for f in out.schema.fields if not (drop_text and f.name == text)]
    place = out.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            x = np.array([features(t) for t in batch.column(place).to_pylist()])
            batch = replace_column(batch, column, pa.array(sent.value.score(x.reshape(-1, len(NAMES)))))
            yield batch.drop_columns([text]) if drop_text else batch

    return map_texts(out, run, T.StructType([*fields, T.StructField(column, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents that score ``least`` or more, with the columns of ``docs``."""
    mark = fresh_name(docs, "__quality")
    return score(docs, train(docs, labels), column=mark).filter(F.col(mark) >= least).select(*docs.columns)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")), drop_text=True)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
