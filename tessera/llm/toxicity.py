"""Toxicity: a bidirectional GRU with attention pooling over character and word inputs, trained in numpy.

A word's inputs are learned with the network, by back-propagation: a vector of the word (of its hash), and the mean of the
vectors of its character n-grams between marks for its ends (of their hashes). Beside them stands what the labelled
rows say about it outright: the shrunk log-odds of the word, of its prefixes and of its inner n-grams (the largest of each, and the inner
mean). While the network is trained, the rows of one half take these statistics from the other half, so it learns how far to
trust them, and words lose their vectors or their statistics at random, so no input can be relied on alone.

The network reads windows of ``WINDOW`` words every ``STRIDE`` words, so every passage of up to ``WINDOW - STRIDE + 1``
words (25) lies whole in one. It is trained on windows: for a toxic
document the one it scores highest counts as toxic, chosen anew every few epochs. A document's score is a logistic of its
highest window, fitted on rows that the network wasn't trained on. Every whole text is scored, in overlapping windows.

Training takes at most ``SAMPLE`` labels (6,000) with at most ``SAMPLE_BYTES`` of text (64 MB) in all, in a single task: rows in order
of the id's hash, as long as they fit. Scoring is one narrow pass. Inputs of distinct words are kept in a bounded cache per worker.

Cases: null and empty texts have one window without words; repeated rows are scored each; of several texts with a label's id
one is learned from; without labels of both kinds every score is the share of ones, or 0; an empty table gives an empty result; columns
named like the result are replaced.
"""

from __future__ import annotations

import math
import pickle
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import keep, map_texts, ragged, replace_column, scratch, slices, table
from tessera.llm.labelled import fold, labelled
from tessera.llm.leaks import words

SAMPLE, SAMPLE_BYTES = 6_000, 64 << 20
WINDOW, STRIDE, HIDDEN, VECTOR, LISTED = 32, 8, 8, 6, 4
INPUTS = 2 * VECTOR + LISTED
WORD_ROWS, GRAM_ROWS, GRAM_SIZES = 1 << 15, 1 << 14, (3, 4)
VECTOR_RATE, LOSE_WORD, LOSE_LIST = 0.1, 0.8, 0.3
PREFIXES, INNER, SUPPORT, PRIOR = (3, 4, 5, 6), 4, 3, 6
EPOCHS, STEPS, BATCH, LEARNING_RATE, NEGATIVES, RANKED = 8, 300, 256, 0.01, 8, 3
MAX_WORDS, CHUNK = 400_000, 4096
STEPS_OF = np.arange(WINDOW)[:, None]


def grams(word: bytes) -> tuple[str, list[str], list[str]]:
    """The word, its prefixes, and its inner n-grams, as keys of the statistics."""
    w = word.decode().lower()
    inner = [w[i : i + INNER] for i in range(1, len(w) - INNER + 1)]
    return f"={w}", [f"^{w[:k]}" for k in PREFIXES if len(w) >= k], inner


def hashed(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the words' vectors, of those of their character n-grams (of UTF-8 bytes, marks at both ends) in a row, and
    the number of n-grams of each.
    """
    rows = np.fromiter((zlib.crc32(w) % WORD_ROWS for w in found), np.int64, len(found))
    size = np.fromiter(map(len, found), np.int64, len(found)) + 2
    code = np.frombuffer(b"<" + b"><".join(found) + b">", np.uint8).astype(np.uint32) if found else np.zeros(0, np.uint32)
    begin, n, parts = np.cumsum(size) - size, np.zeros(len(found), np.int64), []
    for length in GRAM_SIZES:
        many = np.maximum(size - length + 1, 0)
        at = ragged(begin, many)
        h = np.full(len(at), length, np.uint32)
        for k in range(length):
            h = (h ^ code[at + k]) * np.uint32(0x01000193)  # fixed value: the 32-bit FNV prime
        parts.append((np.repeat(np.arange(len(found)), many), ((h ^ (h >> np.uint32(15))) % np.uint32(GRAM_ROWS)).astype(np.int64)))
        n += many
    owner, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
    return rows, gram[np.argsort(owner, kind="stable")], n


class Vectors:
    """Learned vectors of hashed words and character n-grams."""

    def __init__(self, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.word = (0.1 * rng.standard_normal((WORD_ROWS, VECTOR))).astype(np.float32)
        self.gram = (0.1 * rng.standard_normal((GRAM_ROWS, VECTOR))).astype(np.float32)
        self.seen = [np.full(len(t), 0.1, np.float32) for t in (self.word, self.gram)]

    def of(self, word: np.ndarray, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Vectors of words: their own, and the mean of ``n`` n-grams each, which lie in a row."""
        if not len(word):
            return np.zeros((0, 2 * VECTOR), np.float32)
        mean = np.add.reduceat(np.append(self.gram[gram], np.zeros((1, VECTOR), np.float32), axis=0), np.cumsum(n) - n) / np.maximum(n, 1)[:, None]
        mean[n == 0] = 0
        return np.concatenate([self.word[word], mean.astype(np.float32)], axis=1)

    def pull(self, word: np.ndarray, gram: np.ndarray, n: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of both tables from those of the words' vectors."""
        each = np.repeat(slope[:, VECTOR:] / np.maximum(n, 1)[:, None], n, axis=0)
        of_word = [np.bincount(word, slope[:, d], WORD_ROWS) for d in range(VECTOR)]
        of_gram = [np.bincount(gram, each[:, d], GRAM_ROWS) for d in range(VECTOR)]
        return np.stack(of_word, axis=1).astype(np.float32), np.stack(of_gram, axis=1).astype(np.float32)

    def step(self, of_word: np.ndarray, of_gram: np.ndarray) -> None:
        """Adagrad with a rate per row."""
        for table, slope, seen in ((self.word, of_word, self.seen[0]), (self.gram, of_gram, self.seen[1])):
            rows = np.flatnonzero(slope.any(axis=1))
            g = slope[rows]
            seen[rows] += (1000 * g**2).sum(axis=1)
            table[rows] -= VECTOR_RATE * 30 * g / np.sqrt(seen[rows])[:, None]


def sketch(text: list[bytes]) -> int:
    """The least hash of the 3-word shingles: mostly equal for copies and near copies, else hardly ever."""
    return min((zlib.crc32(b" ".join(text[i : i + 3])) for i in range(max(1, len(text) - 2))), default=0)


class Vocabulary:
    """Numbers for words, and for each word those of its keys in the statistics; compact, as it is on the driver."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.keys: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])

    def number(self, text: list[bytes]) -> np.ndarray:
        out = np.empty(len(text), np.int32)
        for k, w in enumerate(text):
            got = self.index.get(w)
            if got is None:
                got = self.index[w] = len(self.index)
                own, prefixes, inner = grams(w)
                self.flat.extend(self.keys.setdefault(g, len(self.keys)) for g in (own, *prefixes, *inner))
                self.ends.append(len(self.flat))
            out[k] = got
        return out


class Lexicon:
    """Log-odds of words and n-grams against the share of toxic documents, shrunk as by ``PRIOR`` more documents
    of that share; nothing for those of few documents.
    """

    def __init__(self, vocabulary: Vocabulary, docs: list[np.ndarray], labels: np.ndarray):
        flat, ends = np.array(vocabulary.flat, np.int32), np.array(vocabulary.ends, np.int64)
        seen = np.zeros((2, len(vocabulary.keys)), np.int32)
        for distinct, y in zip(docs, labels.tolist(), strict=True):
            seen[y, np.unique(flat[ragged(ends[distinct], ends[distinct + 1] - ends[distinct])])] += 1
        share = (labels.sum() + 1) / (len(labels) + 2)
        b, a = seen
        odds = np.log((a + PRIOR * share) / (b + PRIOR * (1 - share))) - math.log(share / (1 - share))
        odds[(a == 0) | (a + b < SUPPORT) | (odds < 0)] = 0
        self.odds = {key: o / 3 for key, o in zip(vocabulary.keys, odds.tolist(), strict=True) if o > 0}

    def inputs(self, word: bytes) -> tuple[float, float, float, float]:
        get = self.odds.get
        own, prefixes, inner = grams(word)
        known = [get(g, 0.0) for g in inner]
        return get(own, 0.0), max((get(p, 0.0) for p in prefixes), default=0.0), max(known, default=0.0), sum(known) / max(1, len(known))


def windows(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts that lie in a row: document, first word, and number of words. The last one ends the text."""
    n = np.maximum(1, -(-(n_words - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(n_words)), n)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    at = np.minimum(at, np.maximum(0, n_words[doc] - WINDOW))
    first = (np.cumsum(n_words) - n_words)[doc] + at
    return doc, first, np.minimum(n_words[doc], WINDOW)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """BiGRU, attention, logistic output. Arrays are (time, window, ...)."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"W{d}": init(INPUTS, 3 * HIDDEN), f"U{d}": init(HIDDEN, 3 * HIDDEN), f"b{d}": zero(3 * HIDDEN)}
        self.p |= {"A": init(2 * HIDDEN, HIDDEN), "a": init(HIDDEN), "o": init(2 * HIDDEN), "c": zero(1)}
        self.p["c"] -= 2

    def _read(self, x: np.ndarray, live: np.ndarray, d: str, trace: list | None) -> np.ndarray:
        """States of one direction; a dead position leaves the state as it is."""
        steps, n, H = len(x), x.shape[1], HIDDEN
        W, U, b = (self.p[k + d] for k in "WUb")
        h, out = np.zeros((n, H), np.float32), np.empty((steps, n, H), np.float32)
        into = (x.reshape(-1, INPUTS) @ W + b).reshape(steps, n, 3 * H)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            u = h @ U
            zr = sigmoid(into[t, :, : 2 * H] + u[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            m = np.tanh(into[t, :, 2 * H :] + r * u[:, 2 * H :])
            new = m + z * (h - m)
            if trace is not None:
                trace.append((t, h, z, r, m, u[:, 2 * H :]))
            h = np.where(live[t][:, None], new, h) if not live[t].all() else new
            out[t] = h
        return out

    def forward(self, x: np.ndarray, live: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logits of windows."""
        tf, tb = ([], []) if trace is not None else (None, None)
        h = np.concatenate([self._read(x, live, "f", tf), self._read(x, live, "b", tb)], axis=2)
        k = np.tanh(h @ self.p["A"])
        e = np.where(live, k @ self.p["a"], np.float32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = (w[:, :, None] * h).sum(axis=0)
        if trace is not None:
            trace |= {"f": tf, "b": tb, "h": h, "k": k, "w": w, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["c"]

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray, into: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, by back-propagation through time; those of ``x`` are added to ``into``."""
        s: dict = {}
        logit = self.forward(x, live, s)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dl = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["o"], g["c"] = s["pooled"].T @ dl, np.array([dl.sum()], np.float32)
        dp = dl[:, None] * self.p["o"]
        h, w, k = s["h"], s["w"], s["k"]
        dw = (h * dp).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        dk = de[:, :, None] * self.p["a"] * (1 - k**2)
        g["a"] = np.einsum("tn,tnh->h", de, k)
        g["A"] = np.einsum("tni,tnh->ih", h, dk)
        dh = w[:, :, None] * dp + dk @ self.p["A"].T
        H = HIDDEN
        for d, part in (("f", dh[:, :, :H]), ("b", dh[:, :, H:])):
            U, carry = self.p["U" + d], np.zeros_like(part[0])
            for t, h0, z, r, m, um in reversed(s[d]):
                total = part[t] + carry
                on = live[t][:, None]
                dn = np.where(on, total, 0)
                dm = dn * (1 - z) * (1 - m**2)
                dz = dn * (h0 - m) * z * (1 - z)
                dr = dm * um * r * (1 - r)
                gates = np.concatenate([dz, dr, dm], axis=1)
                into_u = np.concatenate([dz, dr, dm * r], axis=1)
                g["W" + d] += x[t].T @ gates
                if into is not None:
                    into[t] += gates @ self.p["W" + d].T
                g["b" + d] += gates.sum(axis=0)
                g["U" + d] += h0.T @ into_u
                carry = dn * z + into_u @ U.T + np.where(on, 0, total)
        return g


class Toxicity:
    """The lexicon, the network and the last logistic."""

    def __init__(self, texts: list[str | None], labels: np.ndarray):
        self.index: dict[bytes, int] = {}
        ones = int(labels.sum())
        self.constant = None if 0 < ones < len(labels) else float(ones > 0)
        if self.constant is not None:
            return
        vocabulary, docs, key = Vocabulary(), [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            w = words(t)
            key[i] = sketch(w)
            docs.append(vocabulary.number(w))
        sets = [np.unique(d) for d in docs]
        # copies are on one side, and count once
        half = key // 7 % 2
        once = np.unique(np.stack([key, labels], axis=1), axis=0, return_index=True)[1]
        n = np.array([len(d) for d in docs], np.int64)
        ends = np.cumsum(n)
        flat = np.zeros((int(n.sum()) + WINDOW, LISTED), np.float32)
        number = np.zeros(len(flat), np.int32)
        for k in (0, 1):
            rows, mine = once[half[once] != k], np.flatnonzero(half == k)
            other = Lexicon(vocabulary, [sets[i] for i in rows], labels[rows])
            needed = np.zeros(len(vocabulary.index), bool)
            for i in mine:
                needed[sets[i]] = True
            values = np.zeros((len(needed), LISTED), np.float32)
            for w, i in vocabulary.index.items():
                if needed[i]:
                    values[i] = other.inputs(w)
            for i in mine:
                flat[ends[i] - n[i] : ends[i]] = values[docs[i]]
                number[ends[i] - n[i] : ends[i]] = docs[i]
        del docs
        self.lexicon = Lexicon(vocabulary, [sets[i] for i in once], labels[once])
        del sets
        self.network, self.vectors = Network(), Vectors()
        self._rows = hashed(list(vocabulary.index))
        doc, first, size = windows(n)
        apart = key // 14 % 5 == 0  # rows for the logistic alone, if they are of both kinds
        if len(np.unique(labels[apart])) < 2:
            apart[:] = False
        learned = ~apart[doc]
        self._train(flat, number, doc[learned], first[learned], size[learned], labels)
        held = apart[doc] if apart.any() else learned
        best = self._best(self._logits(flat, number, first[held], size[held]), doc[held], len(n))
        used = np.isfinite(best)
        self.slope, self.shift = self._logistic(best[used], labels[used])
        del self._rows

    def _table(self) -> np.ndarray:
        """Vectors of all words of the training rows."""
        word, gram, n = self._rows
        ends, parts = np.append(0, np.cumsum(n)), []
        for k in range(0, len(word), 1 << 14):
            end = min(k + (1 << 14), len(word))
            parts.append(self.vectors.of(word[k:end], gram[ends[k] : ends[end]], n[k:end]))
        return np.concatenate(parts) if parts else np.zeros((1, 2 * VECTOR), np.float32)

    def _logits(self, flat: np.ndarray, number: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        step, table, parts = np.arange(WINDOW)[:, None], self._table(), []
        for k in range(0, len(first), CHUNK):
            at = np.minimum(first[k : k + CHUNK] + step, len(flat) - 1)
            x = np.concatenate([table[number[at]], flat[at]], axis=2)
            parts.append(self.network.forward(x, step < size[k : k + CHUNK]))
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    @staticmethod
    def _best(logits: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, -np.inf)
        np.maximum.at(out, doc, logits)
        return out

    def _train(self, flat: np.ndarray, number: np.ndarray, doc: np.ndarray, first: np.ndarray, size: np.ndarray, labels: np.ndarray) -> None:
        rng, net, step = np.random.default_rng(1), self.network, 0
        place = np.arange(WINDOW)[:, None]
        word, gram, grams = self._rows
        ends = np.append(0, np.cumsum(grams))
        total = np.append(0, np.cumsum(flat.sum(axis=1), dtype=np.float64))
        rank = total[first + size] - total[first]  # at first: the sum of what is listed
        m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
        epoch = 0
        while epoch < EPOCHS or step < STEPS:
            epoch += 1
            order = np.lexsort((-rank, doc))
            top = order[np.append(True, doc[order][1:] != doc[order][:-1])]
            positive = top[labels[doc[top]] == 1]
            clean = np.flatnonzero(labels[doc] == 0)
            hard = top[labels[doc[top]] == 0]
            negative = np.concatenate([hard, rng.choice(clean, min(len(clean), NEGATIVES * len(positive)), replace=False)])
            chosen = np.concatenate([np.repeat(positive, max(1, len(hard) // (4 * max(1, len(positive))))), negative])
            rng.shuffle(chosen)
            for k in range(0, len(chosen), BATCH):
                part = chosen[k : k + BATCH]
                at, live = np.minimum(first[part] + place, len(flat) - 1), place < size[part]
                used, inner = np.unique(number[at], return_inverse=True)
                inner = inner.reshape(at.shape)
                mine = gram[ragged(ends[used], grams[used])]
                own = self.vectors.of(word[used], mine, grams[used])
                kept = (rng.random((*at.shape, 2)) >= (LOSE_WORD, LOSE_LIST)).astype(np.float32)
                x = np.concatenate([own[inner], flat[at] * kept[:, :, 1:]], axis=2)
                x[:, :, :VECTOR] *= kept[:, :, :1]
                pull = np.zeros_like(x)
                grads = net.gradients(x, live, labels[doc[part]].astype(np.float32), pull)
                pull[:, :, :VECTOR] *= kept[:, :, :1]
                pull = pull.reshape(-1, INPUTS)
                slope = np.stack([np.bincount(inner.ravel(), pull[:, d], len(used)) for d in range(2 * VECTOR)], axis=1).astype(np.float32)
                self.vectors.step(*self.vectors.pull(word[used], mine, grams[used], slope))
                step += 1
                for name, g in grads.items():  # Adam
                    m1[name] = 0.9 * m1[name] + 0.1 * g
                    m2[name] = 0.999 * m2[name] + 0.001 * g**2
                    net.p[name] -= (LEARNING_RATE * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if epoch % RANKED == 0:  # seldom, and late at first: until then the list's sums choose better windows
                rank = self._logits(flat, number, first, size)

    @staticmethod
    def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Slope and shift of a logistic of ``m``, by Newton steps that never raise the loss, with a light penalty."""
        mean, scale = m.mean(), max(float(m.std()), 1e-6)
        x, beta, far = np.stack([(m - mean) / scale, np.ones_like(m)], axis=1), np.zeros(2), np.array([1.0, 0.0])

        def loss(b: np.ndarray) -> float:
            return float(np.logaddexp(0, x @ b).sum() - y @ (x @ b) + 0.05 * ((b - far) ** 2).sum())

        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
            step, size = np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * (beta - far)), 1.0
            while size > 1e-6 and loss(beta + size * step) > loss(beta):
                size /= 2
            beta = beta + size * step
        slope = max(beta[0] / scale, 1e-3)
        return float(slope), float(beta[1] - slope * mean)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of label 1."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if len(self.index) > MAX_WORDS or not self.index:
            self.index, self.inputs = {b"": 0}, np.zeros((1 << 16, INPUTS), np.float32)
        index, numbers, n, fresh = self.index, [], np.zeros(len(texts), np.int64), []
        for i, t in enumerate(texts):
            w = words(t)
            n[i] = len(w)
            at = np.fromiter(map(index.get, w, repeat(-1)), np.int64, len(w))
            for k in np.flatnonzero(at < 0).tolist():
                got = index.get(w[k])
                if got is None:
                    got = index[w[k]] = len(index)
                    fresh.append(w[k])
                at[k] = got
            numbers.append(at)
        self._add(fresh)
        flat = self.inputs[np.concatenate([*numbers, np.zeros(WINDOW, np.int64)])]
        doc, first, size = windows(n)
        logits = [
            self.network.forward(flat[np.minimum(first[k : k + CHUNK] + STEPS_OF, len(flat) - 1)], STEPS_OF < size[k : k + CHUNK])
            for k in range(0, len(first), CHUNK)
        ]
        best = self._best(np.concatenate(logits), doc, len(texts)) if logits else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -30, 30)))

    def _add(self, fresh: list[bytes]) -> None:
        """Inputs of the last words of the index."""
        if not fresh:
            return
        begin = len(self.index) - len(fresh)
        while len(self.index) > len(self.inputs):
            self.inputs = np.concatenate([self.inputs, np.zeros_like(self.inputs)])
        self.inputs[begin : len(self.index), : 2 * VECTOR] = self.vectors.of(*hashed(fresh))
        self.inputs[begin : len(self.index), 2 * VECTOR :] = [self.lexicon.inputs(w) for w in fresh]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"index": {}, "inputs": None}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Toxicity:
    """Fit on at most ``bound`` labels outside fold 0 with at most ``most_bytes`` of text, in order of the ids' hashes."""
    rows = labelled(docs, labels, label, bound)
    order = F.xxhash64("doc_id")
    with scratch():
        rows = keep(rows.withColumn("order", order), "labelled")  # bounded by ``bound`` rows
        sizes = sorted(rows.select("order", "doc_id", "label", F.octet_length("text")).collect(), key=lambda r: r[:3])
        fits = [r for r, total in zip(sizes, accumulate(r[3] for r in sizes), strict=True) if total <= most_bytes]
        if not fits:
            return Toxicity([], np.zeros(0, np.int64))
        rows = rows.filter(F.col("order") <= fits[-1][0])
        return pickle.loads(rows.select("doc_id", "label", "text").coalesce(1).mapInArrow(_fit, "model binary").first()[0])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training in one task, which is bounded by the sample, and not on the driver, which others need."""
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:2])
    model = Toxicity([r[2] for r in rows], np.array([r[1] for r in rows], np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def score(docs: DataFrame, model: Toxicity, text: str = "text", column: str = "score", drop_text: bool = False) -> DataFrame:
    """Add the score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    out = docs.drop(column)
    fields = [f for f in out.schema.fields if not (drop_text and f.name == text)]
    place = out.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place, 2 << 20):
            batch = replace_column(batch, column, pa.array(sent.value.score(batch.column(place).to_pylist()), pa.float64()))
            yield batch.drop_columns([text]) if drop_text else batch

    return map_texts(out, run, T.StructType([*fields, T.StructField(column, T.DoubleType())]))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")), drop_text=True)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
