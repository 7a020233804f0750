"""Exact token ids, word by word.

The tokenizer's normaliser and pre-tokenizer never look across white space, so the ids of a text are those of its
words in a row (words between ASCII white space). Distinct words go through the tokenizers library and their
ids are kept, in a bounded cache per Python worker; texts then become ids by lookups and one gather. Where the tokenizer
ignores case, words differing in it are one, and words with trailing marks are put together from both parts. A full
cache keeps the words that it has, and words beyond it are encoded anew for every few megabytes of text.
"""

from __future__ import annotations

import os
import re
import string
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import ragged

MAX_WORDS = 400_000
CHUNK_BYTES = 4 << 20

#: A word of this form is one or two units of the pre-tokenizer, each of which ends with an end-of-word id.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.!?;:#$%&*|]*)")
MARKS = b",.!?;:#$%&*|"

#: Byte-level models spell the bytes that aren't printable in Latin-1 as the characters from 256 on; a space stays here.
UNPRINTABLE = [*range(33), *range(127, 161), 173]
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(UNPRINTABLE) if b != 32}

#: Texts with these bytes keep their case: special tokens are told by it, and a mark of U+0300 to U+037F may compose with a
#: small letter where it doesn't with a capital. No other UTF-8 sequence contains the last two.
CASED = (b"<|", b"\xcc", b"\xcd")


class WordCache:
    """Texts to ids by the tokenizer file at ``path``; ``max_words`` distinct words are remembered at most."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.max_words = Tokenizer.from_file(path), max_words
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        probe = "the zq état où façade ñandú straße þæð"
        spelt = probe.encode().decode("latin-1").translate(BYTE_LETTERS)
        if self.bare.encode(spelt).ids != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            self.bare = None
        self.index: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        upper, form = string.ascii_uppercase, self.tokenizer.normalizer
        self.folds = form is not None and form.normalize_str(upper) == upper.lower()  # its ids don't depend on the case
        known = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(known.values()) + 1, bool)
        self.ends_word[[i for w, i in known.items() if w.endswith("</w>")]] = True

    def learn(self, unknown: list[bytes]) -> list[bytes]:
        """Add words, with stems and tails that they are made of; returns all that came in.

        A word and its trailing marks are separate units, so "word," has the ids of "word" and those of ",".
        """
        added = []
        for k in range(0, len(unknown), 1 << 14):
            part = unknown[k : k + (1 << 14)]
            plain, odd, tailed, pairs = [], [], [], []
            for w in part:
                if w.isalpha() and w.islower():  # ASCII, the usual case; the same rule as below
                    plain.append(w)
                    continue
                stem = w.rstrip(MARKS)
                if not stem.isalpha():
                    m = SIMPLE.fullmatch(w.decode())
                    stem = m[1].encode() if m else b""
                low = stem if stem.islower() and stem.isalpha() else stem.decode().lower().encode()
                if not stem or len(stem) == len(w) and stem != low:
                    odd.append(w)
                elif len(stem) == len(w):
                    plain.append(w)
                else:
                    tailed.append(w)
                    pairs += (low if self.folds else stem, w[len(stem) :])
            new = [w for w in dict.fromkeys(plain + pairs[::2]) if w not in self.index]
            marks = [w for w in dict.fromkeys(odd + pairs[1::2]) if w not in self.index]
            added += self.add(*self.code(new, marks))
            if tailed:
                at = np.fromiter(map(self.index.__getitem__, pairs), np.int64, len(pairs))
                n = self.lengths[at]
                added += self.add(tailed, self.pool[ragged(self.starts[at], n)], n.reshape(-1, 2).sum(axis=1))
        return added

    def add(self, words: list[bytes], flat: np.ndarray, n: np.ndarray) -> list[bytes]:
        first = len(self.index)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(words) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[first : first + len(words)] = self.used + np.cumsum(n) - n
        self.lengths[first : first + len(words)] = n
        self.used += len(flat)
        self.index.update(zip(words, range(first, first + len(words)), strict=True))
        return words

    def code(self, plain: list[bytes], rest: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words in some order, their ids, and the number of ids of each.

        Plain lower-case words go through the library as one text, which is several times faster than one by one, and
        are told apart by the ids that end words. They need no normaliser or pre-tokenizer, so the tokenizer's model alone
        serves where a probe shows that it is byte-level.
        """
        plain.sort(key=bytes.isascii)
        lines = [b" ".join(plain[k : k + 512]) for k in range(0, len(plain), 512)]
        if self.bare:
            lines = [line.decode() if line.isascii() else line.decode("latin-1").translate(BYTE_LETTERS) for line in lines]
        else:
            lines = [line.decode() for line in lines]
        coded = [np.array(e.ids, np.uint32) for e in (self.bare or self.tokenizer).encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate([*coded, np.zeros(0, np.uint32)])
        stop = np.flatnonzero(self.ends_word[flat]) + 1
        n = np.zeros(0, np.int64)
        if len(stop) == len(plain):
            n = np.diff(stop, prepend=0)
        else:  # a tokenizer without end-of-word ids
            rest, plain, flat = plain + rest, [], flat[:0]
        coded = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)]
        more = np.fromiter(map(len, coded), np.int64, len(coded))
        own = np.fromiter((i for ids in coded for i in ids), np.uint32, int(more.sum()))
        return plain + rest, np.concatenate([flat, own]), np.concatenate([n, more])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each."""
        flat, counts, k = [], [], 0
        while k < len(texts):
            rows, size = [], 0
            while k < len(texts) and (size < CHUNK_BYTES or not rows):
                raw = texts[k].encode()
                rows.append(raw.lower() if self.folds and not any(map(raw.__contains__, CASED)) else raw)
                size += len(raw)
                k += 1
            split = pc.ascii_split_whitespace(pa.array(rows, pa.string()))
            ends = split.offsets.to_numpy()[1:].astype(np.int64)
            n_words = np.diff(ends, prepend=0)
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary.cast(pa.binary()).to_pylist()
            place = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
            missing = np.flatnonzero(place < 0).tolist()
            known, used, added = len(self.index), self.used, []
            if missing:
                lost = [words[i] for i in missing]
                added = self.learn(lost)
                place[missing] = np.fromiter(map(self.index.__getitem__, lost), np.int64, len(lost))
            at = place[coded.indices.to_numpy()]
            n = self.lengths[at]
            flat.append(self.pool[ragged(self.starts[at], n)])
            per = np.concatenate([[0], np.cumsum(n)])
            counts.append(per[ends] - per[ends - n_words])
            if added and len(self.index) > self.max_words:  # full: the words known so far stay, as the common ones come early
                for w in added:
                    del self.index[w]
                assert len(self.index) == known
                self.used = used
        if not flat:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(flat), np.concatenate(counts).astype(np.int64)


_caches: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    """The worker's cache for a tokenizer file."""
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def with_end(flat: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append id ``end`` to every text."""
    out = np.full(len(flat) + len(counts), end, np.uint32)
    stop = np.cumsum(counts + 1) - 1
    keep = np.ones(len(out), bool)
    keep[stop] = False
    out[keep] = flat
    return out, counts + 1
