"""Packing: ids, pieces, gapless sequences, and few of them."""

import collections
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.tokens import WordCache, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
ODD = ["", "It's  the END\x1c<|endoftext|> of <|startoftext|>a", "Ünḯ J̌ ΑΣ ΑΣ. İstanbul ﬁ", "1234 ##a## 中文 🙂🙂", "\n\n\t", "don't we'LL\x85x y"]


def ids_of(text, end=0):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, end]


def test_words_give_the_ids_of_whole_texts(spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    tok, cache = Tokenizer.from_file(PATH), WordCache(PATH, max_words=3000)
    for part in (texts[:50], texts[50:], texts[:20]):  # the cache is emptied in between
        flat, counts = cache.encode(part)
        want = [tok.encode(t, add_special_tokens=False).ids for t in part]
        assert counts.tolist() == list(map(len, want)) and flat.tolist() == [i for w in want for i in w]


def valid(rows, capacity):
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= capacity
    return len(seqs)


@pytest.mark.parametrize("most", [400_000, 3])
def test_case_marks_and_special_tokens(most):
    cache, library = WordCache(PATH, most), Tokenizer.from_file(PATH)
    cases = ["", " ", "\ta  b\n", "Word word WORD, word,!", "École école ÉCOLE, ß, ÿ.", "<|ENDOFTEXT|> A <|endoftext|>, B", "a.b,, 10#, K9 --,", "don't DON'T,", "ΑΣ, İx ﬁ, A\u030a", "\u3000x\u2028y\x1cz"]
    ids, counts = cache.encode(cases + cases[::-1])
    at = 0
    for text, n in zip(cases + cases[::-1], counts, strict=True):
        assert ids[at : at + n].tolist() == library.encode(text, add_special_tokens=False).ids, text
        at += n


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_valid_and_tight(seed):
    rng = np.random.default_rng(seed)
    capacity = [30, 100, 257, 2048][seed]
    counts = np.zeros(capacity + 1, np.int64)
    for n in rng.integers(1, capacity + 1, 400) if seed % 2 else (rng.geometric(0.05, 600) % capacity + 1):
        counts[n] += 1
    plan = packing.Plan(counts, capacity)
    bins = collections.defaultdict(list)
    for n, places in plan.places.items():
        ranks = []
        for low, high, first, each, offset in places:
            for r in range(low, high):
                bins[first + (r - low) // each].append((offset + (r - low) % each * n, n))
                ranks.append(r)
        assert sorted(ranks) == list(range(counts[n]))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity and sum(n > capacity // 3 for _, n in items) <= 2
    total = int((counts * np.arange(capacity + 1)).sum())
    # best-fit decreasing, piece by piece
    room = []
    for n in range(capacity, 0, -1):
        for _ in range(counts[n]):
            fit = min((g for g in room if g >= n), default=None)
            if fit is None:
                room.append(capacity - n)
            else:
                room.remove(fit)
                room.append(fit - n)
    assert len(bins) == plan.sequences and -(-total // capacity) <= plan.sequences <= len(room) + 2


def test_pieces_against_the_tokenizer(spark, edge, make):
    rows = packing.pack(edge, path=PATH, capacity=64).collect()
    assert valid(rows, 64) == len({r.sequence_id for r in rows})
    want = collections.Counter()
    for r in edge.collect():
        ids = ids_of(r.text)
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[(r.doc_id, k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    assert packing.pack(make([]), path=PATH).count() == 0


def test_many_of_one_length(make):
    rng = random.Random(0)
    docs = make([(k, "hi " * (30 if k % 3 else rng.randint(0, 90))) for k in range(600)])
    rows = packing.pack(docs, path=PATH, capacity=100).collect()
    assert len(rows) >= 600 and valid(rows, 100)
