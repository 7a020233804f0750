"""Locally consistent parsing: coin tossing, consistency, and the pairing of neighbours against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import parsing


def brute(rows):
    """Expected columns but the sketches, for distinct ids."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in order]
    after = texts[1:] + texts[:1]
    mark = lambda t: parsing.sketches([t])[0]
    out = []
    for (i, _), t, n in zip(order, texts, after, strict=True):
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        a, b = mark(t), mark(e)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), parsing.as_bytes(a).hex(), parsing.as_bytes(b).hex(), parsing.likeness(a, b), parsing.likeness(a, mark(n))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [2, 1000, 2**40])
def test_labels_are_few_and_neighbours_differ(size):
    rng = np.random.default_rng(size)
    names = rng.integers(0, size, 5000, dtype=np.uint64)
    names = names[np.append(True, names[1:] != names[:-1])]
    first = np.zeros(len(names), bool)
    first[[0, len(names) // 2]] = True
    label = parsing.toss(names, first, 64)
    assert label.max() < 6 and (label[1:] != label[:-1])[~first[1:]].all()
    by_hand = [int(n) for n in names[: len(names) // 2]]
    for _ in range(4):  # 64 bits to labels below 128, 14, 8, 6
        left = [None, *by_hand[:-1]]
        k = [0 if y is None else ((x ^ y) & -(x ^ y)).bit_length() - 1 for x, y in zip(by_hand, left, strict=True)]
        by_hand = [2 * j + (x >> j & 1) for x, j in zip(by_hand, k, strict=True)]
    assert label[: len(by_hand)].tolist() == by_hand


def test_equal_substrings_share_their_interior():
    rng = random.Random(0)
    text = lambda n: "".join(rng.choices("abcdefgh  éü", k=n))
    shared = text(3000)
    sets = []
    for lead in (0, 1, 7, 500):
        names, _ = parsing.signatures([text(lead) + shared + text(200)], 3)
        sets.append(set(names.tolist()))
    common = set.intersection(*sets)
    alone = set(parsing.signatures([shared], 3)[0].tolist())
    assert len(common) > 0.9 * len(alone)


def test_parsing_does_not_depend_on_the_batch():
    rng = random.Random(1)
    texts = ["", "a", "aaaaaaaaaa", "ab" * 50, *("".join(rng.choices("ab c", k=rng.randint(0, 400))) for _ in range(100))]
    assert [s.tolist() for s in parsing.sketches(texts)] == [parsing.sketches([t])[0].tolist() for t in texts]


def test_likeness():
    a = np.arange(10, dtype=np.uint32)
    assert parsing.likeness(a, a) == 1 and parsing.likeness(a, a + 100) == 0 and parsing.likeness(a[:0], a[:0]) == 1 and parsing.likeness(a, a[:0]) == 0
    words = [f"w{i} " for i in np.random.default_rng(0).integers(0, 5000, 3000)]
    x, y = "".join(words), "".join(words[:2000]) + "".join(f"v{i} " for i in range(1000))
    assert abs(parsing.likeness(*parsing.sketches([x, y])) - 2 / 3) < 0.15


@pytest.mark.parametrize("unit", ["Word ", "same line of text here\n", "the quick brown fox "])
def test_repeats_count(unit):
    text = (unit * 2000)[:12000]
    other = " ".join(f"w{k * 7919 % 10007}" for k in range(2000))
    assert abs(parsing.likeness(*parsing.sketches([text, parsing.edited(text, other)])) - 2 / 3) < 0.15


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = parsing.query(spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs)
    assert np.median([r.near_edited for r in got]) > 0.55 and np.median([r.near_next for r in got]) < 0.05


def test_nulls_long_texts_and_lone_rows(make):
    rows = [(None, "last one"), (3, None), (2, ""), (9, "Word " * 30_000), (-1, "é🙂" * 40)]
    assert sorted(map(tuple, parsing.compare_with_next(make(rows)).collect()), key=repr) == brute(rows)
    assert tuple(parsing.compare_with_next(make([(1, "alone in here")])).first())[6] == 1
    assert parsing.compare_with_next(make([])).count() == 0


def test_repeated_rows(edge):
    got = parsing.compare_with_next(edge).collect()
    assert len(got) == edge.count() and len({r.fingerprint for r in got if r.doc_id == 4}) == 2
