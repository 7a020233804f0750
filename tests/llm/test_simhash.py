"""Fingerprints, the Golay tables and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash


def brute_fp(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    all_ = list(root)
    for i, a in enumerate(all_):
        for b in all_[:i]:
            if bin(a ^ b).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("text", ["", "a", "A b", "a b c", "One\ttwo\x0bTHREE four É\xa0x y \x1c z", "the of and " * 400 + "end"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fp(text)


def test_golay_is_perfect_and_segments_two_apart_share_a_codeword():
    g = simhash.Golay()
    weights = np.bitwise_count(g.error)
    assert np.bincount(weights).tolist() == [1, 23, 253, 1771] and len(set(g.error.tolist())) == 2048
    assert ((g.others >= 0).sum(axis=1)[weights == 3] == 5).all()
    rng = np.random.default_rng(0)
    seg = rng.integers(0, 1 << 23, 4000)

    def sets(x):
        rows, idx = g.indices(x)
        out = [set() for _ in x]
        for r, i in zip(rows, idx, strict=True):
            out[r].add(int(i))
        return out

    base = sets(seg)
    for flips in (1, 2):
        e = np.array([sum(1 << int(b) for b in rng.choice(23, flips, replace=False)) for _ in seg])
        assert all(a & b for a, b in zip(base, sets(seg ^ e), strict=True))


def test_tables_hold_every_pair_within_three_bits():
    rng = random.Random(1)
    a = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    b = np.array([int(x) ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for x in a], np.uint64)

    def sets(x):
        rows, keys = simhash.table_keys(x)
        out = [set() for _ in x]
        for r, k in zip(rows, keys, strict=True):
            out[r].add(int(k))
        return out

    assert all(x & y for x, y in zip(sets(a), sets(b), strict=True))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("block", [4096, 7])
def test_components_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng, fps = random.Random(block), [0]
    for _ in range(12):  # chains, and dense balls around a centre
        x = rng.getrandbits(64)
        for k in range(rng.choice([2, 5, 60])):
            y = x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            fps.append(y)
            x = y if k % 3 == 0 else x
    fps += [rng.getrandbits(64) for _ in range(50)] + fps[:5]
    rows = [(i, signed(f)) for i, f in enumerate(fps)] + [(None, 0), (None, signed(12345))]
    got = simhash.components(spark.createDataFrame(rows, "doc_id bigint, fp bigint")).collect()
    comp = brute_components([*fps, 12345])
    lead = {}
    for i, f in enumerate(fps):
        lead[comp[f]] = min(i, lead.get(comp[f], i))
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == lead.get(comp[r.fp % (1 << 64)])


def test_query_and_removal(spark, sf_dir, edge, make):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in simhash.query(spark, sf_dir).collect()}
    fps = {r.doc_id: brute_fp(r.text) for r in docs.collect()}
    comp = brute_components(list(fps.values()))
    lead = {}
    for i, f in fps.items():
        lead[comp[f]] = min(i, lead.get(comp[f], i))
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", lead[comp[f]]) for i, f in fps.items()}
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(lead.values())
    left = simhash.near_dedup(edge)
    want = {brute_fp(r.text) for r in edge.collect()}
    assert left.columns == edge.columns and sorted(brute_fp(r.text) for r in left.collect()) == sorted(want)
    assert simhash.near_dedup(make([])).count() == 0
