"""Suffix-array decontamination against a search by brute force."""

import hashlib
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pytest

from tessera.llm import catalog, leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, window=8):
    out = []
    for i, t in docs:
        w = WORD.findall(lower(t))
        hit, ids = set(), set()
        for item, text in items:
            v = WORD.findall(lower(text))
            n = min(window, len(v))
            for k in range(len(v) - n + 1) if n else []:
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit.update(range(p, p + n))
                        ids.add(str(item) if item is not None else "")
        ids = sorted(ids)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids) >= 2))
    return sorted(out, key=repr)


def run(spark, docs, items, tmp_path, monkeypatch):
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return sorted(map(tuple, leaks.query(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize("words", [3, 40])
def test_against_brute_force(spark, tmp_path, monkeypatch, words):
    rng = random.Random(words)
    vocab = [f"w{k}" for k in range(words)]
    text = lambda lo, hi: " ".join(rng.choice(vocab) + rng.choice(["", ",", "!X"]) for _ in range(rng.randint(lo, hi)))
    items = [(k, text(0, 14)) for k in range(20)] + [(3, "w1 W2"), (None, "w0 w1 w2"), (77, None), (78, "é w1")]
    docs = [(k, text(0, 60)) for k in range(40)] + [(1, None), (2, ""), (None, items[0][1])]
    docs += [(100 + k, f"foreign {text(0, 5)} {items[k][1]} {items[k + 1][1]} words") for k in range(12)]
    assert run(spark, docs, items, tmp_path, monkeypatch) == brute(docs, items)


def test_blocks_of_the_benchmark_agree(spark):
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choices(vocab, k=12))) for k in range(12)]
    docs = [(k, " ".join(rng.choices(vocab, k=20)) + " " + items[k % 12][1] + " x " + items[k % 5][1]) for k in range(20)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    key = lambda df: sorted((r.doc_id, r.leak.n_words, r.leak.n_hit, sorted(map(tuple, r.leak.matches))) for r in df.collect())
    assert key(leaks.find_leaks(d, b)) == key(leaks.find_leaks(d, b, block_bytes=40))


def test_longest_match_and_location(spark):
    item = " ".join(f"k{i}" for i in range(20))
    d = spark.createDataFrame([(1, "a b " + " ".join(f"k{i}" for i in range(3, 17)) + " c")], "doc_id bigint, text string")
    b = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    assert [tuple(m) for m in leaks.find_leaks(d, b).first().leak.matches] == [("9", 3, 2, 14)]


def test_edges_and_removal(spark, edge, make):
    b = spark.createDataFrame([(1, "no id here"), (2, "")], "item_id bigint, text string")
    kept = leaks.decontaminate(edge, b)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 1
    assert leaks.find_leaks(make([]), b).count() == 0
    assert leaks.find_leaks(edge, b.limit(0)).filter("leak.n_hit > 0").count() == 0


def test_repeats_take_room_for_longest_matches_only():
    tests = leaks.Tests([("a", "x " * 500)], 8)
    docs = np.concatenate([np.full(20_000, 1, np.int32), np.zeros(9, np.int32)])
    tracemalloc.start()
    at, item, n, _ = tests.search(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(at) == 19_993 + 492 and n.max() == 500 and peak < 20e6


def test_query_against_its_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    got, want = leaks.query(spark, sf_dir), con.sql(catalog.oracle_sql()["op1_benchmark_decontamination"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
