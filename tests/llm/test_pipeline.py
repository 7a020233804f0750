"""The pipeline's stages, each on its own input and all in a row."""

import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

import corpus_pipeline as cp
from tessera.llm import common, leaks, secrets
from tessera.llm.common import keep

from test_leaks import brute as brute_leaks
from test_packing import ids_of, valid
from test_secrets import base
from test_simhash import brute_components, brute_fp


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in cp.STAGES:
        docs = keep(stage(spark, docs, sf_dir), "stage")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_keeps_most_and_drops_marked_ones(spark, sf_dir, stages):
    kept, labels = rows(stages[0]), rows(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert np.mean([i in kept for i, r in labels.items() if r.quality == 1]) > 0.95
    assert np.mean([i in kept for i, r in labels.items() if r.quality == 0]) < 0.3


def test_near_dedup_keeps_the_first_of_each_component(stages):
    before, after = rows(stages[0]), rows(stages[1])
    fps = {i: brute_fp(r.text) for i, r in before.items()}
    comp, lead = brute_components(list(fps.values())), {}
    for i, f in fps.items():
        lead[comp[f]] = min(i, lead.get(comp[f], i))
    assert after == {i: before[i] for i in lead.values()} and len(after) < len(before)


def test_leaks_are_removed(spark, sf_dir, stages):
    before, after = rows(stages[1]), rows(stages[2])
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    wanted = {tuple(leaks.words(t)[k : k + 8]) for _, t in items for k in range(max(1, len(leaks.words(t)) - 7))}
    clean = {i for i, r in before.items() if not any(tuple(leaks.words(r.text)[k : k + 8]) in wanted for k in range(len(leaks.words(r.text))))}
    assert after == {i: before[i] for i in clean} and len(after) < len(before) and brute_leaks([], items) == []


def test_secrets_are_masked_and_the_rest_stays(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert before.keys() == after.keys() and any(base(r.text) for r in before.values())
    for i, r in after.items():
        assert not [s for s in base(r.text) if s[1] > 0]
        assert r == before[i] or "[SECRET]" in r.text and r.n_chars == len(r.text)
        if not base(before[i].text):
            assert "[SECRET]" not in r.text


def test_pieces_hold_the_ids_of_what_is_left(stages):
    got, want = stages[4].collect(), Counter()
    for r in stages[3].collect():
        ids = ids_of(r.text)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(r.doc_id, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want and valid(got, 2048) >= sum(r.length for r in got) / 2048


def test_columns_and_run(spark, sf_dir, stages):
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").dtypes
    assert all(s.dtypes == names for s in stages[:4])
    key = lambda df: Counter(tuple(r)[:5] for r in df.collect())
    assert key(cp.run(spark, sf_dir)) == key(stages[4])


def test_only_the_tables_of_the_result_stay(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    out = cp.run(spark, sf_dir)
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["base", "pieces"] and out.count()


def test_extra_columns_come_through_unchanged(spark, sf_dir, edge):
    docs = edge
    for _, stage in cp.STAGES[:3]:
        docs = keep(stage(spark, docs, sf_dir), "stage")
    extra = [c for c in edge.columns if c not in ("doc_id", "text", "n_chars")]
    masked = cp.STAGES[3][1](spark, docs, sf_dir)
    for df in (docs, masked):
        assert df.dtypes == edge.dtypes and {str(r) for r in df.select(extra).collect()} == {str(r) for r in edge.select(extra).collect()}


def test_a_cluster_needs_a_shared_folder(spark):
    here = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="local[4]"))
    assert common.shared_dir(here).startswith("file:") and common.shared_dir(spark)
    here.sparkContext.master = "spark://far:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(here)


def test_edges(spark, sf_dir, edge, make):
    for docs in (edge, make([])):
        for k, (_, stage) in enumerate(cp.STAGES):
            docs = keep(stage(spark, docs, sf_dir), "stage")
            assert k == 4 or docs.columns == edge.columns
        docs.count()
    assert secrets.KINDS[3] == "random"
