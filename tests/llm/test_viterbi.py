"""Token counts against the tokenizers library's unigram model over the same vocabulary."""

import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tessera.llm import viterbi
from tessera.llm.tokens import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


def library(pieces):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def pieces():
    return viterbi.vocabulary(PATH)


def test_counts_of_documents(spark, sf_dir, pieces):
    count = library(pieces)
    rows = viterbi.query(spark, sf_dir).select("doc_id", "n_tokens").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == {i: count(t) for i, t in texts.items()}


def test_odd_texts_and_ties(pieces):
    count = library(pieces)
    for t in ["", " ", "  a", "a  b ", "▁x ▁▁ y", "é中🙂\n\nfoo\tbar", "<s> </s> <0x0A> <unk>", "́", "aaaaaaa" * 50]:
        assert viterbi.Counter(pieces).count(t)[0] == count(t), repr(t)
    rng = random.Random(0)
    small = [("<unk>", 0.0), *((f"<0x{b:02X}>", -9.0) for b in range(256)), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("bb", -1.5), ("▁a", -3.0)]
    count, own = library(small), viterbi.Counter(small)
    for _ in range(500):
        t = "".join(rng.choices("abc é ", k=rng.randint(0, 12)))
        assert own.count(t)[0] == count(t), repr(t)


def test_edges(edge, make):
    out = viterbi.count_tokens(edge, path=PATH)
    got = {(r.doc_id, r.text): r.n_tokens for r in out.collect()}
    assert got[(1, None)] == 0 and got[(2, "")] == 0 and got[(7, "a")] == 1 and sorted(out.columns) == sorted([*edge.columns, "best_score"])
    assert viterbi.count_tokens(make([]), path=PATH).count() == 0
