"""Quality and toxicity: held-out accuracy, the model's parts, and odd rows."""

import zlib

import numpy as np
import pytest

from tessera.llm import quality, toxicity
from tessera.llm.labelled import labelled
from tessera.llm.leaks import words


def held_out(spark, module, label, sf_dir="/root/testdata/sf0.1"):
    got = {r.doc_id: r for r in module.query(spark, sf_dir).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    rows = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert len(rows) > 500
    return sum(p == y for p, y in rows) / len(rows), rows


def test_quality_on_held_out_rows(spark):
    assert held_out(spark, quality, "quality")[0] > 0.98


def test_toxicity_on_held_out_rows(spark):
    accuracy, rows = held_out(spark, toxicity, "toxic")
    assert accuracy > 0.96 and sum(p and y for p, y in rows) > 0.85 * sum(y for _, y in rows)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.Additive(x, y)
    assert m.pairs[0] == (1, 0) and ((m.score(x) > 0.5) == y).mean() > 0.97
    row = x[:1]
    by_hand = m.base + sum(t[np.searchsorted(e, v, "right")] for t, e, v in zip(m.tables, m.edges, row[0], strict=True))
    b = [int(np.searchsorted(e, v, "right")) for e, v in zip(m.edges, row[0], strict=True)]
    by_hand += sum(t[m.coarse[i][b[i]], m.coarse[j][b[j]]] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
    assert m.score(row)[0] == pytest.approx(1 / (1 + np.exp(-by_hand)))


def test_tree_finds_the_best_cut():
    assert quality._tree(np.array([1.0, 1, -1, -1]), np.ones(4), 1, 2).tolist() == [2 / 3, 2 / 3, -2 / 3, -2 / 3]


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, live = rng.standard_normal((5, 3, toxicity.INPUTS)), np.arange(5)[:, None] < np.array([5, 2, 0])
    y = np.array([1.0, 0, 1])

    def loss():
        p = toxicity.sigmoid(net.forward(x, live))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in net.gradients(x, live, y).items():
        for k in rng.choice(g.size, min(5, g.size), replace=False):
            flat, e = net.p[name].ravel(), 1e-2
            old = flat[k]
            flat[k] = old + e
            up = loss()
            flat[k] = old - e
            down = loss()
            flat[k] = old
            assert g.ravel()[k] == pytest.approx((up - down) / (2 * e), abs=2e-3), name


def test_gradients_reach_vectors_of_words_and_grams():
    rng = np.random.default_rng(1)
    net, vectors = toxicity.Network(), toxicity.Vectors()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vectors.word, vectors.gram = vectors.word.astype(np.float64), vectors.gram.astype(np.float64)
    found = [b"one", b"another", b"x", b"\xc3\xa9t\xc3\xa9"]
    rows, inner = toxicity.hashed(found), rng.integers(0, 4, (5, 3))
    live, y = np.arange(5)[:, None] < np.array([5, 2, 4]), np.array([1.0, 0, 1])
    listed = rng.standard_normal((5, 3, toxicity.LISTED))

    def inputs():
        mean, at = [], 0
        for n in rows[2]:
            mean.append(vectors.gram[rows[1][at : at + n]].mean(axis=0))
            at += n
        return np.concatenate([np.concatenate([vectors.word[rows[0]], mean], axis=1)[inner], listed], axis=2)

    def loss():
        p = toxicity.sigmoid(net.forward(inputs(), live))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    pull = np.zeros((5, 3, toxicity.INPUTS))
    net.gradients(inputs(), live, y, pull)
    slope = np.stack([pull[inner == k].sum(axis=0) if (inner == k).any() else np.zeros(toxicity.INPUTS) for k in range(4)])
    of_word, of_gram = vectors.pull(*rows, slope[:, : 2 * toxicity.VECTOR])
    for table, g, row in ((vectors.word, of_word, rows[0][0]), (vectors.gram, of_gram, rows[1][1]), (vectors.gram, of_gram, rows[1][-1])):
        for d in range(toxicity.VECTOR):
            old, e = table[row, d], 1e-3
            table[row, d] = old + e
            up = loss()
            table[row, d] = old - e
            down = loss()
            table[row, d] = old
            assert g[row, d] == pytest.approx((up - down) / (2 * e), abs=1e-5)


def plain_score(m, text):
    """A text's score, number by number."""
    w = words(text)
    starts = sorted({min(k * toxicity.STRIDE, max(0, len(w) - toxicity.WINDOW)) for k in range(max(1, -(-(len(w) - toxicity.WINDOW) // toxicity.STRIDE) + 1))})
    p = {k: v.astype(np.float64) for k, v in m.network.p.items()}
    s = lambda x: 1 / (1 + np.exp(-x))

    def inputs(word):
        row, grams, _ = toxicity.hashed([word])
        return np.concatenate([m.vectors.word[row[0]], m.vectors.gram[grams].mean(axis=0), m.lexicon.inputs(word)])

    def read(rows, d):
        h, out = np.zeros(toxicity.HIDDEN), []
        for x in rows:
            a, u = x @ p["W" + d] + p["b" + d], h @ p["U" + d]
            H = toxicity.HIDDEN
            z, r = s(a[:H] + u[:H]), s(a[H : 2 * H] + u[H : 2 * H])
            h = (1 - z) * np.tanh(a[2 * H :] + r * u[2 * H :]) + z * h
            out.append(h)
        return out

    best = -np.inf
    for at in starts:
        rows = [inputs(x) for x in w[at : at + toxicity.WINDOW]]
        if not rows:
            best = max(best, float(p["c"][0]))
            continue
        h = np.array([np.concatenate(x) for x in zip(read(rows, "f"), read(rows[::-1], "b")[::-1], strict=True)])
        e = np.tanh(h @ p["A"]) @ p["a"]
        e = np.exp(e - e.max())
        best = max(best, float((e / e.sum()) @ h @ p["o"] + p["c"][0]))
    return float(s(m.slope * best + m.shift))


@pytest.fixture(scope="module")
def small_model():
    rng = np.random.default_rng(3)
    bad = ["vile", "viler", "vilest", "vilely"]
    text = lambda k: " ".join([*(f"w{i}" for i in rng.integers(0, 300, 40)), *(rng.choice(bad, 3) if k % 3 == 0 else []), *(f"w{i}" for i in rng.integers(0, 300, 9))])
    return toxicity.Toxicity([text(k) for k in range(300)], np.array([k % 3 == 0 for k in range(300)], np.int64))


def test_scores_against_a_plain_network(small_model):
    texts = ["", "one", "Vile words here", " ".join(f"w{k}" for k in range(33)), " ".join(f"w{k % 50}" for k in range(120)) + " vilely vile vilest ", "été é"]
    got = small_model.score(texts)
    assert got == pytest.approx([plain_score(small_model, t) for t in texts], abs=1e-4) and got[4] > 0.5 > got[3]


def test_it_learns_without_the_list(small_model):
    class Nothing:
        def inputs(self, word):
            return (0.0,) * toxicity.LISTED

    calm = " ".join(f"w{k}" for k in range(40))
    texts = [calm, f"{calm} vile vilest viler"]
    listed, small_model.lexicon, small_model.index = small_model.lexicon, Nothing(), {}
    try:
        calm, bad = small_model.score(texts)
    finally:
        small_model.lexicon, small_model.index = listed, {}
    assert bad > calm + 0.2


def plain_features(text):
    """The values of ``quality.NAMES``, letter by letter."""
    raw, n = text.encode(), len(text.encode())
    share = lambda chars: sum(b < 128 and chr(b) in chars for b in raw) / max(1, n)
    upper, lower = (sum(a <= b <= z for b in raw) for a, z in ((65, 90), (97, 122)))
    w, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    entropy = -sum(raw.count(b) / n * np.log2(raw.count(b) / n) for b in set(raw)) if n else 0.0
    return [
        np.log1p(n), np.log1p(len(w)), upper / max(1, upper + lower), share("0123456789"), share("#$%&*@^~<>{}[]\\_=+`"), share("!"), share("|"),
        share(".,;:?'\"()-"), share("\t\x0b\x0c\r "), share("\n"), sum(b > 127 for b in raw) / max(1, n), n / max(1, len(w)), len(set(w)) / max(1, len(w)),
        len(set(lines)) / max(1, len(lines)), sum(x[-1:] in [bytes([b]) for b in b"#$%&*@|!"] for x in w) / max(1, len(w)),
        sum(x.isupper() for x in w) / max(1, len(w)), entropy,
    ]


def test_quality_scores_against_sums_by_hand(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    m, texts = quality.train(docs, labels), {r.doc_id: r.text for r in docs.collect()}
    for r in quality.query(spark, sf_dir).collect():
        x = plain_features(texts[r.doc_id] or "")
        assert quality.features(texts[r.doc_id]) == pytest.approx(x)
        x = quality.features(texts[r.doc_id])
        at = [sum(v >= e for e in edges) for v, edges in zip(x, m.edges, strict=True)]
        total = m.base + sum(t[k] for t, k in zip(m.tables, at, strict=True)) + sum(t[m.coarse[i][at[i]], m.coarse[j][at[j]]] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
        assert r.score == pytest.approx(1 / (1 + np.exp(-total))) and r.predicted == (r.score >= 0.3)


@pytest.mark.parametrize("sizes", [[0], [1], [24], [25], [40, 0, 41], [1000]])
def test_windows_cover_every_word(sizes):
    n = np.array(sizes)
    doc, first, size = toxicity.windows(n)
    start = np.cumsum(n) - n
    for k, m in enumerate(sizes):
        seen = set()
        for f, s in zip(first[doc == k], size[doc == k], strict=True):
            assert start[k] <= f and f + s <= start[k] + m
            seen |= set(range(f, f + s))
        assert len(seen) == m and (doc == k).any()


@pytest.mark.parametrize("size", [10, 17, 24, 25])
def test_every_passage_lies_whole_in_a_window(size):
    n = np.array([200, 61, 25])
    _, first, length = toxicity.windows(n)
    for start, m in zip((np.cumsum(n) - n).tolist(), n.tolist(), strict=True):
        for at in range(start, start + m - size + 1):
            assert ((first <= at) & (at + size <= first + length)).any(), (at, size)


def test_scores_take_the_highest_window_of_whole_texts():
    good = " ".join(f"word{k % 97}" for k in range(3000))
    texts = [f"some text number {k} here {'idiot fool' if k % 3 == 0 else 'kind folk'} and more" for k in range(240)]
    m = toxicity.Toxicity(texts, np.array([k % 3 == 0 for k in range(240)], np.int64))
    last, none, empty, null = m.score([f"{good} idiot fool", good, "", None])
    assert last > 0.5 > none and empty < 0.5 and null == empty
    flat = [m.lexicon.inputs(w) for w in words(good)]
    assert len(flat) == 3000


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_edges(spark, edge, make, module, label):
    schema = f"doc_id bigint, {label} int"
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 1), (4, 0), (None, 1), (3, None), (7, 9)], schema)
    model = module.train(edge, labels, label)
    out = module.score(edge, model)
    assert out.count() == edge.count() and out.filter("score between 0 and 1").count() == edge.count()
    assert module.score(make([]), model).count() == 0
    none = module.train(edge, labels.limit(0), label)
    assert {r.score for r in module.score(edge, none).select("score").collect()} == {0.5 if module is quality else 0.0}


def test_the_sample_is_bounded_and_outside_the_fold(spark, make):
    docs = make([(k, "x") for k in range(200)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id bigint, quality int")
    got = labelled(docs, labels, "quality", 50).collect()
    assert len(got) == 50 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)
