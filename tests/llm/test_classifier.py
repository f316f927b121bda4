"""The quality classifier against direct computation and on held-out documents."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from finrecon.llm import classifier as nb
from finrecon.llm import op12
from finrecon.llm import textarrays as ta

SCHEMA = "doc_id long, text string, quality string, score string, term string, label string, doc string"


def plain_terms(text):
    """Tokens, pairs and steps of doubled words of a text, spelt out."""
    tokens, kind = [], None
    for b in (text or "").encode():
        k = 0 if b in b" \t\n\v\f\r" else 1 if bytes([b]).isalnum() or b > 127 else 2
        if k and k == kind:
            tokens[-1] = (tokens[-1][0] + bytes([b]).lower(), k)
        elif k:
            tokens.append((bytes([b]).lower(), k))
        kind = k
    words = [t for t, k in tokens if k == 1]
    doubled = sum(a == b for a, b in zip(words, words[1:]))
    names = [t for t, _ in tokens]
    return {*names, *zip(names, names[1:]), *(("doubled", k) for k in range(nb.DOUBLE_STEPS) if doubled >= 1 << k)}


TEXTS = ["The cat sat, the cat.", "the the The!! a", "", None, "one", "??", "é É 日本 x1 1x\n\n\tx1", "a. a a, a - a"]


def test_terms_of_texts():
    _, texts = next(ta.pieces(pa.array(TEXTS)))
    text, h = nb.terms(texts)
    for i, t in enumerate(TEXTS):
        assert len(set(h[text == i].tolist())) == len(plain_terms(t))
    # Equal terms of different texts have equal hashes: shared terms are as many.
    for i, s in enumerate(TEXTS):
        for j, t in enumerate(TEXTS):
            assert len(set(h[text == i].tolist()) & set(h[text == j].tolist())) == len(plain_terms(s) & plain_terms(t))


def test_ratios():
    ones, zeros = np.array([3.0, 0.0, 1.0]), np.array([0.0, 5.0, 1.0])
    by_hand = [np.log((4 / 7) / (1 / 9)), np.log((1 / 7) / (6 / 9)), np.log((2 / 7) / (2 / 9))]
    assert np.allclose(nb.ratios_of(ones, zeros), by_hand)


def test_descent_reaches_the_least_loss(monkeypatch):
    """The dual and the primal value meet, and no nearby weights have a lower loss."""
    monkeypatch.setattr(nb, "CLOSE", 1e-6)
    monkeypatch.setattr(nb, "MOST_EPOCHS", 5000)
    draw = np.random.default_rng(0)
    rows = [np.sort(draw.choice(12, draw.integers(1, 6), replace=False)) for _ in range(60)]
    values = [draw.normal(size=len(r)) for r in rows]
    y = np.where(draw.random(60) < 0.4, 1.0, -1.0)
    cost = np.where(y > 0, 1.3, 0.8)
    w, alpha = nb.descended(rows, values, y, cost, 12)
    dense = np.zeros((60, 12))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        dense[i, r] = v

    def loss(w):
        return w @ w / 2 + cost @ np.maximum(0, 1 - y * (dense @ w))

    assert ((alpha >= 0) & (alpha <= cost)).all() and np.allclose(w, (alpha * y) @ dense)
    assert loss(w) - (alpha.sum() - w @ w / 2) < 1e-3
    assert all(loss(w + 0.05 * draw.normal(size=12)) > loss(w) - 1e-6 for _ in range(300))


def test_probability_line_is_the_likeliest():
    draw = np.random.default_rng(1)
    margin = draw.normal(size=400)
    label = (draw.random(400) < 1 / (1 + np.exp(-(2 * margin - 0.5)))).astype(int)
    slope, start = nb.probability_line(margin, label)
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    p = 1 / (1 + np.exp(-(slope * margin + start)))
    assert abs((target - p).sum()) < 1e-3 and abs(((target - p) * margin).sum()) < 1e-3


def test_scores_equal_direct_sums():
    _, texts = next(ta.pieces(pa.array(TEXTS)))
    _, h = nb.terms(texts)
    vocabulary = np.unique(h)[::2]
    draw = np.random.default_rng(2)
    model = nb.Model(vocabulary, draw.normal(size=len(vocabulary)), draw.normal(size=len(vocabulary)), 0.3, 1.7, -0.2)
    got = nb.scores(texts, model)
    for i in range(len(TEXTS)):
        own = np.flatnonzero(np.isin(vocabulary, h[nb.terms(texts)[0] == i]))
        v = model.ratios[own]
        margin = (model.weights[own] @ v / np.sqrt(v @ v) if len(own) else 0) + 0.3
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(1.7 * margin - 0.2))))


def test_op12_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in op12.op12_quality_classifier(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in found.items())
    held = [(found[i]["score"], q) for i, q in labels.items() if found[i]["held_out"]]
    good, poor = [s for s, q in held if q], [s for s, q in held if not q]
    assert sum(a > b for a in good for b in poor) > 0.98 * len(good) * len(poor)
    assert sum(s >= 0.3 for s in good) >= 0.98 * len(good) and sum(s < 0.3 for s in poor) >= 0.8 * len(poor)


def untidy(spark):
    draw = random.Random(5)
    texts = [None, "", " \n", "x" * 40_000, "word " * 20_000, *[" ".join(draw.choice("alpha beta gamma delta".split()) + ("###" if i % 3 == 0 else "") for _ in range(30)) for i in range(40)]]
    rows = [(None if i == 7 else i, t, "clash", "clash", "clash", "clash", "clash") for i, t in enumerate([*texts, texts[9], texts[9]])]
    return spark.createDataFrame([*rows, rows[4]], SCHEMA)


def test_untidy_rows_and_labels(spark):
    docs = untidy(spark)
    labels = spark.createDataFrame([(i, int(i % 3 != 2), "clash") for i in range(5, 45)] + [(None, 1, ""), (8, None, ""), (9, 0, "")], "doc_id long, quality int, text string")
    first = sorted(map(tuple, nb.scored(docs, nb.fitted(docs, labels)).collect()), key=str)
    assert len(first) == docs.count() and all(0 < s < 1 for _, s in first)
    again = docs.repartition(7)
    assert sorted(map(tuple, nb.scored(again, nb.fitted(again, labels)).collect()), key=str) == first
    one = nb.scored(docs, nb.fitted(docs, labels.where("quality = 1")))
    assert {round(r["score"], 6) for r in one.collect()} == {1.0}
    none = nb.scored(docs, nb.fitted(docs, labels.where("false")))
    assert {round(r["score"], 6) for r in none.collect()} == {0.0}
    nothing = spark.createDataFrame([], SCHEMA)
    assert nb.scored(nothing, nb.fitted(nothing, labels)).collect() == []
