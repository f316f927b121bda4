"""Quality of texts by naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model over them.

Tokens are runs of letters and digits (A-Z lower-cased) and runs of other marks; terms are single tokens, pairs of neighbours, and pairs of one word twice in a row (marks between them aside), these without their
word and by number: at least 1, 2, 4 .. of them. Each is an indicator of the text. A term's ratio is
r = log((p / |p|) / (q / |q|)) with p and q the texts of either class that have it, each plus ``SMOOTH``. A text's vector is r where the term is there, brought to unit length, with a constant for the bias. The model minimises
|w|^2 / 2 + C sum max(0, 1 - y w x), C weighted so that both classes weigh the same, by dual coordinate descent; bounds of the dual hold exactly at every step. The weights are then
mixed with their mean size, w' = (1 - ``MIXED``) mean|w| + ``MIXED`` w, as for naive Bayes support vectors. Margins become probabilities by logistic regression on margins of texts that the
model had not seen (``FOLDS`` folds).

Bound: the model is fitted on at most about ``TRAIN_ROWS`` labelled rows (a parameter), drawn by a hash of the id; ratios and folds come from these rows, of which every term with ``LEAST_DOCS`` texts or more is
used. Descent runs in the driver over that bounded sample, which tasks have turned into term numbers. Scoring reads every text whole and needs no shuffle.

Defined cases: null and empty texts have only the bias; an id labelled twice counts as 1 only if all its labels are 1; without both classes the score is the share of label 1 (0 without labels); repeated rows
give a row each; a null id has no label; other columns are not read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from finrecon.llm import textarrays as ta
from finrecon.llm.frames import in_arrow, kept, own

TRAIN_ROWS, LEAST_DOCS, FOLDS = 20_000, 3, 3
SMOOTH, MIXED, COST, BIAS = 1.0, 0.5, 1.0, 1.0
MOST_EPOCHS, CLOSE = 60, 0.01
#: Kinds of bytes: 0 separators, 1 letters, digits and all bytes beyond ASCII, 2 marks.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[ta.SPACES] = 0
#: Terms that stand for 1, 2, 4 .. doubled words, whatever the word.
DOUBLE_STEPS, _DOUBLE = 6, np.uint64(0x8C3D37C819544DA2)


@dataclass
class Model:
    """Sorted hashes of terms; the ratio and the weight of each, the weight of the bias, and slope and start of the probability."""

    terms: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    start: float


def tokens(texts: ta.Texts) -> ta.Words:
    kind = _KIND[texts.data]
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[texts.offsets[:-1][texts.offsets[:-1] < len(kind)]] = True
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(kind))
    inside = kind[begin] > 0
    return ta.Words(texts, begin[inside], end[inside], np.searchsorted(texts.offsets, begin[inside], side="right") - 1, ta.LOWER, len(kind))


def terms(texts: ta.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every occurrence of a token, of a pair of neighbours, and of a step in the number of doubled words."""
    t = tokens(texts)
    h = t.hashes()
    pair = np.flatnonzero(t.text[1:] == t.text[:-1])
    word = np.flatnonzero(_KIND[texts.data[t.start]] == 1)
    double = word[1:][(h[word[1:]] == h[word[:-1]]) & (t.text[word[1:]] == t.text[word[:-1]])]
    n = np.bincount(t.text[double], minlength=len(texts))
    steps = [(np.flatnonzero(n >= 1 << k), k) for k in range(DOUBLE_STEPS)]
    return (
        np.concatenate([t.text, t.text[pair], *(at for at, _ in steps)]),
        np.concatenate([h, ta.mix(h[pair] * np.uint64(0xD6E8FEB86659FD93) + h[pair + 1]), *(np.full(len(at), _DOUBLE + np.uint64(k)) for at, k in steps)]),
    )


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, texts with it, those labelled 1) for each piece of a batch of (text, label)."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, texts in ta.pieces(batch.column(0)):
            text, h = terms(texts)
            which, term = pd.factorize(h)
            once = np.unique(which * len(texts) + text)
            if len(term):
                n = np.bincount(once // len(texts), minlength=len(term))
                ones = np.bincount((once // len(texts))[label[first + once % len(texts)] > 0], minlength=len(term))
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n), pa.array(ones)], ["term", "n", "ones"])


def _found(texts: ta.Texts, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in the vocabulary), each pair once, in order of text."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text, h = terms(texts)
    place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = vocabulary[place] == h
    both = np.unique(text[hit] * len(vocabulary) + place[hit])
    return both // len(vocabulary), both % len(vocabulary)


def _numbered(vocabulary: np.ndarray):
    """(label, term numbers as bytes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, texts in ta.pieces(batch.column(0)):
                text, place = _found(texts, vocabulary)
                cuts = np.searchsorted(text, np.arange(len(texts) + 1))
                rows += [place[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.binary())], ["label", "terms"])

    return run


def ratios_of(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Class log-count ratios of the terms."""
    p, q = ones + SMOOTH, zeros + SMOOTH
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descended(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(w, alpha): dual coordinate descent for the hinge loss over sparse rows; ends when no projected gradient of an epoch exceeds CLOSE, or after MOST_EPOCHS."""
    w, alpha, draw = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(seed)
    square = np.array([v @ v for v in values])
    live = np.flatnonzero(square > 0)
    for _ in range(MOST_EPOCHS):
        worst = 0.0
        for i in draw.permutation(live).tolist():
            at, v, old = rows[i], values[i], alpha[i]
            slope = y[i] * (w[at] @ v) - 1
            inward = min(slope, 0.0) if old <= 0 else max(slope, 0.0) if old >= cost[i] else slope
            if inward == 0:
                continue
            worst = max(worst, abs(inward))
            alpha[i] = min(max(old - slope / square[i], 0.0), cost[i])
            w[at] += (alpha[i] - old) * y[i] * v
        if worst <= CLOSE:
            break
    return w, alpha


def _scaled(rows: list[np.ndarray], ratios: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows with a last column for the bias, and their values."""
    at, values = [], []
    for r in rows:
        v = ratios[r]
        long = np.sqrt(v @ v)
        at.append(np.append(r, len(ratios)))
        values.append(np.append(v / long if long > 0 else v, BIAS))
    return at, values


def trained(rows: list[np.ndarray], label: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(ratios, weights, bias) from rows of term numbers with labels 0 and 1."""
    ones, zeros = (np.bincount(np.concatenate([np.zeros(0, np.int64), *(rows[i] for i in np.flatnonzero(label == c))]), minlength=size).astype(float) for c in (1, 0))
    ratios = ratios_of(ones, zeros)
    at, values = _scaled(rows, ratios)
    share = label.mean()
    w, _ = descended(at, values, np.where(label > 0, 1.0, -1.0), COST * np.where(label > 0, 0.5 / share, 0.5 / (1 - share)), size + 1)
    return ratios, (1 - MIXED) * np.abs(w[:-1]).mean() + MIXED * w[:-1], MIXED * w[-1] * BIAS


def margins(rows: list[np.ndarray], ratios: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    at, values = _scaled(rows, ratios)
    return np.array([weights[a[:-1]] @ v[:-1] + bias for a, v in zip(at, values, strict=True)])


def probability_line(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(slope, start) of the logistic law of the label over the margin, with the smoothed targets that keep separable classes finite."""
    n1, n0 = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.array([0.0, log((n1 + 1) / (n0 + 1))])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - target @ z)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (target - p))
        scale, now = 1.0, loss(w)
        while scale > 1e-6 and loss(w + scale * step) > now:
            scale /= 2
        w = w + scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """The model learned from the labelled rows; see the module for its bounds."""
    clean = own(labels, id_col, label_col).toDF("doc", "label").where("doc is not null and label is not null")
    clean = clean.groupBy("doc").agg(F.min("label").cast("long").alias("label"))
    count = clean.count()
    if count > rows:
        clean = clean.where(F.pmod(F.xxhash64("doc", F.lit(12)), F.lit(1 << 20)) < int((1 << 20) * rows / count))
    # The sample has a fixed bound, so it is sent to all tasks; its rows come in the order of their texts' hashes, so the fit does not hang on partitions.
    sample = kept(own(docs, id_col, text_col).toDF("doc", "text").join(F.broadcast(clean), "doc").select("text", "label").orderBy(F.xxhash64("text"), "label"))
    vocabulary = in_arrow(sample, _class_counts, "term long, n long, ones long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    found = np.sort(vocabulary.select("term").toArrow().column(0).to_numpy().view(np.uint64))
    table = in_arrow(sample, _numbered(found), "label long, terms binary").toArrow()
    label = table.column("label").to_numpy().astype(np.int64)
    if not len(label) or label.min() == label.max():
        share = min(max(label.mean() if len(label) else 0.0, 1e-9), 1 - 1e-9)
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.0, 1.0, log(share / (1 - share)))
    numbered = [np.frombuffer(v.as_buffer(), "<u4").astype(np.int64) for v in table.column("terms")]
    fold, unseen = np.arange(len(label)) % FOLDS, np.full(len(label), np.nan)
    for k in range(FOLDS):
        rest, own_ = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(own_) and 0 < label[rest].mean() < 1:
            unseen[own_] = margins([numbered[i] for i in own_], *trained([numbered[i] for i in rest], label[rest], len(found)))
    told = ~np.isnan(unseen)
    ratios, weights, bias = trained(numbered, label, len(found))
    if not (told.any() and 0 < label[told].mean() < 1):
        told, unseen = np.ones(len(label), bool), margins(numbered, ratios, weights, bias)
    return Model(found, ratios, weights, bias, *probability_line(unseen[told], label[told]))


def scores(texts: ta.Texts, model: Model) -> np.ndarray:
    text, place = _found(texts, model.terms)
    long = np.sqrt(np.bincount(text, weights=model.ratios[place] ** 2, minlength=len(texts)))
    margin = np.bincount(text, weights=model.weights[place] * model.ratios[place], minlength=len(texts)) / np.where(long > 0, long, 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.start, -30, 30)))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [scores(texts, model) for _, texts in ta.pieces(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *parts]))], ["doc_id", "score"])

    return in_arrow(own(docs, id_col, text_col), run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")
