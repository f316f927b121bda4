"""Toxic passages by maximum-scoring segments, and a calibrated score for each document.

A token's score is its log-odds in toxic against other labelled documents, with a Dirichlet prior whose mass per term follows the term's share of both. Terms are words and
their beginnings of ``PREFIXES`` bytes, so inflected forms share evidence; a word scores as its best significant term, any other word
costs ``DRIFT``. A linear-time scan finds all maximal scoring segments of a text. Its chance level is an extreme-value law, P(best < s) = exp(-K n exp(-lambda s)) for n words.
Both parameters are fitted on labelled documents that are not toxic: lambda solves the Karlin-Altschul equation over the scores of all their words, K is the maximum-likelihood value for their
best segments (documents without a scoring word count as censored at 0). They turn a segment's score and the text's length into bits above chance. Logistic regression on the best and the summed bits
and the share of scoring words gives the score.

Bound: the model is fitted on at most about ``TRAIN_ROWS`` labelled rows (a parameter), drawn by a hash of the id; its terms are all those of LEAST_DOCS or more toxic rows among them.
Scoring reads every text whole and needs no shuffle.

Ids are integers. Defined cases: null and empty texts have no segment and get the score of a text without scoring words; a label for an id given twice counts as toxic if any is;
without both classes the score is the share of toxic labels (0 without labels); repeated rows give a row each; other columns are not read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from finrecon.llm import textarrays as ta
from finrecon.llm.frames import in_arrow, kept, own

PREFIXES = (4, 5, 6)
TRAIN_ROWS = 20_000
LEAST_DOCS, LEAST_Z, LEAST_ODDS, PRIOR = 5, 4.0, 2.0, 0.1
DRIFT, TOP_ODDS = 0.15, 8.0
SIGNIFICANT_BITS = 3.0
#: Bytes that are no letters: all of ASCII but A-Z and a-z.
NO_LETTERS = np.ones(256, bool)
NO_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Model:
    terms: np.ndarray
    odds: np.ndarray
    scale: float
    size: float
    weights: np.ndarray


def _terms(texts: ta.Texts) -> tuple[ta.Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words of the texts, and for each kind of term (index of the word, hash)."""
    words = texts.words(fold=True, separators=NO_LETTERS)
    out = [(np.arange(len(words)), words.hashes())]
    for k in PREFIXES:
        long = np.flatnonzero(words.stop - words.start > k)
        start = words.start[long]
        out.append((long, ta.Words(texts, start, start + k, words.text[long], words.table, words.n).hashes() ^ np.uint64(k)))
    return words, out


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, number of texts that have it) for each piece of a batch."""
    for batch in batches:
        for _, texts in ta.pieces(batch.column(0)):
            words, kinds = _terms(texts)
            once = [np.unique(np.stack([words.text[i].astype(np.uint64), h]), axis=1)[1] for i, h in kinds if len(h)]
            if once:
                term, docs = np.unique(np.concatenate(once), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(docs)], ["term", "docs"])


def _counts(terms: np.ndarray):
    """(toxic, term, occurrences) of the given terms; the term's place is given, and -1 stands for all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, texts in ta.pieces(batch.column(0)):
                words, kinds = _terms(texts)
                label = toxic[first : first + len(texts)]
                keys = [label[words.text] * (len(terms) + 1)]
                for i, h in kinds:
                    place = np.searchsorted(terms, h)
                    found = terms[np.minimum(place, len(terms) - 1)] == h if len(terms) else np.zeros(len(h), bool)
                    keys.append(label[words.text[i[found]]] * (len(terms) + 1) + place[found] + 1)
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key // (len(terms) + 1)), pa.array(key % (len(terms) + 1) - 1), pa.array(n)], ["toxic", "place", "n"])

    return run


def log_odds(y1: np.ndarray, y0: np.ndarray, n1: float, n0: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio and its z-score under the Dirichlet prior of PRIOR * (n1 + n0) pooled words."""
    mass = PRIOR * (n1 + n0)
    a = mass * (y1 + y0 + 1) / (n1 + n0)
    odds = np.log((y1 + a) / (n1 + mass - y1 - a)) - np.log((y0 + a) / (n0 + mass - y0 - a))
    return odds, odds / np.sqrt(1 / (y1 + a) + 1 / (y0 + a))


def maximal_segments(scores: list[float], gaps: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first hit, last hit, score) of hits with the costs of the words before each, in linear time."""
    total, stack = 0.0, []
    for i, (score, gap) in enumerate(zip(scores, gaps, strict=True)):
        total -= gap
        left, first = total, i
        total += score
        right = total
        # stack entries: first hit, last hit, sum before, sum after, place of the last entry with a lower sum before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((first, i, left, right, j))
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - s) for a, b, s, r, _ in stack]


def _scores(texts: ta.Texts, model: Model) -> tuple[ta.Words, np.ndarray]:
    """The words of the texts and the score of each, 0 without a term."""
    words, kinds = _terms(texts)
    score = np.zeros(len(words))
    if len(model.terms):
        for i, h in kinds:
            place = np.minimum(np.searchsorted(model.terms, h), len(model.terms) - 1)
            found = model.terms[place] == h
            np.maximum.at(score, i[found], model.odds[place[found]])
    return words, score


def _segments(texts: ta.Texts, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]], int]]:
    """For each text: its words, its maximal segments as (first byte, byte after, score), and its scoring words."""
    words, score = _scores(texts, model)
    hits = np.flatnonzero(score > 0)
    at = np.searchsorted(words.text[hits], np.arange(len(texts) + 1))
    count = words.counts()
    begin = np.concatenate([[0], np.cumsum(count)])
    for t in range(len(texts)):
        own_hits = hits[at[t] : at[t + 1]]
        if not len(own_hits):
            yield int(count[t]), [], 0
            continue
        gaps = np.diff(own_hits, prepend=begin[t] - 1) - 1
        found = maximal_segments(score[own_hits].tolist(), (gaps * DRIFT).tolist())
        base = texts.offsets[t]
        yield int(count[t]), [(int(words.start[own_hits[a]] - base), int(words.stop[own_hits[b]] - base), s) for a, b, s in found], len(own_hits)


def _passages(texts: ta.Texts, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]], int]]:
    """As _segments, with bits above chance for scores."""
    for n, found, hits in _segments(texts, model):
        chance = log(max(model.size * n, 1e-9))
        yield n, [(a, b, (model.scale * s - chance) / log(2)) for a, b, s in found], hits


def _vector(n: int, spans: list[tuple[int, int, float]], hits: int) -> tuple[float, float, float, float]:
    best = max((b for _, _, b in spans), default=-10.0)
    return 1.0, max(best, -10.0) / 10, log(1 + sum(max(b, 0) for _, _, b in spans)), 10 * hits / (n + 20)


def _vectors(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_vector(*p) for _, texts in ta.pieces(batch.column(0)) for p in _passages(texts, model)]
            columns = np.array(rows).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(columns[:, k]) for k in range(1, 4))], ["toxic", "best", "total", "share"])

    return run


def _word_scores(model: Model):
    """(score, words of that score) for each piece of a batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in ta.pieces(batch.column(0)):
                score, n = np.unique(_scores(texts, model)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(score), pa.array(n)], ["score", "n"])

    return run


def _best_scores(model: Model):
    """(scored, chance): texts with a scoring word, and the sum of n exp(-lambda s) over texts of n words and best score s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in ta.pieces(batch.column(0)):
                best = [(n, max((s for _, _, s in found), default=0.0)) for n, found, _ in _segments(texts, model)]
                total = sum(n * exp(-min(model.scale * s, 700)) for n, s in best)
                yield pa.RecordBatch.from_arrays([pa.array([sum(s > 0 for _, s in best)]), pa.array([total])], ["scored", "chance"])

    return run


def chance_scale(scores: np.ndarray, counts: np.ndarray) -> float:
    """lambda: the positive root of the mean of exp(lambda * score) over words, where words of score 0 count as -DRIFT; the mean score must be negative."""
    value = np.where(scores > 0, scores, -DRIFT)
    share = counts / max(counts.sum(), 1)
    if not (scores > 0).any() or value @ share >= 0:
        return 1.0
    low, high = 1e-6, 50.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if np.exp(np.minimum(x * value, 700)) @ share < 1 else (low, x)
    return low


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """The model learned from the labelled rows; see the module for its bounds."""
    clean = own(labels, id_col, label_col).toDF("doc", "toxic").where("doc is not null and toxic is not null")
    clean = clean.groupBy("doc").agg(F.max("toxic").cast("long").alias("toxic"))
    count = clean.count()
    if count > rows:
        clean = clean.where(F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * rows / count))
    texts = own(docs, id_col, text_col).toDF("doc", "text")
    # The sample has a fixed bound, so it is sent to all tasks.
    sample = kept(texts.join(F.broadcast(clean), "doc").select("text", "toxic"))
    candidates = in_arrow(sample.where("toxic = 1").select("text"), _documents_with, "term long, docs long")
    candidates = candidates.groupBy("term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    found = np.sort(np.array([r["term"] for r in candidates.select("term").collect()], np.int64).view(np.uint64))
    counts = in_arrow(sample, _counts(found), "toxic long, place long, n long").groupBy("toxic", "place").agg(F.sum("n").alias("n")).collect()
    y, n = np.zeros((2, len(found))), np.ones(2)
    for r in counts:
        if r["place"] < 0:
            n[r["toxic"]] = r["n"]
        else:
            y[r["toxic"], r["place"]] = r["n"]
    odds, z = log_odds(y[1], y[0], n[1], n[0])
    good = (z >= LEAST_Z) & (odds >= LEAST_ODDS)
    odds = np.minimum(odds[good], TOP_ODDS)
    model = Model(found[good], odds, 1.0, 0.1, np.zeros(4))
    clean_texts = sample.where("toxic = 0").select("text")
    spread = in_arrow(clean_texts, _word_scores(model), "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    model.scale = chance_scale(np.array([r["score"] for r in spread]), np.array([r["n"] for r in spread], float))
    law = in_arrow(clean_texts, _best_scores(model), "scored long, chance double").agg(F.sum("scored").alias("k"), F.sum("chance").alias("c")).first()
    if law["k"] and law["c"]:
        model.size = law["k"] / law["c"]
    rows_ = in_arrow(sample, _vectors(model), "toxic long, best double, total double, share double").collect()
    toxic = np.array([r["toxic"] for r in rows_], float)
    if len(toxic) and 0 < toxic.mean() < 1:
        model.weights = logistic(np.array([[1.0, r["best"], r["total"], r["share"]] for r in rows_]), toxic)
    else:
        level = min(max(toxic.mean() if len(toxic) else 0.0, 1e-9), 1 - 1e-9)
        model.weights = np.array([log(level / (1 - level)), 0, 0, 0])
    return model


def _score(model: Model, n: int, spans: list[tuple[int, int, float]], hits: int) -> float:
    x = float(np.dot(model.weights, _vector(n, spans, hits)))
    return 1 / (1 + exp(-min(max(x, -30), 30)))


def _scored(model: Model):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, passages = [], []
            for _, texts in ta.pieces(batch.column(1)):
                for i, (n, spans, hits) in enumerate(_passages(texts, model)):
                    score.append(_score(model, n, spans, hits))
                    strong = [s for s in spans if s[2] >= SIGNIFICANT_BITS]
                    raw = texts.bytes_of(i) if strong else b""
                    passages.append([{"start": len(raw[:a].decode("utf-8", "replace")), "end": len(raw[:b].decode("utf-8", "replace")), "bits": bits} for a, b, bits in strong])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, passages (significant segments as code points with their bits) for each row."""
    return in_arrow(own(docs, id_col, text_col), _scored(model), "doc_id long, score double, passages array<struct<start:long,end:long,bits:double>>")


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column for the score of each row, whatever ids it has; a column of that name gives way."""
    rest = docs.drop(name)
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [_score(model, *p[:3]) for _, texts in ta.pieces(batch.column(at)) for p in _passages(texts, model)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, name])

    return in_arrow(rest, run, T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType())]))
