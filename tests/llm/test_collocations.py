"""Collocations against counting all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from finrecon.llm import collocations as co
from finrecon.llm import textarrays as ta

SCHEMA = "doc_id long, text string, lang string, words string, phrase string, n string"


def brute(rows, words, least, covered, top):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for i in range(len(ws)):
                for k in range(1, words + 1):
                    if i + k <= len(ws):
                        f[lang][tuple(ws[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in candidates.items():
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            hidden = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items())
            if not hidden:
                rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return out


def corpus(seed, many):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Über", "日本", "x" * 90, "y" * 90]
    rows = []
    for i in range(many):
        text = " ".join(vocabulary[min(int(draw.expovariate(0.15)), len(vocabulary) - 1)] + draw.choice(["", "", "", "", ",", ".", "\n", "!", "\t"]) for _ in range(draw.randint(0, 60)))
        rows.append((text + (" Hot hot HOT hot." if i % 2 else ""), draw.choice(["en", "en", "en", "de", None, "und", ""])))
    return [*rows, (None, "en"), ("", None), (" \t\n", "de"), (". , ;", "en"), ("a b c " * 40, "fr"), rows[3], rows[3]]


@pytest.mark.parametrize("budget, words", [(2_000_000, 3), (200, 3), (7, 3), (50, 4), (50, 2)])
def test_collocations_equal_counting_all_phrases(spark, budget, words):
    rows = corpus(1, 120)
    docs = spark.createDataFrame([(i, t, l, "clash", "clash", "clash") for i, (t, l) in enumerate(rows)], SCHEMA).repartition(5)
    found = co.collocations(docs, words=words, least=4, covered=50, top=50, budget=budget)
    assert {tuple(r) for r in found.collect()} == brute(rows, words, 4, 50, 50)


def test_equal_hashes_of_two_words_start_anew(spark, monkeypatch):
    plain = ta.Words.hashes
    monkeypatch.setattr(co, "in_arrow", in_process(co.in_arrow))
    tried = []

    def colliding(self, key=0):
        tried.append(key)
        return plain(self, key) if key > 1 else np.minimum(plain(self, key), np.uint64(1 << 62))

    monkeypatch.setattr(ta.Words, "hashes", colliding)
    rows = corpus(2, 20)
    docs = spark.createDataFrame([(i, t, l, "", "", "") for i, (t, l) in enumerate(rows)], SCHEMA)
    assert {tuple(r) for r in co.collocations(docs, least=3, top=30).collect()} == brute(rows, 3, 3, 50, 30)
    assert {0, 1, 2} <= set(tried)


def in_process(_):
    """mapInArrow over all rows in the driver, so that a patched hash is the one that is used."""

    def run(df, function, schema):
        batches = [b for b in function(iter(df.toArrow().to_batches()))]
        names = [c.split()[0] for c in schema.split(", ")]
        return df.sparkSession.createDataFrame([tuple(r[n] for n in names) for b in batches for r in b.to_pylist()], schema)

    return run


def test_blocks_give_back_their_leaves():
    draw = np.random.default_rng(3)
    for depth in (1, 2, 3, 4):
        columns, counts = co.leaves([draw.integers(1 if k == 0 else 0, 6, 300).astype(np.uint64) for k in range(depth)])
        again, n = co.unpacked(co.packed(columns, counts))
        assert all(np.array_equal(a, b) for a, b in zip(columns, again, strict=True)) and np.array_equal(n, counts) and n.sum() == 300


def test_filter_holds_all_frequent_words(spark):
    hashes = np.random.default_rng(4).integers(-(1 << 63), (1 << 63) - 1, 5000)
    words = spark.createDataFrame([(int(h), 10 if i % 2 else 1) for i, h in enumerate(hashes)], "h long, n long")
    plan = co.Plan(3, 0, co._frequent_filter(words, 5))
    told = plan.frequent(hashes.view(np.uint64))
    assert told[1::2].all() and told[::2].mean() < 0.2


def test_no_rows(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
