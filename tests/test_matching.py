"""Label matching against comparing all pairs."""

import random
from collections import Counter

import pytest

from finrecon.operators import matching as m
from finrecon.operators import setjoins as sj


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def words(s):
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split()
    return set(out)


def grams(s):
    t = f" {s} "
    return {t[i : i + 3] for i in range(max(len(t) - 2, 1))}


def plain_score(a, b):
    if a == b:
        return 1.0
    u, v, g, h = words(a), words(b), grams(a), grams(b)
    jaccard = len(u & v) / max(len(u | v), 1)
    return round(max(jaccard, 1 - levenshtein(a, b) / max(len(a), len(b), 1), len(g & h) / (len(g) * len(h)) ** 0.5), 6)


def vocabulary(seed, n):
    draw = random.Random(seed)
    parts = "alpha beta gamma delta total net gross fee fees gain gains loan loans x y z q1 q2".split()
    return sorted({" ".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) + draw.choice(["", "", "s", " %", "-"]) for _ in range(n)} | {"", "-", "a"})


def labels(spark, names):
    return spark.createDataFrame([(x,) for x in names], "label string")


@pytest.mark.parametrize("least", [0.5, 0.55, 0.72, 0.9])
def test_similarity_is_that_of_all_pairs(spark, least):
    a, b = vocabulary(1, 60), vocabulary(2, 60)
    got = {(r["a"], r["b"]): r["score"] for r in m.similarity(labels(spark, a), labels(spark, b), least).collect()}
    assert got == {(x, y): s for x in a for y in b if (s := plain_score(x, y)) >= least}


def test_a_word_on_fifty_thousand_labels(spark, monkeypatch):
    """No pair is lost to a frequent word; its labels are dealt over several tasks."""
    monkeypatch.setattr(sj, "DEALT", 1000)
    many = [f"expenditure x{i}" for i in range(50_000)]
    asked = ["expenditure y77", "expenditure x41", "expenditure", "x49999", "other line"]
    got = Counter(r["a"] for r in m.similarity(labels(spark, asked), labels(spark, many), 0.72).collect())
    expected = Counter(a for a in asked for b in many if abs(len(a) - len(b)) <= 8 and plain_score(a, b) >= 0.72)
    assert got == expected and got["expenditure y77"] > 4000


def test_lookup_and_cascade_are_those_of_all_pairs(spark):
    a, b = vocabulary(3, 40), vocabulary(4, 40)
    got = {r["label"]: (r["matched"], r["score"]) for r in m.lookup(labels(spark, a).selectExpr("label", "1 as fy"), labels(spark, b).selectExpr("label", "1 as fy")).collect()}

    def content(s):
        return {w for w in "".join(c if "a" <= c <= "z" else " " for c in s).split() if w not in m.STOP}

    def close(x, y):
        return 1.0 if x == y else 0.85 if x in y or y in x else round(1 - levenshtein(x, y) / max(len(x), len(y), 1), 6)

    for x in a:
        best = min(((-close(x, y), y) for y in b), default=None)
        share = min(((-round(len(content(x) & content(y)) / max(len(content(x)), 1), 6), y) for y in b))
        if x == "" or any(y == "" for y in [best[1]]):
            continue
        want = (best[1], -best[0]) if -best[0] >= 0.7 else (share[1], -share[0]) if -share[0] >= 0.5 else (None, None)
        assert got[x] == want

    def token_set(x, y):
        u, v = sorted(words(x)), sorted(words(y))
        both = [w for w in u if w in v]
        t0, t1, t2 = " ".join(both), " ".join(both + [w for w in u if w not in both]), " ".join(both + [w for w in v if w not in both])
        r = lambda p, q: 1 - levenshtein(p, q) / max(len(p), len(q), 1)
        return round(max(r(t0, t1) if both else 0, r(t0, t2) if both else 0, r(t1, t2)), 6)

    tiers = {r["pool_label"]: (r["template_label"], r["tier"], r["score"]) for r in m.cascade(labels(spark, a), labels(spark, b)).collect()}
    for x in a:
        if not words(x):
            continue
        near = [y for y in b if 0.25 * len(y) <= len(x) <= 4 * len(y)] or b
        score, best = min((-token_set(x, y), y) for y in near if words(y))
        want = (x, 1, 1.0) if x in b else (best, 3, -score) if -score >= 0.75 else None
        assert tiers.get(x) == want


def test_assignment_against_a_plain_loop(spark):
    draw = random.Random(5)
    names = ["total assets", "current assets", "total debt", "long debt", "cash", "net sales"]
    rows = [(c, t, draw.randint(0, 3), f"p{draw.randint(0, 5)} {draw.choice(['assets', 'debt', 'cash'])}", round(draw.random(), 2), float(draw.randint(1, 1000))) for c in range(4) for t in names for _ in range(4)]
    rows = list({(r[0], r[1], r[3]): (r[0], r[1], names.index(r[1]) % 3, *r[3:]) for r in rows}.values())
    found = m.assigned(spark.createDataFrame(rows, "company_id long, template_label string, tier int, pool_label string, score double, value double"))
    want = set()
    for c in range(4):
        used, totals = set(), []
        for tier, t in sorted({(r[2], r[1]) for r in rows if r[0] == c}):
            own = sorted((-r[4], r[3], r[5]) for r in rows if r[0] == c and r[1] == t and r[3] not in used)
            if not own:
                continue
            _, pool, value = own[0]
            key = set(t.split())
            if "total" in key:
                totals.append((key - {"total"}, value))
            elif any(key & k and value > 1.05 * v for k, v in totals):
                continue
            used.add(pool)
            want.add((c, t, pool))
    assert {tuple(r) for r in found.collect()} == want


def test_every_pair_has_a_score(spark):
    """No score is too small for a row, and the stored vocabulary reads its table once."""
    left = spark.createDataFrame([("zzz qqq",), ("net sales",), ("finance costs",)], "label string")
    right = spark.createDataFrame([("revenue from operations",), ("finance costs",), ("tax",)], "label string")
    got = {(r["a"], r["b"]): r["score"] for r in m.all_similarities(left, right).collect()}
    assert len(got) == 9 and min(got.values()) < 0.5
    assert got["finance costs", "finance costs"] == 1.0 and got["net sales", "revenue from operations"] == 0.95
    kept = {(r["a"], r["b"]): r["score"] for r in m.similarity(left, right, 0.5).collect()}
    assert kept == {k: s for k, s in got.items() if s >= 0.5}
