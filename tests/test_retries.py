"""Retry rounds against a plain loop on random statements."""

import random
import re

from finrecon.functions import rules
from finrecon.operators import retries

SUSPECTS = list(dict.fromkeys(c[3] for c in rules.CHECKS))
NAMES = sorted({w for c in rules.CHECKS for w in re.findall(r"[a-z_]+[a-z0-9_]*", f"{c[5]} {c[6] or ''}") if w in rules.CONCEPTS} | set(SUSPECTS))


def holds_false(duck, condition, row):
    """Whether a check fails, by DuckDB on the one row."""
    values = ", ".join(f"{'null' if row[n] is None else row[n]}::double as {n}" for n in NAMES)
    return bool(duck.execute(f"select coalesce({condition}, false) from (select {values})").fetchone()[0])


def plain(duck, sector, row, lists, at):
    row, at, swaps, flagged = dict(row), dict(at), dict.fromkeys(SUSPECTS, 0), dict.fromkeys(SUSPECTS, False)
    own = [c for c in rules.CHECKS if (c[1] or "general") == sector]
    for _ in range(retries.ROUNDS):
        for check in [c for c in own if holds_false(duck, c[5], row)]:
            concept = check[3]
            if flagged[concept]:
                continue
            rest = [(v, i) for i, v in enumerate(lists.get(concept, []), 1) if i != at[concept]][: retries.TRIED]
            pick = next(((v, i) for v, i in rest if v is not None and (row[concept] is None or abs(v - row[concept]) >= 0.5) and not holds_false(duck, check[5], row | {concept: v})), None)
            if pick is None:
                flagged[concept] = True
            else:
                row[concept], at[concept] = pick
                swaps[concept] += 1
    return {(n, row[n], swaps[n], flagged[n]) for n in SUSPECTS if swaps[n] or flagged[n]}


def test_rounds_equal_a_plain_loop(spark):
    import duckdb

    duck, draw = duckdb.connect(), random.Random(3)
    rows, lists, want = [], [], set()
    for company in range(60):
        sector = ("general", "bank", "nbfc", "insurance")[company % 4]
        row = {n: None if draw.random() < 0.1 else float(draw.randint(-20, 120)) for n in NAMES}
        cands = {n: [None if draw.random() < 0.1 else float(draw.randint(-50, 200)) for _ in range(draw.randint(0, 8))] for n in SUSPECTS if draw.random() < 0.9}
        at = dict.fromkeys(SUSPECTS)
        for n, vs in cands.items():
            if vs and draw.random() < 0.5:
                at[n] = draw.randint(1, len(vs))
                row[n] = vs[at[n] - 1]
            lists.append((company, sector, 2020, n, vs, at[n]))
        rows.append((company, sector, 2020, *(row[n] for n in NAMES)))
        want |= {(company, *x) for x in plain(duck, sector, row, cands, at)}
    wide = spark.createDataFrame(rows, "company_id int, sector string, fy int, " + ", ".join(f"{n} double" for n in NAMES))
    candidates = spark.createDataFrame(lists, "company_id int, sector string, fy int, concept string, cands array<double>, used int")
    got = {(r["company_id"], r["concept"], r["value"], r["swaps"], r["flagged"]) for r in retries.outcomes(retries.retried(wide, candidates)).collect()}
    assert got == want and any(s > 0 for *_, s, _ in want) and any(f for *_, f in want)
