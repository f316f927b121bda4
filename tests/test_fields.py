"""Fields of labels against trying all patterns in order."""

import random
import re

from finrecon.functions.fields import SECTION_FIELDS, literal_of
from finrecon.operators import fields as op
from finrecon.plans.fixtures import WORDING


def plain(label, fields):
    return next((name for name, patterns in fields for p in patterns if re.search(p, (label or "").strip(), re.IGNORECASE)), None)


def test_literals_are_in_every_match():
    assert literal_of(r"provisions?\s+non.current") == "provision" and literal_of(r"(?:a|b)c+") == "" and literal_of(r"\bmsme\b") == "msme"
    assert sum(bool(literal_of(p)) for f in SECTION_FIELDS.values() for _, ps in f for p in ps) > 150


def labels():
    draw = random.Random(6)
    out = {*WORDING["label"], *WORDING["line"], "", None, "  Goodwill on impairment", "goodwill on consolidation", "Income tax assets", "Other expenses income", "Cash and bank balances other", "Borrowings current assets"}
    for table in SECTION_FIELDS.values():
        for name, patterns in table:
            out.add(name)
            for p in patterns:
                # Spell the pattern with its optional parts kept, then left out.
                for keep in (True, False):
                    s = re.sub(r"\(\?!.*?\)+$", "", p)
                    s = re.sub(r"\(\?:((?:[^()]|\\[()])*)\)\?", lambda m: m[1].split("|")[0] if keep else "", s)
                    s = re.sub(r"\(\?:((?:[^()]|\\[()])*)\)", lambda m: draw.choice(m[1].split("|")), s)
                    s = re.sub(r"\\b|\^", "", s).replace(r"\s+", " ").replace(r"\s*", "").replace(".*", " of the ").replace("[sz]", draw.choice("sz"))
                    s = re.sub(r"(\\?.)\?", r"\1" if keep else "", s).replace("\\", "").replace("work.in", "work-in").replace("in.", "in-")
                    out |= {s, s.upper(), f"Total {s} net", f"{s} assets", f"non-current {s}"}
    return sorted(out, key=str)


def test_fields_equal_all_patterns_in_order(spark):
    names, own = labels(), {"bank": {"Annual P&L": (("Interest earned", (r"interest\s+earned", r"interest income")), ("Any", (r"(?:a|e)",)))}}
    rows = [(x, s, c) for x in names for s in (*SECTION_FIELDS, "Other") for c in ("bank", "manufacturing", None)]
    got = {(r["label"], r["section"], r["sector"]): r["field"] for r in op.labelled_fields(spark.createDataFrame(rows, "label string, section string, sector string"), sectors=own).collect()}
    want = {(x, s, c): plain(x, own["bank"][s] if c == "bank" and s in own["bank"] else SECTION_FIELDS.get(s, ())) for x, s, c in rows}
    assert got == want
    assert {f for (_, s, c), f in got.items() if c is None and s in SECTION_FIELDS} >= {n for t in SECTION_FIELDS.values() for n, _ in t}
