"""Other candidates for cells that break a check (V22): rounds of checks and swaps over wide rows, all of it expressions of one pass."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from finrecon.functions import rules
from finrecon.operators.statements import KEY, routed, wide_lines
from finrecon.plans.fixtures import fixture
from finrecon.plans.registry import query

#: Rounds, candidates tried for a cell, and the least difference of one worth trying.
ROUNDS, TRIED, LEAST_CHANGE = 3, 5, 0.5


def retried(wide: DataFrame, candidates: DataFrame, checks: Sequence[tuple] = rules.CHECKS, keys: Sequence[str] = KEY, rounds: int = ROUNDS, tried: int = TRIED) -> DataFrame:
    """wide with, for each concept that a check suspects, its value after the retries and ``<concept>_swaps`` and ``<concept>_flagged``.

    candidates has, for the keys and a concept, its values in order (array cands) and the place of the one in the cell (used, from 1; null if it is none of them). A round takes the checks that fail at its start, in order. The cell of a check
    takes the first of its next tried candidates, other than the one in it and at least LEAST_CHANGE away, with which that check holds given all earlier swaps; without one it is flagged and not tried again. Values, not rows, are swapped,
    so the other checks see them from the next step on. A row's rounds need nothing of other rows: one pass, no shuffle after the candidates have joined."""
    suspects = list(dict.fromkeys(c[3] for c in checks))
    lists = candidates.where(F.col("concept").isin(*suspects)).groupBy(*keys).pivot("concept", suspects).agg(F.first("cands").alias("cands"), F.first("used").alias("used"))
    for name in suspects:
        lists = lists.withColumnsRenamed({f"{name}_cands": f"_{name}_cands", f"{name}_used": f"_{name}_at"})
    now = wide.join(lists, list(keys), "left").withColumns({f"{n}_{x}": v for n in suspects for x, v in (("swaps", F.lit(0)), ("flagged", F.lit(False)))})
    for k in range(rounds):
        failing = {f"_failing_{k}_{i}": F.expr(f"coalesce({routed(c[1])} and {c[5]}, false)") for i, c in enumerate(checks)}
        now = now.withColumns(failing)
        for i, (_, _, _, concept, _, condition, _) in enumerate(checks):
            holds = re.sub(rf"\b{concept}\b", "c.v", condition)
            left = f"slice(filter(transform(coalesce(_{concept}_cands, array()), (v, i) -> struct(v as v, i + 1 as i)), c -> not c.i <=> _{concept}_at), 1, {tried})"
            far = f"c.v is not null and (`{concept}` is null or abs(c.v - `{concept}`) >= {LEAST_CHANGE})"
            go = F.col(f"_failing_{k}_{i}") & ~F.col(f"{concept}_flagged")
            now = now.withColumn("_pick", F.when(go, F.expr(f"get(filter({left}, c -> {far} and not coalesce({holds}, false)), 0)"))).withColumn("_go", go)
            hit = F.col("_pick").isNotNull()
            now = now.withColumns(
                {
                    concept: F.when(hit, F.col("_pick.v")).otherwise(F.col(concept)), f"_{concept}_at": F.when(hit, F.col("_pick.i")).otherwise(F.col(f"_{concept}_at")),
                    f"{concept}_swaps": F.col(f"{concept}_swaps") + hit.cast("int"), f"{concept}_flagged": F.col(f"{concept}_flagged") | (F.col("_go") & ~hit),
                }
            ).drop("_pick", "_go")
        now = now.drop(*failing)
    return now.drop(*(f"_{n}_{x}" for n in suspects for x in ("cands", "at")))


def outcomes(done: DataFrame, checks: Sequence[tuple] = rules.CHECKS, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, concept, value, swaps, flagged) of the cells that were swapped or flagged."""
    suspects = list(dict.fromkeys(c[3] for c in checks))
    cells = F.array(*(F.struct(F.lit(n).alias("concept"), F.col(n).alias("value"), F.col(f"{n}_swaps").alias("swaps"), F.col(f"{n}_flagged").alias("flagged")) for n in suspects))
    return done.select(*keys, F.inline(cells)).where("swaps > 0 or flagged")


@query("v22_retry_rounds")
def v22_rounds(spark, sf_dir):
    """The figures of a company's lines are the candidates of its cells, the largest first."""
    lines, item = fixture(spark, sf_dir, "fx_lines"), fixture(spark, sf_dir, "lineitem")
    at = (F.col("l_orderkey") + 7 * F.col("l_partkey") + 13 * F.col("l_linenumber")) % len(rules.CONCEPTS)
    figures = item.select(F.col("l_suppkey").alias("company_id"), F.year("l_shipdate").cast("int").alias("fy"), F.element_at(F.array(*map(F.lit, rules.CONCEPTS)), (at + 1).cast("int")).alias("concept"), F.col("l_extendedprice").cast("double").alias("v"))
    lists = figures.groupBy("company_id", "fy", "concept").agg(F.sort_array(F.collect_set("v"), asc=False).alias("cands"), F.lit(None).cast("int").alias("used"))
    wide = wide_lines(lines)
    return outcomes(retried(wide, wide.select(*KEY).join(lists, ["company_id", "fy"])))
