"""Exact joins of labels by the overlap of their tokens, without comparing all pairs.

A measure asks that two labels share tokens of some total weight, a bound that follows from each label alone. All labels sort their tokens by one global order, rarest first; the tokens left after a label's prefix weigh less than
its bound, so a pair that reaches the measure shares a token of the prefixes. Labels meet on those tokens only, so a word that most labels have brings together only labels in which no rarer word can decide. No token is left out and no
number of partners is capped. A token of many labels is dealt over several tasks: the right side by the label's hash, the left side to each of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Labels of a token on the right in one task.
DEALT = 20_000


@dataclass(frozen=True)
class Overlap:
    """Tokens of a label (an array of strings; equal ones count each), and for either side the least weight that a partner shares, from its tokens and the label; None if a side gives no bound.
    weight is that of a token, 1 if None."""

    tokens: Callable[[Column], Column]
    left: Callable[[Column, Column], Column] | None
    right: Callable[[Column, Column], Column] | None
    weight: Callable[[Column], Column] | None = None


def grams(label: Column, size: int) -> Column:
    """All character runs of that size, with size - 1 blanks on each side."""
    t = F.concat(F.lit("\1" * (size - 1)), label, F.lit("\1" * (size - 1)))
    return F.when(F.length(t) >= size, F.transform(F.sequence(F.lit(1), F.length(t) - size + 1), lambda i: F.substring(t, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def edits_within(least: float) -> Overlap:
    """Labels whose share of characters that need no edit is at least least. Strings at k edits share all but k q of their q-grams; of the longer one these are length + q - 1."""
    q = 2 if least > 0.5 else 1
    need = lambda ts, label: F.length(label) * (1 - q * (1 - least)) + (q - 1)
    return Overlap(lambda label: grams(label, q), need, need)


def meeting(left: DataFrame, right: DataFrame, measures: Sequence[Overlap]) -> DataFrame:
    """(a, b): the pairs of labels (column label, distinct) that may reach any of the measures, each pair once. A label without tokens of a measure meets none by it."""
    a, b = (_tokens(side, measures) for side in (left, right))
    rows = a.select("kind", F.explode("ts").alias("t"), F.lit(0).alias("r")).unionByName(b.select("kind", F.explode("ts").alias("t"), F.lit(1).alias("r")))
    counts = rows.groupBy("kind", "t").agg(F.count("*").alias("n"), F.sum("r").alias("r"))
    x = _prefixes(a, counts, [m.left for m in measures], [m.weight for m in measures]).select(F.col("label").alias("a"), "kind", F.col("ts").alias("xs"), F.explode("ts").alias("k"))
    y = _prefixes(b, counts, [m.right for m in measures], [m.weight for m in measures]).select(F.col("label").alias("b"), "kind", F.col("ts").alias("ys"), F.explode("ts").alias("k"))
    shares = F.greatest(F.ceil(F.col("k")["r"] / DEALT).cast("int"), F.lit(1))
    x = x.select("a", "kind", "xs", F.col("k")["t"].alias("t"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    y = y.select("b", "kind", "ys", F.col("k")["t"].alias("t"), F.pmod(F.hash("b"), shares).alias("share"))
    # The first common token of both prefixes, which are in the global order, stands for the pair.
    both = x.join(y, ["kind", "t", "share"]).where(F.element_at(F.array_intersect("xs", "ys"), 1)["t"] == F.col("t"))
    return both.select("a", "b").distinct() if len(measures) > 1 else both.select("a", "b")


def _tokens(side: DataFrame, measures: Sequence[Overlap]) -> DataFrame:
    """label, kind (number of the measure), ts: the tokens, each with the number of equal ones before it."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.array_sort(m.tokens(F.col("label"))).alias("ps")) for k, m in enumerate(measures)))
    parts = side.select("label", F.inline(kinds))
    again = F.transform("ps", lambda x, i: F.concat(x, F.lit("\0"), (i - F.array_position("ps", x) + 1).cast("string")))
    return parts.where(F.size("ps") > 0).select("label", "kind", again.alias("ts"))


def _by_kind(values: list[Column]) -> Column:
    out = F.when(F.col("kind") == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(F.col("kind") == k, v)
    return out


def _prefixes(side: DataFrame, counts: DataFrame, needs: list, weights: list) -> DataFrame:
    """label, kind, ts: the tokens (n, t, r) in the global order, as far as the rest outweighs the bound."""
    met = side.select("label", "kind", F.explode("ts").alias("t")).join(counts, ["kind", "t"])
    met = met.groupBy("label", "kind").agg(F.array_sort(F.collect_list(F.struct("n", "t", "r"))).alias("ts"))
    ts, plain = F.col("ts"), F.transform("ts", lambda t: F.element_at(F.split(t["t"], "\0"), 1))
    bounds = [F.lit(0.0) if need is None else need(plain, F.col("label")) - 1e-6 for need in needs]
    ends = [F.size(ts) if need is None else F.floor(F.size(ts) - bound).cast("int") + 1 for need, bound in zip(needs, bounds, strict=True)]
    slices = F.slice(ts, F.lit(1), F.greatest(F.least(_by_kind(ends), F.size(ts)), F.lit(0)))
    if not any(weights):
        return met.select("label", "kind", slices.alias("ts"))
    # Weighed measures have few tokens: those whose rest, themselves included, reaches the bound.
    met = met.withColumn("bound", _by_kind(bounds))
    weighed = [slices if w is None else _outweighing(ts, plain, w) for w in weights]
    return met.select("label", "kind", _by_kind(weighed).alias("ts"))


def _outweighing(ts: Column, plain: Column, weight: Callable) -> Column:
    rest = lambda i: F.aggregate(F.slice(plain, i + 1, F.size(ts)), F.lit(0.0), lambda s, t: s + weight(t))
    return F.filter(ts, lambda t, i: rest(i) >= F.col("bound"))
