"""Vectorised label scorers and the consensus aggregate, as pandas functions; registered for SQL by ``register``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F, types as T

from finrecon.functions.once import once


@F.pandas_udf(T.DoubleType())
def char_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters of two labels."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best character ratio among the common words and each side's common and own words."""
    from difflib import SequenceMatcher

    def ratio(x: str, y: str) -> float:
        return SequenceMatcher(None, x, y, autojunk=False).ratio()

    def score(x: str | None, y: str | None) -> float:
        s, t = set((x or "").lower().split()), set((y or "").lower().split())
        common = " ".join(sorted(s & t))
        one, two = (" ".join(filter(None, [common, " ".join(sorted(k))])) for k in (s - t, t - s))
        return max(ratio(common, one) if common else 0.0, ratio(common, two) if common else 0.0, ratio(one, two))

    return pd.Series([score(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def consensus_value(value: pd.Series, rank: pd.Series) -> float:
    """The upper median of the cluster of values, within 5 percent of its running upper median, that has most members; a group is one key's few sources."""
    clusters: list[list[float]] = []
    for _, v in sorted(zip(-rank, value, strict=True)):
        for c in clusters:
            middle = sorted(c)[len(c) // 2]
            if abs(v - middle) / max(abs(middle), 1.0) <= 0.05:
                c.append(v)
                break
        else:
            clusters.append([v])
    best = max(clusters, key=len)
    return float(sorted(best)[len(best) // 2])


def consensus_of(value: Column, rank: Column) -> Column:
    """The aggregate of consensus_value as a Column: the list of a key's few values is folded where it lies, without Python. A missing value is NaN, as it is there."""
    listed = F.array_sort(F.collect_list(F.struct((-rank).alias("r"), F.coalesce(value.cast("double"), F.lit(float("nan"))).alias("v"))))
    upper = lambda c: F.get(F.array_sort(c), F.floor(F.size(c) / 2).cast("int"))

    def near(v: Column, c: Column) -> Column:
        return once(upper(c), lambda m: F.abs(v - m) / F.greatest(F.abs(m), F.lit(1.0)) <= 0.05)

    def put(clusters: Column, x: Column) -> Column:
        # Place of the first cluster that takes the value, from 1; 0 without any.
        at = F.array_position(F.transform(clusters, lambda c: near(x["v"], c)), F.lit(True))
        return once(at, lambda i: F.when(i == 0, F.concat(clusters, F.array(F.array(x["v"])))).otherwise(F.transform(clusters, lambda c, k: F.when(k == i - 1, F.concat(c, F.array(x["v"]))).otherwise(c))))

    def folded(xs: Column) -> Column:
        clusters = F.aggregate(xs, F.array().cast("array<array<double>>"), put)
        best = F.array_max(F.transform(clusters, lambda c, k: F.struct(F.size(c).alias("n"), (-k).alias("first"), c.alias("c"))))
        return once(best["c"], upper)

    return once(listed, lambda xs: F.when(F.size(xs) == 1, F.get(xs, F.lit(0))["v"]).otherwise(folded(xs)))


def register(spark: SparkSession) -> None:
    for f in (char_ratio, token_set_ratio, consensus_value):
        spark.udf.register(f.func.__name__, f)
