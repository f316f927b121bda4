"""One value for many mentions: Spark puts an expression in place of every mention of it, and computes it again for each element inside a lambda."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))
