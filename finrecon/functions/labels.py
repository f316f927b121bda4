"""Labels of statement rows: cleaning, similarity and classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Words that join a label to the one before it, and remarks that end one.
OPERATORS = "less|add|plus|minus|of which|including|total of"
REMARKS = r"\s*\((?:net|gross|refer note[^)]*|note[^)]*|in [^)]*|[ivx]+|[a-z])\)\s*$"


def clean(label: Column) -> Column:
    """Trim, one space between words, no leading bullets or numbering."""
    return F.regexp_replace(F.trim(F.regexp_replace(label, r"\s+", " ")), r"^(?:[•·*–—-]|\(?[ivx]{1,4}\)|\(?[a-z]\)|\d{1,2}[.)])\s*", "")


def without_operator(label: Column) -> Column:
    return F.regexp_replace(label, rf"(?i)^\s*(?:{OPERATORS})\s*[:.-]?\s+", "")


def without_remarks(label: Column) -> Column:
    return F.regexp_replace(label, f"(?i){REMARKS}", "")


def normal(label: Column) -> Column:
    """Lower case, operator, remarks and marks removed."""
    core = F.lower(without_remarks(without_operator(clean(label))))
    return F.trim(F.regexp_replace(core, r"[^a-z0-9]+", " "))


def tokens(label: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal(label), " "), lambda t: F.length(t) > 1))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def overlap_score(a: Column, b: Column) -> Column:
    """The larger of jaccard and 0.7 x containment, the latter for three tokens or more on both sides."""
    wide = (F.size(a) >= 3) & (F.size(b) >= 3)
    return F.greatest(jaccard(a, b), F.when(wide, 0.7 * containment(a, b)).otherwise(0.0))


def trigrams(label: Column) -> Column:
    t = F.concat(F.lit(" "), normal(label), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))


def trigram_cosine(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.sqrt(F.size(x) * F.size(y))


def variants(label: Column) -> Column:
    """Forms of a label in singular and plural, and without an expense or cost ending."""
    n = normal(label)
    return F.array_distinct(F.array(n, F.regexp_replace(n, "s$", ""), F.concat(n, F.lit("s")), F.regexp_replace(n, " (?:expenses?|costs?)$", ""), F.regexp_replace(n, "ies$", "y")))


def first_pattern(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The name of the first (name, pattern) rule that the text matches."""
    chain = F
    for name, pattern in rules:
        chain = chain.when(text.rlike(pattern), name)
    return chain.otherwise(F.lit(None))
