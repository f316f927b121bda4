"""URL filters as a sort-merge range join.

A host is reversed into its canonical key, ``www.example.org`` into ``org.example.www.``, so a host with all subdomains is a prefix of keys, and thus an interval of
the sorted order. Distinct (host, path) pairs are cut into ranges at sampled keys; a rule goes to each range that its interval meets. Within a
range, urls and rules are swept in key order with a stack of the rule hosts that are open at the key: intervals are nested, so closing ones leave
from the top. The paths of one rule host are kept by length, so the longest fitting path is found from the longest length down.

A url that occurs in any number of rows is swept once; the join back to the rows lets Spark split a frequent one. The cut keys come from a sample of at most about
``MOST_SAMPLES`` keys and affect only how even the ranges are. Beyond ``MOST_CUTS`` ranges each is dealt over folds by a hash, every fold with the range's rules, so a group
holds about ``URLS_PER_RANGE`` urls however many there are.

Defined cases: a null url or one without ``://`` has an empty host and path, which only an empty rule host would fit; the longest rule, host and path together, wins, and of
equally long ones the first in order of host, path and verdict; rules with a null host or path are left out; equal urls in several rows get equal verdicts; other columns
are not read; without rules every url gets the default verdict; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from finrecon.llm.frames import kept, own
from finrecon.plans.shipping import shipped

LEAST_CUTS, MOST_CUTS, URLS_PER_RANGE = 255, 20_000, 100_000
SAMPLE_PER_CUT, MOST_SAMPLES = 40, 160_000
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ? or #."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def sweep(key: list[str], path: list[str], rules: list[tuple[str, str, str, str]]) -> list[tuple[str | None, str | None]]:
    """(rule, verdict) for each (key, path), sorted by key; rules are (key, path, rule, verdict) with keys that are prefixes of those."""
    by_host: dict[str, dict[int, dict[str, tuple[str, str]]]] = {}
    for k, p, rule, verdict in sorted(rules):
        by_host.setdefault(k, {}).setdefault(len(p), {}).setdefault(p, (rule, verdict))
    hosts = sorted(by_host)
    lengths = {k: sorted(by_host[k], reverse=True) for k in hosts}
    stack: list[str] = []
    out, at = [], 0
    for k, p in zip(key, path, strict=True):
        while at < len(hosts) and hosts[at] <= k:
            while stack and not hosts[at].startswith(stack[-1]):
                stack.pop()
            stack.append(hosts[at])
            at += 1
        while stack and not k.startswith(stack[-1]):
            stack.pop()
        best: tuple[int, str, str] | None = None
        for h in reversed(stack):
            for n in lengths[h]:
                if best and len(h) + n <= best[0]:
                    break
                found = by_host[h][n].get(p[:n]) if n <= len(p) else None
                if found:
                    best = (len(h) + n, *found)
                    break
        out.append(best[1:] if best else (None, None))
    return out


def _swept(key: tuple, urls: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
    urls = urls.sort_values(["key", "path"])
    found = sweep(urls["key"].tolist(), urls["path"].tolist(), list(rules[["key", "path", "rule", "verdict"]].itertuples(index=False, name=None)))
    return pd.DataFrame({"host": urls["host"].tolist(), "path": urls["path"].tolist(), "rule": [f[0] for f in found], "verdict": [f[1] for f in found]}, dtype=object)


def _range_of(cuts: list[str]):
    @F.pandas_udf("int")
    def place(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in keys:
            yield k.map(lambda x: bisect_right(cuts, x)).astype("int32")

    return place


def _ranges_of(cuts: list[str]):
    @F.pandas_udf("array<int>")
    def places(lows: pd.Series) -> pd.Series:
        # The interval of a prefix ends before the prefix with its last character, a dot, raised to the next one.
        return lows.map(lambda x: list(range(bisect_right(cuts, x), bisect_left(cuts, x[:-1] + "/" if x else "\U0010ffff") + 1)))

    return places


def filtered(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for each row. rules: (host, path, verdict)."""
    shipped(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rows = own(pages, id_col, url_col).toDF("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    urls = kept(rows.groupBy("host", "path").agg(F.count("*").alias("pages")).withColumn("key", host_key(F.col("host"))))
    total = urls.count()
    ranges = min(max(LEAST_CUTS, total // URLS_PER_RANGE), MOST_CUTS)
    folds = max(1, -(-total // (ranges * URLS_PER_RANGE)))
    per_cut = min(SAMPLE_PER_CUT, MOST_SAMPLES // ranges)
    some = urls.select("host", "path", "key").where(F.pmod(F.xxhash64("host", "path"), F.lit(1 << 40)) < (1 << 40) * ranges * per_cut / max(total, 1))
    # Equal keys are cut apart by the path, so that one host may fill several ranges.
    sample = sorted(f"{r['key']}\0{r['path']}" for r in some.collect())
    step = max(len(sample) // ranges, 1)
    cuts = sample[step - 1 :: step]
    whole = F.concat(F.col("key"), F.lit("\0"), F.col("path"))
    placed = urls.select("host", "path", "key", _range_of(cuts)(whole).alias("range"), F.pmod(F.xxhash64("host", "path"), F.lit(folds)).alias("fold"))
    named = own(rules, "host", "path", "verdict").where("host is not null and path is not null")
    spread = named.select(host_key(F.translate("host", _UPPER, _LOWER)).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")
    spread = spread.withColumn("range", F.explode(_ranges_of(cuts)(F.col("key"))))
    spread = spread.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long"))))
    found = placed.groupBy("range", "fold").cogroup(spread.groupBy("range", "fold")).applyInPandas(_swept, "host string, path string, rule string, verdict string")
    met = rows.join(found, ["host", "path"], "left")
    return met.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
