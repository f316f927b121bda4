"""Matching of labels: cascade (J3), one-to-one assignment (J8), cluster similarity (L9, J9), pool lookup (J10).

Labels are matched as a vocabulary, once for each distinct one. Each measure finds its pairs by ``setjoins`` or by a shared cluster, so results are those of comparing all pairs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from finrecon.operators.joins import top
from finrecon.operators.setjoins import Overlap, edits_within, grams, meeting
from finrecon.operators.statements import LABELS
from finrecon.operators.texts import quoted
from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query
from finrecon.plans.stored import stored

# Clusters of terms for one line, and words too general to stand for a cluster.
CLUSTERS = (
    ("net sales", "net revenue", "revenue from operations", "total revenue", "total income from operations", "sales", "turnover", "operating revenue", "revenue", "total income", "gross income", "income from operations"),
    ("other income", "non-operating income", "other operating income", "other revenues", "miscellaneous income", "non interest income", "non-interest income"),
    ("interest earned", "interest income", "total interest income", "interest and similar income", "income from advances", "interest on advances"),
    ("interest expended", "interest paid", "interest expense", "interest and finance charges", "finance costs", "interest"),
    ("net interest income", "nii", "net interest margin income", "net interest earned"),
    ("profit before tax", "pbt", "profit before taxation", "earnings before tax", "ebt", "pre-tax profit", "profit / (loss) before tax", "profit/(loss) before tax"),
    ("profit after tax", "pat", "net income", "net profit", "profit for the year", "profit for the period", "net earnings"),
)
GENERIC = ("expenses", "income", "profit", "loss", "assets", "liabilities", "capital", "interest", "tax", "revenue", "sales", "earnings", "provisions", "advances", "deposits", "investments", "borrowings", "reserves", "equity", "debt", "cost", "costs", "margin")
TERMS = tuple((t, i) for i, cluster in enumerate(CLUSTERS) for t in cluster)
TERMS_SQL = "terms(term, cluster) as (values " + ", ".join(f"({quoted(t)}, {i})" for t, i in TERMS) + ")"
TEMPLATE_SQL = "template(label) as (values " + ", ".join(f"({quoted(x)})" for _, x in LABELS) + ")"
#: Labels in lower case without signs beyond ASCII.
KEY_SQL = "lower(trim(regexp_replace(label, '[^ -~]', '', 'g')))"
POOL_SQL = f"pool as (select distinct {KEY_SQL} as label from fx_raw_label)"


#: A label stands for a cluster in part: it and a term differ by an ending of at most three letters, or one holds the other as whole words and the inner one has 60 percent of the length.
def _partial(bound: str) -> str:
    inner = "(contains({a}, {b}) and length({b}) >= {n} and length({b}) >= 0.6 * length({a}) and " + bound + ")"
    return (
        f"length(label) >= 4 and label not in ({', '.join(map(quoted, GENERIC))}) and (case when {{starts}}(term, label) then length(term) - length(label) <= 3"
        " when {starts}(label, term) and length(term) >= 4 then length(label) - length(term) <= 3 else " + inner.format(a="label", b="term", n=4) + " or " + inner.format(a="term", b="label", n=5) + " end)"
    )


#: Whole words: no letter or digit on either side of the inner text.
_WHOLE = "regexp_replace(concat(' ', {a}, ' '), '[^a-z0-9]', ' '{{g}}) like concat('% ', regexp_replace({b}, '[^a-z0-9]', ' '{{g}}), ' %')"
PARTIAL = _partial(_WHOLE)


def clustered(labels: DataFrame, terms: Sequence[tuple[str, int]] = TERMS) -> DataFrame:
    """(label, exact, partial): the cluster that has the label as a term, and the clusters that it stands for in part."""
    table = F.broadcast(labels.sparkSession.createDataFrame(list(terms), "term string, cluster int"))  # written by hand
    exact = labels.join(table, F.col("label") == F.col("term")).groupBy("label").agg(F.min("cluster").alias("exact"))
    near = labels.join(table, F.expr(PARTIAL.format(starts="startswith", g=""))).groupBy("label").agg(F.array_sort(F.collect_set("cluster")).alias("partial"))
    return labels.join(exact, "label", "left").join(near, "label", "left").withColumn("partial", F.coalesce("partial", F.array().cast("array<int>")))


def words(label: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(label), "[^a-z0-9]+"), lambda w: w != ""))


def trigrams(label: Column) -> Column:
    t = F.concat(F.lit(" "), label, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))


def ratio(a: Column, b: Column) -> Column:
    """Share of characters that need no edit."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def of_one_cluster(x: DataFrame, y: DataFrame) -> DataFrame:
    """(a, b, score) of clustered labels: 0.95 for terms of one cluster, 0.88 for labels that stand in part for a common one."""
    same = x.select(F.col("label").alias("a"), "exact").join(y.select(F.col("label").alias("b"), "exact"), "exact").select("a", "b", F.lit(0.95).alias("score"))
    part = lambda v, c: v.select(F.col("label").alias(c), F.explode("partial").alias("cluster"))
    near = part(x, "a").join(part(y, "b"), "cluster").select("a", "b", F.lit(0.88).alias("score"))
    return same.union(near).groupBy("a", "b").agg(F.max("score").alias("score"))


def similarity(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of all labels with a score of at least least: 1 equal, 0.95 one cluster, 0.88 one cluster in part, else the best of word overlap, character ratio and trigram cosine."""
    share = lambda by: lambda ts, label: F.size(ts) * by
    measures = (Overlap(words, share(least), share(least)), Overlap(trigrams, share(least**2), share(least**2)), edits_within(least - 1e-6))
    met = meeting(left, right, measures)
    u, v, g, h = words(F.col("a")), words(F.col("b")), trigrams(F.col("a")), trigrams(F.col("b"))
    jaccard = F.size(F.array_intersect(u, v)) / F.greatest(F.size(F.array_union(u, v)), F.lit(1))
    cosine = F.size(F.array_intersect(g, h)) / F.sqrt(F.size(g) * F.size(h))
    plain = met.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.round(F.greatest(jaccard, ratio(F.col("a"), F.col("b")), cosine), 6)).alias("score"))
    clusters = of_one_cluster(clustered(left), clustered(right)).withColumn("clustered", F.lit(True))
    both = plain.withColumn("clustered", F.lit(False)).unionByName(clusters).where(F.col("score") >= least)
    # Equal labels come first, then a cluster decides.
    best = F.max_by("score", F.struct(F.col("a") == F.col("b"), "clustered", "score"))
    scored = both.groupBy("a", "b").agg(best.alias("score"))
    return scored.withColumn("score", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("score")))


def all_similarities(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, score) of every label with every label of right, a list written by hand, whatever the score."""
    x, y = (side.select("label", "exact", "partial", words(F.col("label")).alias("ws"), trigrams(F.col("label")).alias("gs")) for side in (clustered(left), clustered(right)))
    x, y = x.toDF("a", "ea", "pa", "u", "g"), F.broadcast(y.toDF("b", "eb", "pb", "v", "h"))
    both = F.size(F.array_intersect("u", "v"))
    jaccard = both / F.greatest(F.size("u") + F.size("v") - both, F.lit(1))
    cosine = F.size(F.array_intersect("g", "h")) / F.sqrt(F.size("g") * F.size("h"))
    plain = F.round(F.greatest(jaccard, ratio(F.col("a"), F.col("b")), cosine), 6)
    score = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("ea") == F.col("eb"), 0.95).when(F.arrays_overlap("pa", "pb"), 0.88).otherwise(plain)
    return x.crossJoin(y).select("a", "b", score.alias("score"))


def plain_key(label: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(label, "[^ -~]", "")))


def _list_sql(c: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''))"


def _grams_sql(c: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({c}), 1) + 1), lambda i: substr(' ' || {c} || ' ', i, 3)))"


SIM_SQL = f"""{TERMS_SQL}, {TEMPLATE_SQL}, {POOL_SQL}, both_ as (select label from template union select label from pool),
 ex as (select label, min(cluster) as exact from both_ join terms on label = term group by 1), pa as (select label, list(distinct cluster) as part from both_ join terms on {PARTIAL.format(starts="starts_with", g=", 'g'")} group by 1),
 c as (select label, exact, coalesce(part, []) as part, {_list_sql("label")} as ws, {_grams_sql("label")} as gs from both_ left join ex using (label) left join pa using (label)),
 met as (select p.label as a, t.label as b, p.exact as ea, t.exact as eb, p.part as pa, t.part as pb, p.ws as u, t.ws as v, p.gs as g, t.gs as h from c p join pool using (label) cross join (select c.* from c join template using (label)) t),
 sim as (select a, b, u, v, round(case when a = b then 1.0::double when ea = eb then 0.95 when len(list_intersect(pa, pb)) > 0 then 0.88
   else greatest(len(list_intersect(u, v)) / greatest(len(list_distinct(list_concat(u, v))), 1), 1 - levenshtein(a, b) / greatest(length(a), length(b), 1), len(list_intersect(g, h)) / sqrt(len(g) * len(h))) end, 6) as score, ea, eb from met)"""


def _vocabularies(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    # Written labels first, so that keys are made once for each and not for each row; stored, as every measure reads the vocabulary again.
    written = fixture(spark, sf_dir, "fx_raw_label").select("label").distinct()
    pool = stored(written.select(plain_key(F.col("label")).alias("label")).distinct())
    return pool, spark.createDataFrame([(x,) for _, x in LABELS], "label string")


@query("l9_cluster_similarity", oracle(f"with {SIM_SQL} select a, b, score from sim", "fx_raw_label"))
def l9(spark, sf_dir):
    return all_similarities(*_vocabularies(spark, sf_dir))


@query("j09_similarity_join", oracle(f"with {SIM_SQL} select a as pool_label, b as template_label, score from (select *, row_number() over (partition by a order by score desc, b) as k from sim where score >= 0.72) where k = 1", "fx_raw_label"))
def j09(spark, sf_dir, least: float = 0.72):
    best = top(similarity(*_vocabularies(spark, sf_dir), least), ["a"], [F.desc("score"), F.col("b")])
    return best.select(F.col("a").alias("pool_label"), F.col("b").alias("template_label"), "score")


def token_set(a: Column, b: Column) -> Column:
    """Best ratio among the common words, these with the rest of a, and these with the rest of b, words in order."""
    u, v = words(a), words(b)
    join = lambda *parts: F.array_join(F.concat(*parts), " ")
    both = F.array_sort(F.array_intersect(u, v))
    t0, t1, t2 = join(both), join(both, F.array_sort(F.array_except(u, v))), join(both, F.array_sort(F.array_except(v, u)))
    shared = F.size(both) > 0
    return F.greatest(F.when(shared, ratio(t0, t1)).otherwise(0.0), F.when(shared, ratio(t0, t2)).otherwise(0.0), ratio(t1, t2))


def cascade(pool: DataFrame, template: DataFrame, least: float = 0.75) -> DataFrame:
    """(pool_label, template_label, tier, score): exact, then synonym, then token set at least least with lengths within a factor of four (any length for a label whose length is near that of none)."""
    x, y = clustered(pool), clustered(template)
    exact = x.join(y.select("label"), "label").select(F.col("label").alias("a"), F.col("label").alias("b"), F.lit(1).alias("tier"), F.lit(1.0).alias("score"))
    left = x.join(exact.select(F.col("a").alias("label")), "label", "left_anti")
    same = left.select(F.col("label").alias("a"), "exact").join(y.select(F.col("label").alias("b"), "exact"), "exact").select("a", "b", F.lit(2).alias("tier"), F.lit(0.95).alias("score"))
    rest = left.join(same.select(F.col("a").alias("label")).distinct(), "label", "left_anti")
    # Lengths are few, so their table is.
    lengths = y.select(F.length("label").alias("n")).distinct()
    near_any = rest.join(F.broadcast(lengths), F.length("label").between(0.25 * F.col("n"), 4.0 * F.col("n")), "left_semi").select(F.col("label").alias("a"), F.lit(True).alias("any_near"))
    weight = lambda w: F.length(w) + 1.0
    total = lambda ts, label: (F.aggregate(ts, F.lit(0.0), lambda s, t: s + weight(t)) - 1) * (least - 1e-6) + 1
    chars = lambda label: grams(F.array_join(words(label), " "), 1)
    most = lambda ts, label: F.size(ts) * (least - 1e-6)
    met = meeting(rest, y, [Overlap(words, total, None, weight), Overlap(words, None, total, weight), Overlap(chars, most, most)])
    met = met.join(near_any, "a", "left").where(F.length("a").between(0.25 * F.length("b"), 4.0 * F.length("b")) | F.col("any_near").isNull())
    fuzzy = met.withColumn("score", F.round(token_set(F.col("a"), F.col("b")), 6)).where(F.col("score") >= least).select("a", "b", F.lit(3).alias("tier"), "score")
    best = top(exact.union(same).union(fuzzy), ["a"], [F.col("tier"), F.desc("score"), F.col("b")])
    return best.toDF("pool_label", "template_label", "tier", "score")


_J = "array_to_string({}, ' ')"
_T0, _T1, _T2 = _J.format("i"), _J.format("list_concat(i, ra)"), _J.format("list_concat(i, rb)")
_RATIO = "(1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}), 1))"
J3_SQL = f"""with {SIM_SQL}, e as (select p.label as a, p.label as b, 1 as tier, 1.0::double as score from pool p join template t using (label)),
 s as (select p.label as a, t.label as b, 2 as tier, 0.95::double as score from pool p join ex x using (label) join ex y on x.exact = y.exact join template t on t.label = y.label where p.label not in (select a from e)),
 m as (select a, b, list_sort(list_intersect(u, v)) as i, list_sort(list_filter(u, lambda w: not list_contains(v, w))) as ra, list_sort(list_filter(v, lambda w: not list_contains(u, w))) as rb, length(a) between 0.25 * length(b) and 4.0 * length(b) as near from sim
   where a not in (select a from e) and a not in (select a from s)),
 n as (select *, bool_or(near) over (partition by a) as any_near from m),
 f as (select a, b, 3 as tier, round(greatest(case when len(i) > 0 then {_RATIO.format(_T0, _T1)} else 0 end, case when len(i) > 0 then {_RATIO.format(_T0, _T2)} else 0 end, {_RATIO.format(_T1, _T2)}), 6) as score from n where near or not any_near)
 select a as pool_label, b as template_label, tier, score from (select *, row_number() over (partition by a order by tier, score desc, b) as k from (select * from e union all select * from s union all select * from f where score >= 0.75)) where k = 1"""


@query("j03_tiered_cascade", oracle(J3_SQL, "fx_raw_label"))
def j03(spark, sf_dir):
    return cascade(*_vocabularies(spark, sf_dir))


STOP = ("the", "of", "and", "to")
#: Length of the character runs by which one label is found inside another.
INSIDE = 3


def grams_inside(label: Column) -> Column:
    """Runs of INSIDE characters without marks at the ends, so those of an inner text are among those of the outer one."""
    return F.when(F.length(label) >= INSIDE, F.transform(F.sequence(F.lit(1), F.length(label) - INSIDE + 1), lambda i: F.substring(label, i, F.lit(INSIDE)))).otherwise(F.array().cast("array<string>"))


def short_inside(inner: DataFrame, outer: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y): labels of fewer than INSIDE characters inside others, met on all runs of that length."""
    one = inner.where(F.length("label").between(1, INSIDE - 1)).select(F.col("label").alias(x), F.col("label").alias("t"))
    runs = F.array_distinct(F.concat(*(F.transform(F.sequence(F.lit(1), F.greatest(F.length("label") - n + 1, F.lit(1))), lambda i, n=n: F.substring("label", i, F.lit(n))) for n in range(1, INSIDE))))
    return one.join(outer.select(F.col("label").alias(y), F.explode(runs).alias("t")), "t").select(x, y).distinct()


def lookup(asked: DataFrame, pool: DataFrame) -> DataFrame:
    """(label, fy, matched, score, status) for asked (label, fy) in a pool of (label, fy) rows: equal 1, one inside the other 0.85, character ratio from 0.70, else a label of the year with half of the words."""
    wanted, held = asked.select("label").distinct(), pool.select("label").distinct()
    a, b = F.col("a"), F.col("b")
    content = lambda c: F.array_except(F.filter(F.split(c, "[^a-z]+"), lambda w: w != ""), F.array(*map(F.lit, STOP)))
    half = Overlap(lambda c: F.array_distinct(content(c)), lambda ts, label: F.size(ts) * 0.5, None)
    all_of = lambda ts, label: F.size(ts)
    runs = lambda c: F.array_distinct(grams_inside(c))
    inside = [Overlap(runs, all_of, None), Overlap(runs, None, all_of)]
    pairs = meeting(wanted, held, [half, *inside, edits_within(0.7 - 1e-6)])
    # Labels too short for a run are a bounded vocabulary of their own; they meet by their characters.
    pairs = pairs.union(short_inside(wanted, held, "a", "b")).union(short_inside(held, wanted, "b", "a").select("a", "b")).distinct()
    score = F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.85).otherwise(ratio(a, b))
    share = F.size(F.array_intersect(content(a), content(b))) / F.greatest(F.size(F.array_distinct(content(a))), F.lit(1))
    scored = pairs.select("a", "b", F.round(score, 6).alias("score"), F.round(share, 6).alias("share"))
    best = top(scored.where("score >= 0.7"), ["a"], [F.desc("score"), F.col("b")]).select(F.col("a").alias("label"), F.col("b").alias("best"), "score")
    years = pool.select(F.col("label").alias("b"), "fy").distinct()
    rest = asked.join(best.select("label"), "label", "left_anti")
    loose = rest.join(scored.where("share >= 0.5").withColumnRenamed("a", "label"), "label").join(years, ["b", "fy"])
    loose = top(loose, ["label", "fy"], [F.desc("share"), F.col("b")]).select("label", "fy", F.col("b").alias("matched"), F.col("share").alias("score"), F.lit("found").alias("status"))
    close = asked.join(best, "label").join(years.withColumnRenamed("b", "best").withColumn("has", F.lit(True)), ["best", "fy"], "left")
    close = close.select("label", "fy", F.col("best").alias("matched"), "score", F.when(F.col("has"), "found").otherwise("found without period").alias("status"))
    found = close.union(loose)
    missing = asked.join(found.select("label", "fy"), ["label", "fy"], "left_anti").select("label", "fy", F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit("not found"))
    return found.union(missing)


def _content_sql(c: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({c}, '[^a-z]+'), lambda w: w <> '' and w not in {STOP}))"


YEARED_SQL = f"held as (select distinct {KEY_SQL} as label, cast(1992 + id % 7 as integer) as fy from fx_raw_label)"
J10_SQL = f"""with {SIM_SQL}, {YEARED_SQL}, asked as (select label, fy from template cross join (values (1993), (2005)) y(fy)),
 k as (select b as a, a as b, round(case when a = b then 1.0::double when contains(a, b) or contains(b, a) then 0.85 else 1 - levenshtein(a, b) / greatest(length(a), length(b), 1) end, 6) as score,
   round(len(list_intersect({_content_sql("b")}, {_content_sql("a")})) / greatest(len({_content_sql("b")}), 1), 6) as share from sim where a in (select label from held)),
 best as (select * from (select *, row_number() over (partition by a order by score desc, b) as n from k where score >= 0.7) where n = 1),
 close as (select q.label, q.fy, best.b as matched, best.score, case when h.label is not null then 'found' else 'found without period' end as status from asked q join best on best.a = q.label left join held h on h.label = best.b and h.fy = q.fy),
 loose as (select label, fy, matched, score, 'found' as status from (select q.label, q.fy, k.b as matched, k.share as score, row_number() over (partition by q.label, q.fy order by k.share desc, k.b) as n from asked q join k on k.a = q.label and k.share >= 0.5 join held h on h.label = k.b and h.fy = q.fy where q.label not in (select a from best)) where n = 1),
 f as (select * from close union all select * from loose)
 select * from f union all select label, fy, null, null, 'not found' from asked q where not exists (select 1 from f where f.label = q.label and f.fy = q.fy)"""


@query("j10_pool_lookup", oracle(J10_SQL, "fx_raw_label"))
def j10(spark, sf_dir):
    held = fixture(spark, sf_dir, "fx_raw_label").select(plain_key(F.col("label")).alias("label"), (F.lit(1992) + F.col("id") % 7).cast("int").alias("fy")).distinct()
    asked = _vocabularies(spark, sf_dir)[1].withColumn("fy", F.explode(F.array(F.lit(1993), F.lit(2005))))
    return lookup(asked, held)


def assigned(candidates: DataFrame, totals: float = 1.05) -> DataFrame:
    """One-to-one matches (company_id, template_label, pool_label) from candidates (company_id, template_label, tier, pool_label, score, value).

    Labels are served by tier and name, each with its best free candidate; a component above totals times a matched total that shares a word with it is refused. The order makes it sequential within
    a company, whose candidates are at most its template times its labels; companies are spread over the tasks."""

    def serve(rows: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        matched_totals: list[tuple[set[str], float]] = []
        out = []
        for (_, label), own in rows.sort_values(["tier", "template_label", "score", "pool_label"], ascending=[True, True, False, True]).groupby(["tier", "template_label"], sort=True):
            free = own[~own["pool_label"].isin(used)]
            if not len(free):
                continue
            pick, key = free.iloc[0], set(label.split())
            if "total" in key:
                matched_totals.append((key - {"total"}, abs(pick["value"])))
            elif any(key & t and abs(pick["value"]) > totals * v for t, v in matched_totals):
                continue
            used.add(pick["pool_label"])
            out.append((pick["company_id"], label, pick["pool_label"]))
        return pd.DataFrame(out, columns=["company_id", "template_label", "pool_label"])

    return candidates.groupBy("company_id").applyInPandas(serve, "company_id long, template_label string, pool_label string")


def candidate_rows(spark, sf_dir) -> DataFrame:
    """Candidates of each company: labels of its pool and template labels of similarity 0.55 or more; labels with a concept and totals come first."""
    known = {x for c, x in LABELS[:62]}
    scored = similarity(*_vocabularies(spark, sf_dir), 0.55)
    values = fixture(spark, sf_dir, "fx_raw_label").groupBy("company_id", plain_key(F.col("label")).alias("a")).agg(F.max(F.abs("value")).alias("value"))
    concept, total = F.col("b").isin(*known), F.col("b").contains("total")
    tier = F.when(concept & total, 0).when(concept, 1).when(total, 2).otherwise(3)
    return values.join(scored, "a").select("company_id", F.col("b").alias("template_label"), tier.alias("tier"), F.col("a").alias("pool_label"), "score", "value")


@query("j08_greedy_assignment")
def j08(spark, sf_dir):
    return assigned(candidate_rows(spark, sf_dir))
