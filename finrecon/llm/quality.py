"""Quality rules: fixed limits on words and repetition, and robust outliers of transformed statistics.

For each (language, source) a minimum-covariance-determinant estimate of the statistic vectors is sought as by the fast algorithm. A concentration step keeps the share ``KEPT`` of documents with the least distance
and estimates mean and covariance from those. ``DRAWS`` subsets of one vector more than there are statistics are drawn from a sample of each group and take ``FIRST_STEPS`` steps within the sample. The ``GO_ON`` of
least determinant and a start from medians and quartiles take as many steps over all documents; the one of least determinant goes on until the determinant no longer falls. With a quarter of outliers, a draw has none with
probability 0.13, so all draws have some with probability 0.0002. The covariance is scaled for consistency at the normal distribution. Every step is two
grouped aggregates over narrow rows; a group of any size is pre-aggregated, and the order statistics come from a histogram of
the logarithm of the distance, so no group meets in one task. All of it is DataFrame expressions.

A document whose squared Mahalanobis distance exceeds the group's cut is an outlier. The cut is the quantile of the chi-squared distribution at ``TAIL``, and where the group's median distance
exceeds that of the distribution, as with tails longer than the normal's, it is raised in proportion.

Statistics of a text: logarithm of the mean word length; transformed shares of symbol characters, of repeated words, of repeated lines and of capitals; and the logarithm of the
number of distinct words less what the text's length predicts in its group. A small ridge keeps a covariance invertible in groups where a statistic is constant.

Defined cases: a null, empty or blank text has no words and fails the base rules; documents that fail them take no part in the estimates;
groups of fewer than ``LEAST`` others are judged by the language's estimate, and a language with too few by that of all; null language or source form groups of their own;
repeated rows count each; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame, Window, functions as F

from finrecon.llm.frames import Scratch, own

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
KEPT, LEAST = 0.75, 60
#: Draws of DRAWN vectors from a sample of about SAMPLE; GO_ON of them go on from all rows.
DRAWS, DRAWN, SAMPLE, GO_ON = 60, 7, 300, 3
FIRST_STEPS, MOST_STEPS = 2, 10
#: A determinant has converged when its logarithm falls by less than FALL.
TAIL, FALL = 1e-4, 1e-3
FEATURES = ("f_length", "f_symbols", "f_repeat", "f_lines", "f_upper", "f_distinct")
#: Least deviation of each feature, added in quadrature.
RIDGE = (0.08, 0.35, 0.35, 0.35, 0.35, 0.08)
#: Places of a covariance's lower triangle, by rows.
TRIANGLE = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
BINS_PER_E = 32
#: Tables of one row for each group are sent to all tasks up to so many groups, some 300 bytes each.
BROADCAST_GROUPS = 50_000
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi2_share(x: float, p: int) -> float:
    """Distribution function of chi-squared with p degrees of freedom, by its series."""
    term = total = 1.0 / (p / 2)
    k = 0
    while term > total * 1e-16:
        k += 1
        term *= x / 2 / (p / 2 + k)
        total += term
    return min(1.0, total * exp(p / 2 * log(x / 2) - x / 2 - lgamma(p / 2))) if x > 0 else 0.0


def chi2_quantile(share: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if chi2_share(x, p) < share else (low, x)
    return low


def sent(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def word_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper and n_distinct of each row; each word is hashed once."""
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = docs.withColumn("ws", F.filter(F.split(raw, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    hashed = words.withColumn("hs", F.transform("ws", lambda w: F.xxhash64(w)))
    runs = F.when(
        F.size("hs") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("hs") - WINDOW), lambda i: F.xxhash64(*(F.get("hs", i + k) for k in range(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = hashed.withColumn("runs", runs)
    some = F.size(F.array_distinct("runs")) < F.size("runs")
    # Columns of their own: a lambda would otherwise compute the array anew for each element.
    hashed = hashed.withColumn("placed", F.when(some, F.array_sort(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    repeated = F.coalesce(covered(F.col("placed")), F.lit(0))
    lines = F.filter(F.split(raw, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = hashed.withColumn("lines", F.when(F.instr(raw, "\n") > 0, lines).otherwise(F.array().cast("array<string>")))
    return counted.withColumns(
        {
            "n_words": F.size("ws").cast("long"),
            "word_chars": F.length(F.regexp_replace(raw, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": F.regexp_count(raw, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": repeated.cast("long"),
            "n_upper": F.regexp_count(raw, F.lit("[A-Z]")).cast("long"),
            "n_distinct": F.size(F.array_distinct("hs")).cast("long"),
        }
    ).drop("ws", "hs", "runs", "placed", "lines")


def covered(placed: Column) -> Column:
    """Words that lie in windows whose hash occurs twice or more; placed has (hash, first word) of every window in order."""
    twice = F.filter(
        placed,
        lambda x, k: ((k > 0) & (F.get(placed, k - 1)["h"] == x["h"])) | (F.get(placed, k + 1)["h"].eqNullSafe(x["h"])),
    )
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    folded = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
    )
    return folded["n"]


def features(stats: DataFrame) -> DataFrame:
    """The transformed statistic vector; each share p of n becomes log((p n + 0.5) / (n + 1)) against half a count, so that zero counts of long texts stay close."""
    n = F.col("n_words")

    def share(count: str, of: Column, least: float) -> Column:
        return F.log((F.col(count) + least * (of + 20)) / ((1 + least) * (of + 20)))

    return stats.withColumns(
        {
            "f_length": F.log((F.col("word_chars") + 20) / (n + 4)),
            "f_symbols": share("n_symbols", F.col("word_chars"), 0.01),
            "f_repeat": share("n_repeat_words", n, 0.05),
            "f_lines": F.log1p(F.col("n_dup_lines") / 2.0),
            "f_upper": share("n_upper", F.col("word_chars"), 0.03),
            "f_distinct": F.log(F.col("n_distinct") + 1.0),
        }
    )


def _less_line(rows: DataFrame, lines: DataFrame, few: bool) -> DataFrame:
    """rows with f_distinct less what the logarithm of the words predicts in the group."""
    met = rows.join(sent(lines, few), "g", "left")
    # All texts of one length give no slope; then nothing is taken off but a constant, which the mean takes up.
    return met.withColumn("f_distinct", F.col("f_distinct") - F.coalesce(F.col("start") + F.col("slope") * F.log("n_words"), F.lit(0.0))).drop("slope", "start")


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and covariance (its lower triangle by rows) of each group and start by one partial aggregate."""
    sums = rows.groupBy("g", "start").agg(
        F.expr("count(1) AS n"), *(F.expr(f"sum({f}) AS s{i}") for i, f in enumerate(FEATURES)), *(F.expr(f"sum({FEATURES[i]} * {FEATURES[j]}) AS s{i}{j}") for i, j in TRIANGLE)
    )
    mean = ", ".join(f"s{i} / n" for i in range(len(FEATURES)))
    covariance = ", ".join(f"s{i}{j} / n - (s{i} / n) * (s{j} / n) + {RIDGE[i] ** 2 if i == j else 0}D" for i, j in TRIANGLE)
    return sums.selectExpr("g", "start", f"array({mean}) AS mean", f"array({covariance}) AS covariance")


def _triangle(entry: str, steps: list[dict[str, float]]) -> Column:
    """An array t built by literal steps x, each of which appends the value of entry."""
    literal = ", ".join(f"named_struct({', '.join(f"'{k}', {v}{'D' * isinstance(v, float)}" for k, v in x.items())})" for x in steps)
    return F.expr(f"aggregate(array({literal}), cast(array() AS array<double>), (t, x) -> concat(t, array({entry})))")


def _factored(moments: DataFrame) -> DataFrame:
    """The lower Cholesky factor of the covariance by rows, its inverse by columns, and the logarithm of the covariance's determinant. Arrays are folded, so plans stay small."""
    p = range(len(FEATURES))
    row, column = [i * (i + 1) // 2 for i in p], [j * len(p) - j * (j - 1) // 2 for j in p]
    less = "aggregate(zip_with({}, {}, (a, b) -> a * b), {}, (s, v) -> s - v)"
    rest = less.format("slice(t, x.r + 1, x.j)", "slice(t, x.o + 1, x.j)", "get(covariance, x.r + x.j)")
    lower = f"if(x.r = x.o, sqrt(greatest({rest}, x.least)), {rest} / get(t, x.o + x.j))"
    inverse = less.format("slice(lower, x.r + 1, x.k)", "slice(t, x.c + 1, x.k)", "x.unit") + " / get(lower, x.r + x.k)"
    found = moments.select("g", "start", "mean", _triangle(lower, [{"r": row[i], "o": row[j], "j": j, "least": RIDGE[i] ** 2 * 0.25} for i, j in TRIANGLE]).alias("lower"))
    found = found.withColumn("inverse", _triangle(inverse, [{"r": row[i] + j, "c": column[j], "k": i - j, "unit": float(i == j)} for j in p for i in p[j:]]))
    return found.selectExpr("*", "2 * (" + " + ".join(f"ln(get(lower, {row[i] + i}))" for i in p) + ") AS det")


def _distance() -> Column:
    """The squared Mahalanobis distance of the features, by mean and inverse factor, one flat expression."""
    p = range(len(FEATURES))
    at = {(i, j): k for k, (i, j) in enumerate((i, j) for j in p for i in p[j:])}
    z = [" + ".join(f"get(inverse, {at[i, j]}) * ({FEATURES[j]} - get(mean, {j}))" for j in range(i + 1)) for i in p]
    return F.expr(" + ".join(f"pow({x}, 2)" for x in z))


def _binned(rows: DataFrame, estimates: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """The rows with the bin of the logarithm of their distance, and the histogram of the bins with the rows below each and in all."""
    met = rows.join(sent(estimates.select("g", "start", "mean", "inverse"), few), "g")
    binned = met.select("g", "start", *FEATURES, F.floor(F.log(_distance() + 1e-6) * BINS_PER_E).alias("bin"))
    counts = binned.groupBy("g", "start", "bin").agg(F.count("*").alias("k"))
    key = Window.partitionBy("g", "start")
    return binned, counts.withColumn("below", F.sum("k").over(key.orderBy("bin")) - F.col("k")).withColumn("all", F.sum("k").over(key))


def _quantile_bin(share: float) -> Column:
    return F.max(F.when(F.col("below") < F.col("all") * share, F.col("bin")))


def _step(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """One concentration step: estimates from the share KEPT of each group with the least distance, whole bins."""
    binned, histogram = _binned(rows, estimates, few)
    cut = histogram.groupBy("g", "start").agg(_quantile_bin(KEPT).alias("most"))
    near = binned.join(sent(cut, few), ["g", "start"]).where("bin <= most").select("g", "start", *FEATURES)
    return _factored(_moments(near))


def robust_estimates(rows: DataFrame, few: bool, scratch: Scratch) -> DataFrame:
    """g, mean and inverse factor for each group of rows (g, features), its cut on the squared distance, and mean (m0..) and factor (l00..) as columns."""
    p = range(len(FEATURES))
    robust = rows.groupBy("g").agg(
        F.approx_count_distinct(F.xxhash64(*FEATURES)).alias("n"), *(F.percentile_approx(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q{i}") for i, f in enumerate(FEATURES))
    )
    robust = scratch.kept(robust)
    centre = robust.select(
        "g", F.lit(0).alias("start"),
        F.array(*(F.col(f"q{i}")[1] for i in p)).alias("mean"),
        F.array(*(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + RIDGE[i] ** 2 if i == j else F.lit(0.0) for i, j in TRIANGLE)).alias("covariance"),
    )
    # The sample: about SAMPLE different vectors of each group, by their hash.
    chance = F.pmod(F.xxhash64(*FEATURES), F.lit(1 << 20)) / float(1 << 20)
    sample = scratch.kept(rows.join(sent(robust.select("g", "n"), few), "g").where(chance < SAMPLE / F.col("n")).select("g", *FEATURES).distinct())
    # Each draw is the vectors of the sample with the least hashes under its own number.
    together = sample.groupBy("g").agg(F.collect_list(F.struct(*FEATURES)).alias("vs")).withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(DRAWS))))
    least = F.slice(F.array_sort(F.transform("vs", lambda v: F.struct(F.xxhash64(v, F.col("start")).alias("h"), v.alias("v")))), 1, DRAWN)
    drawn = together.select("g", "start", F.explode(least).alias("x")).select("g", "start", "x.v.*")
    now = scratch.kept(_factored(centre.unionByName(_moments(drawn))))
    for _ in range(FIRST_STEPS):
        now = scratch.kept(_step(sample, now, few))
    rank = F.row_number().over(Window.partitionBy("g").orderBy("det", "start"))
    # The start from medians goes on from all rows, with the best of the draws.
    now = scratch.kept(_factored(centre).unionByName(now.where("start > 0").withColumn("k", rank).where(F.col("k") <= GO_ON).drop("k")))
    for _ in range(FIRST_STEPS):
        now = scratch.kept(_step(rows, now, few))
    best = [c for c in now.columns if c != "g"]
    now = scratch.kept(now.groupBy("g").agg(F.min_by(F.struct(*best), F.struct("det", "start")).alias("best")).select("g", "best.*"))
    for _ in range(MOST_STEPS):
        after = scratch.kept(_step(rows, now, few))
        if after.join(sent(now.select("g", "start", F.col("det").alias("was")), few), ["g", "start"]).where(F.col("det") < F.col("was") - FALL).isEmpty():
            break
        now = after
    # Consistency at the normal distribution: the covariance of the nearest KEPT is too small by this factor.
    features_, quantile = len(FEATURES), chi2_quantile(1 - TAIL, len(FEATURES))
    factor = chi2_share(chi2_quantile(KEPT, features_), features_ + 2) / KEPT
    _, histogram = _binned(rows, now, few)
    half = F.exp((_quantile_bin(0.5) + 0.5) / BINS_PER_E) * factor
    cuts = histogram.groupBy("g").agg((quantile * F.greatest(F.lit(1.0), half / chi2_quantile(0.5, features_))).alias("cut"))
    wide = F.transform("inverse", lambda x: x * factor**0.5).alias("inverse")
    named = [F.get("mean", F.lit(i)).alias(f"m{i}") for i in p] + [(F.get("lower", F.lit(k)) / factor**0.5).alias(f"l{i}{j}") for k, (i, j) in enumerate(TRIANGLE)]
    return scratch.kept(now.join(sent(cuts, few), "g").select("g", "cut", "mean", wide, *named))


def with_verdicts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs, each row with _stats (the base statistics, base_failed, d2 and kept). The rows are stored once with their statistics; the estimates come from narrow rows."""
    scratch = Scratch(docs.sparkSession, "quality")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    read = whole.select("row", F.col(f"row.`{lang_col}`").alias("lang"), F.col(f"row.`{source_col}`").alias("source"), F.col(f"row.`{text_col}`").alias("text"))
    stats = features(word_statistics(read)).drop("text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = scratch.kept(stats.withColumn("base_failed", failed))
    # Groups: own (lang, source) if it is large enough, else its language, else all.
    none = F.lit(None).cast("string")
    names = [F.concat_ws("/", F.lit(str(k)), *(F.coalesce(c, F.lit("\0")) for c in g)) for k, g in enumerate(((F.col("lang"), F.col("source")), (F.col("lang"), none), (none, none)))]
    sound = stats.where("not base_failed").select("lang", "source", "n_words", *FEATURES)
    sizes = scratch.kept(sound.groupBy("lang", "source").agg(F.count("*").alias("k")))
    few = sizes.count() <= BROADCAST_GROUPS
    in_lang = sizes.groupBy("lang").agg(F.sum("k").alias("k_lang"))
    level = sizes.join(sent(in_lang.withColumnRenamed("lang", "l"), few), F.col("lang").eqNullSafe(F.col("l"))).drop("l")
    level = level.withColumn("g", F.when(F.col("k") >= LEAST, names[0]).when(F.col("k_lang") >= LEAST, names[1]).otherwise(names[2]))
    level = scratch.kept(level.select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), "g", F.col("g").startswith("1/").alias("by_lang"), F.col("g").startswith("2/").alias("by_all")))
    langs = level.where("by_lang").select(F.col("lang_").alias("wide_lang")).distinct()
    needs = level.agg(F.bool_or("by_lang").alias("lang"), F.bool_or("by_all").alias("all")).first()
    match = F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    pooled = sound.join(sent(level.where("not by_lang and not by_all"), few), match).select("g", "n_words", *FEATURES)
    if needs["lang"]:
        pooled = pooled.unionByName(sound.join(sent(langs, few), F.col("lang").eqNullSafe(F.col("wide_lang"))).select(names[1].alias("g"), "n_words", *FEATURES))
    if needs["all"]:
        pooled = pooled.unionByName(sound.select(names[2].alias("g"), "n_words", *FEATURES))
    slope, start = F.regr_slope("f_distinct", F.log("n_words")), F.regr_intercept("f_distinct", F.log("n_words"))
    lines = scratch.kept(pooled.groupBy("g").agg(slope.alias("slope"), start.alias("start")))
    rows = scratch.kept(_less_line(pooled, lines, few).select("g", *FEATURES))
    estimates = robust_estimates(rows, few, scratch)
    judged_rows = _less_line(stats.join(sent(level, few), match, "left"), lines, few).join(sent(estimates.select("g", "cut", "mean", "inverse"), few), "g", "left")
    scored = judged_rows.withColumn("d2", F.when(~F.col("base_failed"), _distance()))
    verdict = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= F.coalesce("cut", F.lit(0.0)))
    return scored.select("row.*", F.struct(*STATISTICS, "base_failed", verdict.alias("kept"), "d2").alias(STATS))


STATS = "_stats"


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, the base statistics, base_failed, kept, d2 (null where the base rules fail)."""
    read = own(docs, id_col, lang_col, source_col, text_col).toDF("doc_id", "lang", "source", "text")
    return with_verdicts(read).select("doc_id", f"{STATS}.*")


def kept_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    name = STATS
    renamed = docs.toDF(*(f"c{i}_" for i in range(len(docs.columns))))
    at = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    return with_verdicts(renamed, at[text_col], at["lang"], at["source"]).where(F.col(name)["kept"]).drop(name).toDF(*docs.columns)
