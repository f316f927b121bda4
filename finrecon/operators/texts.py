"""Tests and classes of labels, pages and names by pattern tables: filters FLT2-FLT8, units N3, concepts L3, sections L10, scopes L11, titles L12, sectors L13."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from finrecon.functions import patterns as pt, rules
from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query
from finrecon.plans.stored import stored

#: Up to so many distinct labels are sent to all tasks; more are joined by a shuffle.
FEW_LABELS = 100_000


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any_sql(column: str, patterns: Sequence[str]) -> str:
    return "(" + " or ".join(f"regexp_matches({column}, {quoted(p)})" for p in patterns) + ")"


def any_of(text: Column, patterns: Sequence[str]) -> Column:
    """Whether the text matches any of the patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def holds(text: Column, phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def _holds_sql(column: str, phrases: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({column}, {quoted(p)})" for p in phrases) + ")"


def first_of(text: Column, rules_: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first name any of whose phrases the text holds."""
    chain = F
    for name, phrases in rules_:
        chain = chain.when(holds(text, phrases), name)
    return chain.otherwise(F.lit(None))


def _first_sql(column: str, rules_: Sequence[tuple[str, Sequence[str]]]) -> str:
    return "case " + " ".join(f"when {_holds_sql(column, p)} then {quoted(n)}" for n, p in rules_) + " end"


def is_fragment(label: Column, boilerplate: Sequence[str] = pt.BOILERPLATE) -> Column:
    """Length below 2 or above 200, four words or more of which over 45 percent are one letter or digit or none, under three letters, or a line of auditors and signatories."""
    s = F.trim(label)
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    short = F.size(F.filter(words, lambda w: F.length(F.regexp_replace(w, "[^a-zA-Z0-9]", "")) <= 1))
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    return (F.length(s) < 2) | (F.length(s) > 200) | ((F.size(words) >= 4) & (short > 0.45 * F.size(words))) | (letters < 3) | any_of(s, boilerplate)


@query("flt2_fragment_label", oracle(rf"select id, line, label, length(label) < 2 or length(label) > 200 or (len(ws) >= 4 and len(list_filter(ws, lambda w: length(regexp_replace(w, '[^a-zA-Z0-9]', '', 'g')) <= 1)) > 0.45 * len(ws)) or length(regexp_replace(label, '[^\p{{L}}]', '', 'g')) < 3 or {_any_sql('label', pt.BOILERPLATE)} as fragment from (select *, list_filter(string_split_regex(label, '\s+'), lambda w: w <> '') as ws from fx_raw_label)", "fx_raw_label"))
def flt2(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_raw_label").select("id", "line", "label", is_fragment(F.col("label")).alias("fragment"))


def is_artefact(label: Column, phrases: Sequence[str] = pt.NOTE_PHRASES) -> Column:
    """Under 3 or over 90 characters, a split word in a label of over 35, a phrase of notes, or a lone numeral."""
    low = F.lower(F.trim(label))
    return (F.length(label) < 3) | (low.rlike(pt.SPLIT_WORD) & (F.length(label) > 35)) | (F.length(label) > 90) | holds(low, phrases) | F.trim(label).rlike(pt.NUMERAL)


@query("flt3_ocr_label", oracle(f"select id, line, label, length(label) < 3 or (regexp_matches(lower(trim(label)), '{pt.SPLIT_WORD}') and length(label) > 35) or length(label) > 90 or {_holds_sql('lower(trim(label))', pt.NOTE_PHRASES)} or regexp_matches(trim(label), {quoted(pt.NUMERAL)}) as artefact from fx_raw_label", "fx_raw_label"))
def flt3(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_raw_label").select("id", "line", "label", is_artefact(F.col("label")).alias("artefact"))


def is_junk(label: Column, junk: Sequence[str] = pt.JUNK) -> Column:
    """Rows of schedules and votes, list items, leaked page heads, or under three characters."""
    return (F.length(F.trim(label)) < 3) | any_of(F.trim(label), junk)


@query("flt4_junk_label", oracle(f"select id, line, label, length(trim(label)) < 3 or {_any_sql('trim(label)', pt.JUNK)} as junk from fx_raw_label", "fx_raw_label"))
def flt4(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_raw_label").select("id", "line", "label", is_junk(F.col("label")).alias("junk"))


@query("flt5_noise_and_sign", oracle(f"select id, line, label, case when value < 0 and {_holds_sql('lower(label)', pt.SIGN_TURNED)} then -value else value end as value from fx_raw_label where not regexp_matches(label, {quoted(pt.REFORMULATED)})", "fx_raw_label"))
def flt5(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_raw_label").where(~F.col("label").rlike(pt.REFORMULATED))
    turned = (F.col("value") < 0) & holds(F.lower("label"), pt.SIGN_TURNED)
    return rows.select("id", "line", "label", F.when(turned, -F.col("value")).otherwise(F.col("value")).alias("value"))


@query("flt6_negative_repair", oracle(f"select id, line, label, case when value < -0.5 and not {_holds_sql('lower(label)', pt.MAY_LOSE)} then abs(value) else value end as value from fx_raw_label", "fx_raw_label"))
def flt6(spark, sf_dir):
    wrong = (F.col("value") < -0.5) & ~holds(F.lower("label"), pt.MAY_LOSE)
    return fixture(spark, sf_dir, "fx_raw_label").select("id", "line", "label", F.when(wrong, F.abs("value")).otherwise(F.col("value")).alias("value"))


@query("flt7_notes_page", oracle(f"select filing, page_no, regexp_matches(left(text, 600), {quoted(pt.NOTES_PAGE)}) as excluded from fx_filed_page", "fx_filed_page"))
def flt7(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_filed_page").select("filing", "page_no", F.substring("text", 1, 600).rlike(pt.NOTES_PAGE).alias("excluded"))


#: Steps of the page test: characters looked at, pattern, whether the page is dropped.
PAGE_STEPS = ((250, pt.STATEMENT_TITLE, False), (350, pt.NOTES_TITLE, True), (1500, pt.NOT_FINANCIAL, True), (3000, pt.COUNT_TABLES, True))


def page_dropped(text: Column, steps=PAGE_STEPS) -> Column:
    """The first step whose pattern is in the head of the page decides; a page without any stays."""
    chain = F
    for n, pattern, dropped in steps:
        chain = chain.when(F.substring(text, 1, n).rlike(pattern), dropped)
    return chain.otherwise(False)


@query("flt8_page_cascade", oracle("select filing, page_no, case " + " ".join(f"when regexp_matches(left(text, {n}), {quoted(p)}) then {str(d).lower()}" for n, p, d in PAGE_STEPS) + " else false end as dropped from fx_filed_page", "fx_filed_page"))
def flt8(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_filed_page").select("filing", "page_no", page_dropped(F.col("text")).alias("dropped"))


def unit_divisor(text: Column, units=pt.UNITS, windows=pt.UNIT_WINDOWS) -> Column:
    """Divisor to crore from the first unit pattern; a shorter window goes before an earlier pattern; 1 without any."""
    found = []
    for window in windows:
        chain, seen = F, text if window is None else F.substring(text, 1, window)
        for pattern, divisor in units:
            chain = chain.when(seen.rlike(pattern), divisor)
        found.append(chain.otherwise(F.lit(None)))
    return F.coalesce(*found, F.lit(1.0))


@query("n3_unit_divisor", oracle("select filing, page_no, coalesce(" + ", ".join("case " + " ".join(f"when regexp_matches({'text' if w is None else f'left(text, {w})'}, {quoted(p)}) then {d}::double" for p, d in pt.UNITS) + " end" for w in pt.UNIT_WINDOWS) + ", 1.0::double) as divisor from fx_filed_page", "fx_filed_page"))
def n3(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_filed_page").select("filing", "page_no", unit_divisor(F.col("text")).alias("divisor"))


@query("l3_first_phrase", oracle(f"select id, line, label, {_first_sql('lower(label)', rules.CONCEPT_PHRASES)} as concept from fx_raw_label", "fx_raw_label"))
def l3(spark, sf_dir):
    """Concepts are found once for each distinct label and joined back."""
    rows = fixture(spark, sf_dir, "fx_raw_label").select("id", "line", "label")
    known = stored(rows.select("label").distinct().withColumn("concept", first_of(F.lower("label"), rules.CONCEPT_PHRASES)))
    return rows.join(F.broadcast(known) if known.count() <= FEW_LABELS else known, "label", "left")


@query("l10_text_class", oracle(f"select filing, page_no, {_first_sql('lower(text)', pt.SECTIONS)} as section from fx_filed_page", "fx_filed_page"))
def l10(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_filed_page").select("filing", "page_no", first_of(F.lower("text"), pt.SECTIONS).alias("section"))


def scope_of(text: Column, default: str = "consolidated") -> Column:
    """Scope named alone in the first 1500 characters; with both or none the default."""
    c, s = F.substring(text, 1, 1500).rlike(pt.CONSOLIDATED), F.substring(text, 1, 1500).rlike(pt.STANDALONE)
    return F.when(c & ~s, "consolidated").when(s & ~c, "standalone").otherwise(default)


@query("l11_scope_of_text", oracle(f"select filing, page_no, case when c and not s then 'consolidated' when s and not c then 'standalone' else 'consolidated' end as scope from (select *, regexp_matches(left(text, 1500), '{pt.CONSOLIDATED}') as c, regexp_matches(left(text, 1500), '{pt.STANDALONE}') as s from fx_filed_page)", "fx_filed_page"))
def l11(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_filed_page").select("filing", "page_no", scope_of(F.col("text")).alias("scope"))


def page_title(text: Column, titles=pt.PAGE_TITLES) -> Column:
    """Title of a page by the first pattern in its first 1500 characters, with the scope in front where the pattern names one."""
    head, chain = F.lower(F.substring(text, 1, 1500)), F
    for title, pattern in titles:
        scope = F.initcap(F.regexp_extract(head, pattern, 1))
        chain = chain.when(head.rlike(pattern), F.trim(F.concat(scope, F.lit(" "), F.lit(title))))
    return chain.otherwise(F.lit(None))


_TITLE_SQL = "case " + " ".join(f"when regexp_matches(head, {quoted(p)}) then trim(concat(upper(left(regexp_extract(head, {quoted(p)}, 1), 1)), substr(regexp_extract(head, {quoted(p)}, 1), 2), ' ', {quoted(t)}))" for t, p in pt.PAGE_TITLES) + " end"


@query("l12_page_titles", oracle(f"select filing, page_no, section from (select filing, page_no, {_TITLE_SQL} as section from (select *, lower(left(text, 1500)) as head from fx_filed_page)) where section is not null", "fx_filed_page"))
def l12(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_filed_page").select("filing", "page_no", page_title(F.col("text")).alias("section")).where("section is not null")


def sector_of(name: Column, explicit: Column, listed: Column, sectors=pt.SECTORS) -> Column:
    """struct(sector, confidence, method): given explicitly, from the symbol table, by a pattern of the name, else general."""
    upper, chain = F.upper(name), F
    for sector, pattern in sectors:
        chain = chain.when(upper.rlike(pattern), sector)
    guess = chain.otherwise(F.lit(None))
    sector = F.coalesce(explicit, listed, guess, F.lit("general"))
    confidence = F.when(explicit.isNotNull() | listed.isNotNull(), 1.0).when(guess.isNotNull(), 0.75).otherwise(0.5)
    method = F.when(explicit.isNotNull(), "explicit").when(listed.isNotNull(), "lookup").when(guess.isNotNull(), "heuristic").otherwise("default")
    return F.struct(sector.alias("sector"), confidence.alias("confidence"), method.alias("method"))


#: Symbols of the fixture with a known sector; a user brings a register.
LISTED = ((6, "it"), (26, "power"))


@query(
    "l13_company_sector",
    oracle(
        "with listed(symbol, known) as (values " + ", ".join(str(x) for x in LISTED) + "), g as (select company_id, known, case when company_id % 10 = 9 then 'metals' end as given, case " + " ".join(f"when regexp_matches(upper(name), {quoted(p)}) then '{s}'" for s, p in pt.SECTORS) + " end as guess from fx_company left join listed on symbol = company_id) "
        "select company_id, coalesce(given, known, guess, 'general') as sector, case when given is not null or known is not null then 1.0::double when guess is not null then 0.75::double else 0.5::double end as confidence, case when given is not null then 'explicit' when known is not null then 'lookup' when guess is not null then 'heuristic' else 'default' end as method from g",
        "fx_company",
    ),
)
def l13(spark, sf_dir):
    listed = F.broadcast(spark.createDataFrame(list(LISTED), "symbol long, known string"))  # a register written by hand
    met = fixture(spark, sf_dir, "fx_company").join(listed, F.col("symbol") == F.col("company_id"), "left")
    return met.withColumn("s", sector_of(F.col("name"), F.when(F.col("company_id") % 10 == 9, "metals"), F.col("known"))).select("company_id", "s.*")
