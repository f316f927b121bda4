"""Links to documents in pages (SRC10), roots of sites in text (SRC11), and the unit that a structured filing declares (SRC8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from finrecon.operators.texts import quoted
from finrecon.plans.fixtures import fixture
from finrecon.plans.registry import query

ANCHOR = r'(?i)<a\b[^>]*\bhref="[^"]+"[^>]*>[^<]{0,200}</a>'
# Hosts that are no company's own site.
FOREIGN = (
    r"nseindia|bseindia|sebi\.gov|mca\.gov|rbi\.org|stockexchange|linkedin|twitter|facebook|instagram|youtube|google|microsoft|adobe|acrobat|kfintech|registrar|karvy|link.*intime|annualreports\.com|moneycontrol\.com|screener\.in|tickertape"
    r"|tofler\.in|instafinancials|capitaline|prowessdx|cmie|valueresearch|morningstar|investing\.com|tradingview|economictimes|livemint|businessstandard|thehindu|reuters|bloomberg"
)
# Words of a declared measure, in the order in which they are tried, and what its unit is in crore; the unit without any.
MEASURES = (("crore", 1.0), ("lakh|hundredthousand|100000", 0.01), ("million", 0.1), ("^(?!.*hundred).*thousand", 1e-4), (r"iso4217:inr|^inr$|rupee", 1e-7))
DEFAULT_UNIT, RUPEE = 0.01, 1e-7


def absolute(link: Column, base: Column) -> Column:
    """A link as a full address: its own, or from the address of its page, with steps up resolved."""
    scheme, host = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(link, r"^[^?#]*([?#].*)$", 1)
    own = F.regexp_extract(link, r"^([^?#]*)", 1)
    joined = F.when(own.startswith("/"), own).when(own == "", path).otherwise(F.concat(F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", ""), own))
    steps = F.aggregate(
        F.split(joined, "/"), F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(1)))).when(x == ".", s).otherwise(F.concat(s, F.array(x)))
    )
    ends = F.when(joined.rlike(r"(?:^|/)\.{1,2}$"), "/").otherwise("")
    resolved = F.concat(scheme, F.lit("://"), host, F.array_join(steps, "/"), ends, tail)
    return F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).otherwise(resolved)


def document_links(pages: DataFrame, ending: str = "pdf") -> DataFrame:
    """(page_id, link, text, place) of the documents that pages (page_id, url, html) point to, each address once for a page with the text of its first link: anchors, then data attributes, click handlers and bare addresses, in the order of the page."""
    dot = rf"\.{ending}"
    html = F.coalesce("html", F.lit(""))
    every = lambda pattern, group=0: F.regexp_extract_all(html, F.lit(pattern), F.lit(group))
    found = lambda links, text=None: F.transform(links, lambda x: F.struct(x.alias("raw"), (F.lit("") if text is None else text(x)).alias("text")))
    anchors = F.transform(every(ANCHOR), lambda a: F.struct(F.regexp_extract(a, r'(?i)\bhref="([^"]+)"', 1).alias("raw"), F.trim(F.regexp_extract(a, r">([^<]*)</a>$", 1)).alias("text")))
    anchors = F.filter(anchors, lambda x: F.lower(x["raw"]).endswith(f".{ending}") | F.lower(x["raw"]).contains(f".{ending}?"))
    data = every(rf'(?i)data-(?:href|url|file|src)\s*=\s*"([^"]+{dot}[^"]*)"', 1)
    clicks = F.flatten(F.transform(every(rf"""(?i)onclick\s*=\s*(?:"[^"]*{dot}[^"]*"|'[^']*{dot}[^']*')"""), lambda c: F.regexp_extract_all(c, F.lit(rf"(?i)['\"(]([^'\"()\s]+{dot}[^'\"()\s]*)"), F.lit(1))))
    bare = F.transform(every(rf"(?:https?:)?//[^\"'\s<>]+{dot}[^\"'\s<>]*"), lambda x: F.when(x.startswith("//"), F.concat(F.lit("https:"), x)).otherwise(x))
    rows = pages.select("page_id", "url", F.posexplode(F.concat(anchors, found(data), found(clicks), found(bare))).alias("place", "l"))
    full = rows.select("page_id", "place", absolute(F.col("l.raw"), F.col("url")).alias("link"), "l.text")
    return full.groupBy("page_id", "link").agg(F.min_by("text", "place").alias("text"), F.min("place").alias("place"))


def site_roots(texts: DataFrame, keys: list[str], prefer: str | None = None) -> DataFrame:
    """(keys, root, place): roots of the sites named in text, each once, from 0; full addresses first, then bare www names, those of a preferred domain before others. Hosts of exchanges, networks and data vendors are left out of full addresses, not of bare names."""
    text = F.coalesce("text", F.lit(""))
    full = F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^\s\"'<>)\]]+"), F.lit(0)), lambda u: F.concat(F.regexp_extract(u, r"^(https?://)", 1), F.lower(F.regexp_extract(F.rtrim(u, F.lit(".,;:)")), r"^https?://(?:[^/?#@]*@)?([^/?#:@]*)", 1))))
    full = F.filter(full, lambda r: r.rlike(r"//.") & ~r.rlike(FOREIGN))
    bare = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bwww\.[a-z0-9][-a-z0-9]*\.[a-z]{2,6}\b"), F.lit(0)), lambda w: F.concat(F.lit("https://"), F.lower(w)))
    rows = texts.select(*keys, F.posexplode(F.array_distinct(F.concat(full, bare))).alias("at", "root"))
    first = (~F.col("root").contains(prefer.lower())).cast("int") if prefer else F.lit(0)
    return rows.select(*keys, "root", (F.row_number().over(Window.partitionBy(*keys).orderBy(first, "at")) - 1).alias("place"))


def measure_unit(measure: Column) -> Column:
    """What a declared measure's unit is in crore, null if it tells none."""
    t = F.lower(F.trim(measure))
    out = F
    for words, unit in MEASURES:
        out = out.when(t.rlike(words), unit)
    return out.otherwise(F.lit(None).cast("double"))


def filing_units(measures: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit): the factor to crore of each filing with facts. It is that of the first declared measure (keys, ord, measure) that tells one; else it follows from the first fact (keys, ord, value_text, decimals) with decimals and a figure
    other than zero: rupees if it is rounded to 1e4 or more and large enough to be, else the default."""
    told = measures.withColumn("u", measure_unit(F.col("measure"))).where("u is not null").groupBy(*keys).agg(F.min_by("u", "ord").alias("declared"))
    value = F.abs(F.regexp_replace("value_text", ",", "").try_cast("double"))
    rounded = F.col("decimals").try_cast("int")
    usable = facts.withColumns({"v": value, "d": rounded}).where("v is not null and v <> 0 and d is not null")
    guess = F.when(((F.col("d") <= -6) & (F.col("v") > 1e7)) | ((F.col("d") <= -4) & (F.col("v") > 1e4)), RUPEE).otherwise(DEFAULT_UNIT)
    seen = usable.withColumn("g", guess).groupBy(*keys).agg(F.min_by("g", "ord").alias("guessed"))
    return facts.select(*keys).distinct().join(told, keys, "left").join(seen, keys, "left").select(*keys, F.coalesce("declared", "guessed", F.lit(DEFAULT_UNIT)).alias("unit"))


@query(
    "src10_document_links",
    """with b as (select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) as root from pages),
 l as (select page_id, concat(root, '/files/a', page_id, '.pdf') as link, 'Report ' || page_id as text, 0 as place from b union all select page_id, concat('https://cdn.example.org/x', page_id, '.PDF?v=1'), '', 1 from b
  union all select page_id, concat(root, '/d/', page_id, '.pdf'), '', 2 from b union all select page_id, concat(root, '/click', page_id, '.pdf'), '', 3 from b union all select page_id, concat('https://bare.example.net/', page_id, '.pdf'), '', 4 from b)
 select page_id, link, text, cast(row_number() over (partition by page_id order by place) - 1 as integer) as place from l""",
)
def src10_documents(spark, sf_dir):
    """Pages whose links are added in every form; the pages' own links are no documents."""
    n = F.col("page_id").cast("string")
    parts = ['<a class="x" href="/files/./b/../a', n, '.pdf" target=_blank> Report ', n, '</a><a href="/page">Page</a><A HREF="https://cdn.example.org/x', n, '.PDF?v=1"></A><i data-file="/d/', n, ".pdf\"></i><b onclick=\"window.open('/click", n, ".pdf')\"></b> //bare.example.net/", n, ".pdf <a href='no'>"]
    extra = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    pages = fixture(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", extra).alias("html"))
    found = document_links(pages)
    # An address stands where its first form does; places of later forms that repeat it leave gaps.
    return found.withColumn("place", (F.row_number().over(Window.partitionBy("page_id").orderBy("place")) - 1))


@query(
    "src11_site_names",
    f"""with r as (select page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) as root from pages), s as (select page_id, root, 0 as k from r where not regexp_matches(root, {quoted(FOREIGN)}) union all select page_id, 'https://www.linkedin.com', 1 from r union all select page_id, concat('https://www.own', page_id % 9, '.com'), 2 from r)
 select page_id, root, cast(row_number() over (partition by page_id order by not contains(root, 'own'), k) - 1 as integer) as place from s""",
)
def src11_names(spark, sf_dir):
    text = F.concat(F.lit("See "), F.col("url"), F.lit("., (https://www.LinkedIn.com/x) or WWW.own"), (F.col("page_id") % 9).cast("string"), F.lit(".COM and again "), F.col("url"))
    return site_roots(fixture(spark, sf_dir, "pages").select("page_id", text.alias("text")), ["page_id"], "own")


@query(
    "src8_filing_units",
    "select o_orderkey as filing, case o_orderkey % 7 when 0 then 1.0::double when 1 then 0.01 when 2 then 0.1 when 3 then 0.0001 when 4 then 1e-7 when 5 then case when o_totalprice > 1e4 then 1e-7 else 0.01 end else 0.01 end as unit from orders",
)
def src8_units(spark, sf_dir):
    orders = fixture(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("filing"), "o_totalprice")
    names = F.array(*map(F.lit, ("INR Crores", "HundredThousand", "in million", "Thousand", "iso4217:INR")))
    kind = (F.col("filing") % 7).cast("int")
    measures = orders.select("filing", F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.lit("xbrli:shares").alias("measure")), F.struct(F.lit(2).alias("ord"), F.get(names, kind).alias("measure"))))).select("filing", "col.*")
    facts = orders.select("filing", F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.lit("0").alias("value_text"), F.lit("-5").alias("decimals")), F.struct(F.lit(2).alias("ord"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("value_text"), F.when(kind == 5, "-5").otherwise("-2").alias("decimals")))))
    return filing_units(measures, facts.select("filing", "col.*"), ["filing"])
