"""Query op4: verdicts of url rules for pages."""

from pyspark.sql import DataFrame, SparkSession

from finrecon.llm.frames import table
from finrecon.llm.urlfilter import filtered

#: The rules of the query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return filtered(table(spark, sf_dir, "pages"), rules)


SQL = r"""
with cut as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
parts as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
rules(rhost, rpath, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
met as (select p.*, rhost || rpath as rule, verdict, row_number() over (partition by page_id order by length(rhost || rpath) desc nulls last) as k
  from parts p left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from met where k = 1
"""
