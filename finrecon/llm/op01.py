"""Query op1: near-duplicate groups over four-word shingles."""

from pyspark.sql import DataFrame, SparkSession

from finrecon.llm.frames import table
from finrecon.llm.minhash import near_duplicates

SHINGLE_WORDS, PERCENT = 4, 80


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=SHINGLE_WORDS, percent=PERCENT)


SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
      else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) end as sh from w),
e as (select doc_id, unnest(sh) as g from s),
n as (select doc_id, len(sh) as n from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * k >= 80 * (x.n + y.n - k)),
sides as (select a, b from l union all select b, a from l),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, sides.b from reach join sides on sides.a = reach.b),
eq as (select doc_id, min(doc_id) over (partition by list_sort(sh)) as rep from s where len(sh) > 0)
select n.doc_id, cast(n.n as bigint) as n_shingles, coalesce(eq.rep, n.doc_id) as representative_id, c.c as component_id, n.doc_id = c.c as kept
from n join (select a, min(b) as c from reach group by 1) c on c.a = n.doc_id left join eq on eq.doc_id = n.doc_id
"""
