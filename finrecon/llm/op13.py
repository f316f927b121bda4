"""Query op13: collocations of two and three words in each language."""

from pyspark.sql import DataFrame, SparkSession

from finrecon.llm.collocations import collocations
from finrecon.llm.frames import table


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), words=3, least=10, covered=50, top=2000)


SQL = r"""
with pieces as (select row_number() over () as piece, lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as ws
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents)),
places as (select lang, piece, unnest(ws) as w1, generate_subscripts(ws, 1) as i from pieces where len(ws) > 0),
near as (select lang, w1, lead(w1, 1) over o as w2, lead(w1, 2) over o as w3 from places window o as (partition by piece order by i)),
grams as (select lang, 1 as k, w1 as phrase, [w1] as w from near union all select lang, 2, concat(w1, ' ', w2), [w1, w2] from near where w2 is not null
  union all select lang, 3, concat(w1, ' ', w2, ' ', w3), [w1, w2, w3] from near where w3 is not null),
f as (select lang, k, phrase, any_value(w) as w, cast(count(*) as hugeint) as n from grams group by lang, k, phrase),
total as (select lang, sum(n) as n from f where k = 1 group by lang),
cand as (select * from f where k > 1 and n >= 10),
cuts as (select c.lang, c.phrase, c.k, c.n as a, j.j, l.n as l, r.n as r, (1000000 * c.n * c.n) // (l.n * r.n) as score
  from cand c join (values (1), (2)) as j(j) on j.j < c.k
  join f l on l.lang = c.lang and l.k = j.j and l.phrase = array_to_string(c.w[1:j.j], ' ')
  join f r on r.lang = c.lang and r.k = c.k - j.j and r.phrase = array_to_string(c.w[j.j + 1:c.k], ' ')),
best as (select *, row_number() over (partition by lang, phrase, k order by score, j) as o from cuts),
longer as (select lang, phrase, max(n) as n from (
  select lang, n, array_to_string(w[1:2], ' ') as phrase from cand where k = 3 union all select lang, n, array_to_string(w[2:3], ' ') as phrase from cand where k = 3) group by lang, phrase),
open as (select b.* from best b left join longer x on x.lang = b.lang and x.phrase = b.phrase and b.k = 2 where b.o = 1 and (x.n is null or 100 * x.n < 50 * b.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from open)
select r.lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r.r as bigint) as r, cast(t.n as bigint) as n, cast(score as bigint) as score
from ranked r join total t on t.lang = r.lang where rank <= 2000
"""
