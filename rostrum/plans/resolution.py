"""Queries of entity resolution over records without ids, without names and with like names, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import entities
from rostrum.plans import fixtures as X
from rostrum.plans.catalogue import query

# Ids that stand several times, empty and missing ones; names that many share, blank and missing ones.
_MIXED = """select c_custkey as n, case c_custkey % 6 when 0 then cast(null as string) when 1 then '' else concat('c', c_custkey % 40) end as candidate_id,
case c_custkey % 5 when 0 then null when 1 then ' ' else concat('person ', c_custkey % 7) end as name from {customer}"""
_KEYED = "select *, nullif(candidate_id, '') as id, nullif(trim(name), '') as nm from"


@query("dedup_nameless", f"""with r as ({_KEYED} ({_MIXED.replace('as string', 'as varchar')})), w as (select * from r where id is not null qualify row_number() over (partition by id order by n) = 1),
f as (select * from r where id is null and nm is not null qualify row_number() over (partition by nm order by n) = 1)
select n from w union all select n from f where not exists (select 1 from w where w.nm = f.nm and w.n <= f.n) union all select n from r where id is null and nm is null""")
def dedup_nameless(s, d):
    return entities.keep_first(X.view(s, d, _MIXED), "n").select("n")


_LEFT = """select c_custkey as n, case c_custkey % 4 when 0 then cast(null as string) when 1 then '' else concat('c', c_custkey % 25) end as candidate_id,
case c_custkey % 10 when 3 then null when 7 then '' else c_mktsegment end as name, c_custkey * 1.0e0 as p from {customer} where c_custkey % 2 = 0 or c_custkey % 7 = 0 or c_custkey % 3 = 0"""
_RIGHT = """select c_custkey as n, case c_custkey % 3 when 0 then cast(null as string) else concat('c', c_custkey % 30) end as candidate_id,
case c_custkey % 11 when 3 then null else lower(c_mktsegment) end as name, c_custkey * 2.0e0 as k from {customer} where c_custkey % 3 = 0 or c_custkey % 5 = 0"""
_SIDE = "select *, nullif(candidate_id, '') as id, nullif(upper(name), '') as nm from"


@query("merge_like_named", f"""with l0 as ({_SIDE} ({_LEFT.replace('as string', 'as varchar')})), r0 as ({_SIDE} ({_RIGHT.replace('as string', 'as varchar')})),
l1 as (select *, row_number() over (partition by id order by n) as i from l0 where id is not null), r1 as (select *, row_number() over (partition by id order by n) as i from r0 where id is not null),
one as (select l1.candidate_id, l1.name, l1.n, p, k from l1 join r1 using (id, i)),
l2 as (select * exclude (i) from l1 anti join r1 using (id, i) union all select * from l0 where id is null), r2 as (select * exclude (i) from r1 anti join l1 using (id, i) union all select * from r0 where id is null),
more as (select nm, greatest((select count(*) from l2 where l2.nm = x.nm and id is not null) - (select count(*) from r2 where r2.nm = x.nm and id is null), 0) as more from (select distinct nm from r2 where nm is not null) x),
l3 as (select *, row_number() over (partition by nm order by id is null, id, n) as i from l2 where nm is not null),
r3 as (select r2.*, row_number() over (partition by nm order by id is not null, id, n) + case when id is null then 0 else more end as i from r2 join more using (nm)),
two as (select coalesce(l3.candidate_id, r3.candidate_id) as candidate_id, coalesce(l3.name, r3.name) as name, coalesce(l3.n, r3.n) as n, p, k from l3 full outer join r3 on l3.nm = r3.nm and l3.i = r3.i and (l3.id is null or r3.id is null))
select * from one union all select * from two union all select candidate_id, name, n, p, null from l2 where nm is null union all select candidate_id, name, n, null, k from r2 where nm is null""")
def merge_like_named(s, d):
    return entities.merge_scores(X.view(s, d, _LEFT), X.view(s, d, _RIGHT), order="n")


@query("hr_note_repeated", """select c_custkey, c_mktsegment as category, case when c_custkey % 2 = 0 then c_name else 'first' end as note, case when c_custkey % 3 = 0 then 0.75e0 else 0.5e0 end as impact from customer""")
def hr_note_repeated(s, d):
    """Keys that stand twice, blanks about keys and values, parts without a value."""
    tag = "concat('HR_NOTE:cat=other; category = ', c_mktsegment, ' ;junk;note=first', case when c_custkey % 2 = 0 then concat(';note= ', c_name) else '' end, case when c_custkey % 3 = 0 then ';impact=0.1;impact=0.75' else ';impact=none' end)"
    return X.table(s, d, "customer").withColumn("tag", F.expr(tag)).select("c_custkey", T.hr_note("tag").alias("h")).select("c_custkey", "h.category", "h.note", "h.impact")
