"""Investigations as queries: each document with calls is a case, which begins from its callers and callees."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import access, frontier, graph
from lodestone.plans import registry
from lodestone.plans.base import query


def _cases(d, o, c):
    """(results, terms, chunks that may be seen, calls between chunks)."""
    seen = access.allowed(c, ("public", "lab"))
    rel = graph.visible(registry._relations(o, c), d).filter("target_doc is not null")
    first = seen.groupBy("doc_id").agg(F.min_by("chunk_id", "line").alias("target"), F.min_by("text", "line").alias("head"))
    calls = rel.select(F.concat("doc_id", F.lit(":"), "line").alias("chunk_id"), "doc_id", "line", F.col("target_doc")).distinct()
    calls = calls.join(first.select(F.col("doc_id").alias("target_doc"), "target"), "target_doc")
    came = calls.select(F.col("target_doc").alias("case_id"), "chunk_id", F.lit("agent_callers_evidence").alias("source_kind"))
    went = calls.select(F.col("doc_id").alias("case_id"), F.col("target").alias("chunk_id"), F.lit("agent_callees_evidence"))
    about = seen.select("chunk_id", "doc_id", "line", "path", "title", "text")
    from pyspark.sql import Window

    results = came.union(went).distinct().join(about, "chunk_id")
    pos = F.row_number().over(Window.partitionBy("case_id").orderBy("source_kind", "path", "line", "chunk_id"))
    results = results.withColumn("pos", pos).select("case_id", "pos", "chunk_id", "path", "title", "text", "source_kind")
    terms = first.select(F.col("doc_id").alias("case_id"), frontier.search_terms(F.col("head")).alias("terms"))
    return results, terms, about, calls.select("chunk_id", "target")


_TERMS = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(strip_accents({x}), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+'), lambda w: length(w) >= 3 and w not in {frontier.IDLE}))"


def _frontier_sql(limit: int) -> str:
    """The selection, step by step: each step takes what the steps before have left."""
    return registry._VIS + f"""
, seen as (select * from chunks where access_class in ('public', 'lab'))
, heads as (select doc_id, arg_min(chunk_id, line) as target, arg_min(text, line) as head from seen group by 1)
, cl as (select distinct v.doc_id || ':' || v.line as chunk_id, v.doc_id, target_doc, target from vis v join heads h on h.doc_id = target_doc)
, met as (select distinct case_id, source_kind, s.chunk_id, path, line, title, text from (select target_doc as case_id, chunk_id, 'agent_callers_evidence' as source_kind from cl union select doc_id, target, 'agent_callees_evidence' from cl) x join seen s on s.chunk_id = x.chunk_id)
, nth as (select *, row_number() over (partition by case_id order by source_kind, path, line, chunk_id) - 1 as nth, count(*) over (partition by case_id) as n from met)
, sc as (select r.*, 4 * len(list_intersect({_TERMS('head')}, {_TERMS("path || ' ' || title")})) + len(list_intersect({_TERMS('head')}, {_TERMS('text')})) as score from nth r join heads h on h.doc_id = case_id)
, ev as (select distinct case_id, cast(round_even(k * (n - 1) / greatest(least(n, {limit}) - 1, 1), 0) as bigint) as nth from (select distinct case_id, n from nth), range({limit}) t(k) where k < least(n, {limit}))
, ti as (select s.*, case when max(score) over (partition by s.case_id) > 0 or e.nth is not null then 0 else 1 end as tier, regexp_replace(path, '\\.[^./]+$', '') as family from sc s left join ev e on e.case_id = s.case_id and e.nth = s.nth)
, one as (select * from (select *, row_number() over (partition by case_id, chunk_id order by tier, score desc, nth) as copy from ti) where copy = 1)
, od as materialized (select *, row_number() over (partition by case_id order by tier, score desc, nth) as o, max(score) over (partition by case_id) > 0 as scored from one)
, a as materialized (select case_id, family, o from od where o = 1)
, up as materialized (select case_id, arg_min(family, k) as family, arg_min(o, k) as o from (select od.*, (od.family = a.family, od.o) as k from od join a using (case_id) where source_kind like '%callers%') group by 1)
, down as materialized (select case_id, arg_min(family, k) as family, arg_min(o, k) as o from (select od.*, (od.family = a.family or od.family = coalesce(up.family, a.family), od.o) as k from od join a using (case_id) left join up using (case_id) where source_kind like '%callees%') group by 1)
, three as materialized (select case_id, o, family, min(phase) as phase from (select *, 0 as phase from (select case_id, family, o from a) union all select case_id, family, o, 1 from up union all select case_id, family, o, 2 from down) group by all)
, other as (select case_id, family, min(o) as o from od where (score > 0 or not scored) and (case_id, family) not in (select case_id, family from three) group by 1, 2)
, wide as (select case_id, o from (select *, row_number() over (partition by case_id order by o) as k from other) join (select case_id, count(distinct o) as taken from three group by 1) using (case_id) where k <= greatest({min(limit, max(3, limit - 2))} - taken, 1))
, ph as (select od.*, coalesce((select min(phase) from three t where t.case_id = od.case_id and t.o = od.o), (select 3 from wide w where w.case_id = od.case_id and w.o = od.o), case when score > 0 then 4 else 5 end) as phase from od)
select case_id, chunk_id, place from (select *, row_number() over (partition by case_id order by phase, o) as place from ph) where place <= {limit}
"""


@query(_frontier_sql(8))
def frontier_selection(d, o, c, spark, sf_dir):
    results, terms, _, _ = _cases(d, o, c)
    return frontier.select_frontier(results, terms, 8).select("case_id", "chunk_id", "place")


@query(_frontier_sql(3))
def frontier_selection_short(d, o, c, spark, sf_dir):
    results, terms, _, _ = _cases(d, o, c)
    return frontier.select_frontier(results, terms, 3).select("case_id", "chunk_id", "place")


@query()
def frontier_expansion(d, o, c, spark, sf_dir):
    return frontier.expand(*_cases(d, o, c))
