"""The evidence notebook as queries: a conversation is a case, its turns are facets, eight documents its sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import notebook
from lodestone.plans.base import query
from lodestone.sources import corpus

_KINDS, _STATUS = ("lexical", "agent_callers_evidence", "related", "semantic"), ("covered", "partial", "covered", "gap", "partial")


def _case(d, spark, sf_dir):
    t = corpus.table(spark, sf_dir, "conversations")
    aspect = F.concat(F.when(F.col("turn") % 3 == 0, F.lit("flow of ")).otherwise(F.lit("")), F.left(F.coalesce("text", F.lit("")), F.lit(60)), F.lit(" src"), F.col("conv_id") % 20)
    chunk = lambda k: F.concat(F.lit("d"), F.col("conv_id") + (F.col("turn") * 3 + k) % 9)
    facets = t.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("nth"), aspect.alias("aspect"), corpus.pick(F.col("turn"), _STATUS).alias("status"), F.when(F.col("turn") % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(chunk(0), chunk(1))).alias("chunk_ids"))
    cases = t.select("conv_id").distinct().select(F.col("conv_id").alias("case_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos"))
    about = d.select("doc_id", "path", "format", F.left("text", F.lit(30)).alias("title"))
    sources = cases.withColumn("doc_id", F.col("case_id") + F.col("pos")).join(about, "doc_id")
    sources = sources.select("case_id", "pos", F.concat(F.lit("S"), F.col("pos") + 1).alias("source_id"), F.concat(F.lit("d"), "doc_id").alias("chunk_id"), "path", "title", corpus.pick(F.col("pos"), _KINDS).alias("source_kind"), "format")
    questions = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question")).select(F.col("conv_id").alias("case_id"), F.left("question", F.lit(200)).alias("question"))
    return facets, sources, questions


_MATCH = lambda x: f"list_distinct(list_concat(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3), list_transform(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 6), lambda w: substr(w, 1, 6))))"
_LINKED = f"len(list_intersect(asked, {list(notebook.CONNECTING)!r})) > 0 and regexp_matches(source_kind, '{notebook.CONNECTED}')"


@query(f"""
, f as (select conv_id as case_id, turn as nth, {_MATCH("case when turn % 3 = 0 then 'flow of ' else '' end || substr(coalesce(text, ''), 1, 60) || ' src' || conv_id % 20")} as asked from conversations)
, q as (select conv_id as case_id, list_filter({_MATCH("substr(coalesce(arg_min(text, turn), ''), 1, 200)")}, lambda w: w not in {notebook.GENERIC}) as subject from conversations group by 1)
, s as materialized (select case_id, pos, 'S' || (pos + 1) as source_id, source_kind, {_MATCH("path || ' ' || substr(text, 1, 30) || ' ' || source_kind || ' ' || format")} as own
       from (select c.case_id, pos, ({list(_KINDS)!r})[pos % 4 + 1] as source_kind, d.path, d.text, d.format from (select distinct conv_id as case_id from conversations) c, range(8) r(pos), docs d where d.doc_id = c.case_id + pos))
, o as (select case_id, term from (select case_id, unnest(own) as term from s) join (select case_id, count(*) as n from s group by 1) using (case_id) group by case_id, term having count(*) >= greatest(2, (any_value(n) * 3 + 4) // 5))
, co as (select case_id, list(term) as common from o group by 1)
, x as (select *, list_filter(own, lambda w: not list_contains(coalesce(common, []), w)) as mine, list_filter(asked, lambda w: not list_contains(coalesce(common, []), w)) as facet from f join q using (case_id) join s using (case_id) left join co using (case_id))
, y as (select *, len(list_intersect(facet, mine)) as a, len(list_intersect(list_filter(facet, lambda w: w not in {notebook.GENERIC}), mine)) as b, len(list_intersect(subject, own)) as c from x)
, z as (select *, case when a = 0 then c when b = 0 and c = 0 then 0 else 8 * a + 4 * b + 2 * c end as base from y)
select case_id, nth, source_id, cast(base + (case when base > 0 and {_LINKED} then 10 else 0 end) as int) as score, cast(row_number() over (partition by case_id, nth order by base + (case when base > 0 and {_LINKED} then 10 else 0 end) desc, pos, source_id) as int) as rank from z
""")
def notebook_ranking(d, o, c, spark, sf_dir):
    return notebook.rank_sources(*_case(d, spark, sf_dir))


@query()
def notebook_sections(d, o, c, spark, sf_dir):
    return notebook.sections(notebook.facet_sources(*_case(d, spark, sf_dir)))
