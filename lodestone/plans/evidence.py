"""Evidence checks as queries: excerpts cut from documents, answers made of conversations, expectations as rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import evidence
from lodestone.plans.base import query
from lodestone.sources import corpus

#: A block is a document's second to fourth line, moved in by four places; that of one document in three has a letter changed.
_ALTERED = "doc_id % 3 = 1"


@query(f"""
, l as (select doc_id, n, rtrim(regexp_replace(line, '\\s+$', '')) as line from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n from docs))
, w as (select doc_id, n, line || chr(10) || lead(line) over w || chr(10) || lead(line, 2) over w as three, line <> '' and lead(line, 2) over w <> '' as whole from l window w as (partition by doc_id order by n))
, b as (select doc_id as block_id, case when {_ALTERED} then regexp_replace(three, '[aeiou]', '#') else three end as three from w where n = 2 and whole)
select block_id, count(distinct doc_id) as n_sources, count(doc_id) as n_places, coalesce(min(doc_id), -1) as first_source from b left join w on b.three = w.three and w.whole group by block_id
""")
def verbatim_excerpts(d, o, c, spark, sf_dir):
    lines = F.transform(F.slice(F.split("text", "\n"), 2, 3), lambda x: F.regexp_replace(x, r"\s+$", ""))
    three = d.select(F.col("doc_id").alias("block_id"), lines.alias("x")).filter((F.size("x") == 3) & (F.element_at("x", 1) != "") & (F.element_at("x", 3) != ""))
    code = F.array_join("x", "\n")
    code = F.when(F.expr(_ALTERED.replace("doc_id", "block_id")), F.concat(F.regexp_extract(code, "(?s)^([^aeiou]*)", 1), F.when(code.rlike("[aeiou]"), F.lit("#")).otherwise(F.lit("")), F.regexp_replace(code, "(?s)^[^aeiou]*[aeiou]?", ""))).otherwise(code)
    blocks = three.select("block_id", F.concat(F.lit("\n"), F.regexp_replace(code, "(?m)^", "    "), F.lit("\n\n")).alias("code"))
    found = evidence.excerpts(blocks, d.select(F.col("doc_id").alias("source_id"), "text"))
    n = found.groupBy("block_id").agg(F.countDistinct("source_id").alias("n_sources"), F.count("*").alias("n_places"), F.min("source_id").alias("first_source"))
    return blocks.select("block_id").join(n, "block_id", "left").na.fill(0, ["n_sources", "n_places"]).na.fill(-1, ["first_source"])


#: A conversation is an answer: its turns' lines in order, system turns' lines are first headings, each fourth line one of the second or third level.
def _answers(spark, sf_dir):
    t = corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "text"))
    t = t.withColumn("line", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "p")))
    level = F.when(F.col("role") == "system", 1).when(F.col("line") % 4 == 0, F.when(F.col("line") % 8 == 0, 3).otherwise(2)).otherwise(0)
    lines = t.select(F.col("conv_id").alias("answer_id"), "line", "text", level.alias("level"))
    verdict = F.when(F.length("text") % 3 == 0, "supported").otherwise("uncertain")
    claims = lines.filter("level = 0").select("answer_id", "line", F.lit(1).alias("nth"), F.col("text").alias("claim"), verdict.alias("verdict"), (F.length("text") % 4).alias("n_sources"))
    return lines, claims


_ANSWER = """
, t as (select conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) as text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as p from conversations)
, l as (select conv_id as answer_id, line, trim(text) as text, case when role = 'system' then 1 when line % 4 = 0 then (case when line % 8 = 0 then 3 else 2 end) else 0 end as level, length(text) % 3 = 0 and length(text) % 4 > 0 and trim(text) <> '' as good
         from (select *, row_number() over (partition by conv_id order by turn, p) as line from t))
, g as (select *, count(*) filter (level > 0) over (partition by answer_id order by line) as section from l)
, k as (select *, row_number() over (partition by answer_id, section, text order by line) as copy from g where level = 0 and good)
"""
_LEFT = """
, kept as (select answer_id, line, text, 0 as h from k where copy = 1 union all select answer_id, line, text, 1 from h)
select answer_id, count(*) filter (h = 0) as n_claims, count(*) filter (h = 1) as n_headings, string_agg(text, chr(10) || chr(10) order by line) as text from kept group by answer_id having count(*) filter (h = 0) > 0
"""


@query(_ANSWER + ", h as (select * from g where level > 0 and (answer_id, section) in (select (answer_id, section) from k))" + _LEFT)
def supported_subset(d, o, c, spark, sf_dir):
    return evidence.supported_subset(*_answers(spark, sf_dir))


@query(_ANSWER + ", h as (select * from g where level > 0 and exists (select 1 from k where k.answer_id = g.answer_id and k.line > g.line and not exists (select 1 from g b where b.answer_id = g.answer_id and b.level between 1 and g.level and b.line > g.line and b.line < k.line)))" + _LEFT)
def supported_subset_nested(d, o, c, spark, sf_dir):
    return evidence.supported_subset(*_answers(spark, sf_dir), nested=True)


#: Each conversation is a response, each of the kinds an expectation of it, with values that some meet and others don't.
_WANT = {
    "abstained": "'false'", "grounding_status": "'cited'", "answer_completeness": "'complete'", "min_valid_citations": "cast(conv_id % 4 as string)",
    "max_invalid_citations": "'1'", "min_sources": "'3'", "min_citation_coverage": "'0.5'", "min_scope_citation_coverage": "'0.25'", "max_client_duration_seconds": "'9.5'",
    "max_generation_duration_seconds": "'4'", "scope_warning": "'true'", "exploration_intent": "case when conv_id % 2 = 0 then 'direct' else 'none' end", "no_such_check": "'x'",
}
_WANTS = {"allowed_grounding_statuses": "array('cited', 'partial_citations')", "allowed_finish_reasons": "array('stop')", "required_source_projects": "array('user', 'assistant')", "required_source_paths": "array('t0', 't3')", "forbidden_answer_phrases": "array('ZZZ', 'Er')"}


@query("""
, r as (select conv_id, count(*) as n, count(*) filter (role = 'assistant') as valid, list(distinct role) as projects, list(distinct 't' || turn) as paths, sum(length(coalesce(text, ''))) as chars, max(turn) as last, coalesce(string_agg(lower(text), ' ' order by turn), '') as answer from conversations group by 1)
, c as (
select conv_id, 'abstained' as name, (n > 6) = false as ok from r union all
select conv_id, 'answer_completeness', chars % 3 = 0 from r union all
select conv_id, 'min_valid_citations', valid >= conv_id % 4 from r union all
select conv_id, 'max_invalid_citations', n - valid <= 1 from r union all
select conv_id, 'min_sources', n >= 3 from r union all
select conv_id, 'min_citation_coverage', coalesce(case when conv_id % 5 > 0 then valid / n end >= 0.5, false) from r union all
select conv_id, 'min_scope_citation_coverage', valid / (2.0 * n) >= 0.25 from r union all
select conv_id, 'max_client_duration_seconds', chars / 100.0 <= 9.5 from r union all
select conv_id, 'max_generation_duration_seconds', coalesce(case when conv_id % 7 > 0 then last end, 0) <= 4 from r union all
select conv_id, 'scope_warning', chars % 2 = 0 from r union all
select conv_id, 'exploration_intent', conv_id % 2 = 0 from r union all
select conv_id, 'allowed_finish_reasons', last % 2 = 1 from r union all
select conv_id, 'required_source_projects', list_has_all(projects, ['user', 'assistant']) from r union all
select conv_id, 'required_source_paths', list_has_all(paths, ['t0', 't3']) from r union all
select conv_id, 'forbidden_answer_phrases', not contains(answer, 'zzz') and not contains(answer, 'er') from r union all
select conv_id, 'grounding_status', valid = n from r where conv_id % 2 = 0 union all
select conv_id, 'allowed_grounding_statuses', true from r where conv_id % 2 = 1 union all
select conv_id, 'no_such_check', null from r)
select conv_id as case_id, name as "check", coalesce(ok, false) as passed, case when ok is null then 'unknown' end as problem from c
""")
def answer_expectations(d, o, c, spark, sf_dir):
    t = corpus.table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    ids = lambda on: F.collect_list(F.when(on, F.concat(F.lit("S"), "turn")))
    mine = F.coalesce(F.col("role") == "assistant", F.lit(False))
    r = t.groupBy("conv_id").agg(F.count("*").alias("n"), ids(mine).alias("citations"), ids(~mine).alias("invalid_citations"), F.collect_list(F.struct(F.col("role").alias("project"), F.concat(F.lit("t"), "turn").alias("path"))).alias("sources"), F.sum(F.length(text)).alias("chars"), F.max("turn").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("text")))), lambda x: x["text"]), " ").alias("answer"))
    valid = F.size("citations")
    responses = r.select(
        F.col("conv_id").alias("case_id"), (F.col("n") > 6).alias("abstained"), F.when(valid == F.col("n"), "cited").otherwise("partial_citations").alias("grounding_status"),
        F.when(F.col("chars") % 3 == 0, "complete").otherwise("coverage_limited").alias("answer_completeness"), "citations", "invalid_citations", "sources", F.when(F.col("conv_id") % 5 > 0, valid / F.col("n")).alias("coverage"), (valid / (2 * F.col("n"))).alias("scope_coverage"),
        F.when(F.col("last") % 2 == 1, "stop").otherwise("length").alias("finish_reason"), (F.col("chars") / 100).alias("client_seconds"), F.when(F.col("conv_id") % 7 > 0, F.col("last").cast("double")).alias("seconds"), (F.col("chars") % 2 == 0).alias("scope_warning"), F.lit("direct").alias("intent"), "answer",
    )
    one = [F.struct(F.lit(k).alias("check"), F.expr(v).alias("want"), F.lit(None).cast("array<string>").alias("wants")) for k, v in _WANT.items()]
    more = [F.struct(F.lit(k).alias("check"), F.lit(None).cast("string").alias("want"), F.expr(v).alias("wants")) for k, v in _WANTS.items()]
    rules = r.select("conv_id", F.explode(F.array(*one, *more)).alias("x")).select(F.col("conv_id").alias("case_id"), "x.*")
    rules = rules.filter("not (check = 'grounding_status' and case_id % 2 = 1) and not (check = 'allowed_grounding_statuses' and case_id % 2 = 0)")
    return evidence.expectation_checks(responses, rules).na.fill(False, ["passed"])
