"""Retrieval within scopes, and context expansion, as queries: the seeds are the best chunks of a lexical search, a place for each path."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.ids import tied
from lodestone.operators import context, search
from lodestone.plans import registry
from lodestone.plans.base import query
from lodestone.sources import corpus

_IN = "((p.project = 'P1' and branch = 'main') or p.project = 'P3') and starts_with(path, 'en/src')"
_SCOPE = {"scopes": [("P1", "main"), ("P3", None)], "path_prefix": "en/src"}


@query(registry._KNN + f"select k.doc_id, round(score, 4) as score from knn k join (select d.*, branch from docs d join pref using (doc_id)) p on p.doc_id = k.doc_id where {_IN} order by k.score desc, k.doc_id limit 10")
def knn_scoped(d, o, c, spark, sf_dir):
    return search.nearest(corpus.vectors(spark, sf_dir), d, registry._vector(spark, sf_dir), 10, occurrences=o, **_SCOPE).select("doc_id", F.round("score", 4).alias("score"))


@query(f"""
, t as (select doc_id, max(line) as target_line from chunks group by doc_id)
select chunk_id, line, branch, r from (select p.chunk_id, p.line, branch, cast(row_number() over (partition by p.doc_id order by abs(p.line - target_line), p.line) as int) as r
    from (select k.*, branch from chunks k join pref using (doc_id)) p join t on p.doc_id = t.doc_id where access_class in ('public', 'lab') and {_IN}) where r <= 5
""")
def neighborhood_scoped(d, o, c, spark, sf_dir):
    return search.neighborhood(c, c.groupBy("doc_id").agg(F.max("line").alias("target_line")), occurrences=o, **_SCOPE).select("chunk_id", "line", "branch", "r")


_BY_ID = [f"{i}:{k}" for i in (21, 1, 23, 41, 63, 3, 101, 103) for k in (2, 1)]


@query(f"select chunk_id, path, branch, cast(list_position({_BY_ID!r}, chunk_id) as int) as ordinal from (select k.*, branch from chunks k join (select doc_id, branch from occ where branch = 'main') using (doc_id)) p where access_class in ('public', 'lab') and chunk_id in ({', '.join(map(repr, _BY_ID))}) and p.project in ('P1', 'P3')")
def ids_scoped(d, o, c, spark, sf_dir):
    return search.by_ids(c, _BY_ID, occurrences=o, scopes=[("P1", None), ("P3", "main")], branch="main").select("chunk_id", "path", "branch", "ordinal")


def _placed(c):
    """Chunks whose documents stand in pairs and in directories: lib/<doc_id / 2 % 50>/<doc_id / 2>.<suffix>."""
    half = F.floor(F.col("doc_id") / 2)
    suffix = corpus.pick(F.col("doc_id"), ("hpp", "cpp", "toml", "json"))
    return c.withColumns({"path": F.concat(F.lit("lib/"), half % 50, F.lit("/"), half, F.lit("."), suffix), "chunk_hash": F.sha2("text", 256), "line_start": F.col("line"), "line_end": F.col("line"), "score": tied(1 / (1 + F.col("line")))})


_PLACED = registry._LEX + """
, pc as materialized (select * replace ('lib/' || (doc_id // 2 % 50) || '/' || doc_id // 2 || '.' || (['hpp', 'cpp', 'toml', 'json'])[doc_id % 4 + 1] as path), sha256(text) as chunk_hash, floor(1.0 / (1 + line) * 1000000 + 0.5) / 1000000.0 as score from chunks)
, seeds as materialized (select cast(row_number() over (order by s.score desc, s.path, s.line) as int) as rank, p.* from scored s join pc p using (chunk_id) order by s.score desc, s.path, s.line limit 50)
, same as (select path, min(rank) as rank from seeds where path like '%.hpp' group by path having count(*) >= 2)
, pair as (select path, min(rank) as rank from (select rank, regexp_replace(path, '\\.[a-z]+$', '') || unnest(case when path like '%.hpp' then ['.cpp', '.cc', '.cxx'] when path like '%.cpp' then ['.hpp', '.h'] else [] end) as path from seeds) where path not in (select path from seeds) group by path)
, roots as (select array_to_string((string_split(path, '/'))[1:k], '/') as root, rank, path from (select *, unnest(range(1, len(string_split(path, '/')))) as k from seeds where path like '%.json' or path like '%.toml'))
"""


def _seeds(c, o):
    top = search.lexical_matches(c, o, registry.QUERY).orderBy(F.desc("score"), "path", "line").limit(context.Policy().candidates)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path", "line"))).select("chunk_id", "rank")  # of so many rows
    return _placed(c).join(F.broadcast(ranked), "chunk_id")


@query(_PLACED + "select path, 'same_document' as reason, rank, 6 as strength from same union all select path, 'paired_source', rank, 5 from pair where path not in (select path from same)")
def context_path_hints(d, o, c, spark, sf_dir):
    return context.path_hints(_seeds(c, o)).select("path", "reason", "rank", "strength")


@query(_PLACED + """
, hint as (select path, 'same_document' as reason, rank, 6 as strength, 'same_document:' || path as grp from same union all select path, 'paired_source', rank, 5, 'paired_source:' || path from pair where path not in (select path from same))
, near as (select p.chunk_id, min(greatest(0, abs(p.line - s.line))) as distance from pc p join seeds s on s.path = p.path group by 1)
select p.chunk_id, p.path, h.reason, h.rank as source_rank, h.strength, h.grp as "group", case when reason = 'same_document' then distance else 1000000000 end as distance
from pc p join hint h on h.path = p.path left join near n on n.chunk_id = p.chunk_id where access_class in ('public', 'lab') and p.chunk_id not in (select chunk_id from seeds)
""")
def context_complements(d, o, c, spark, sf_dir):
    """Those that a path's hint finds."""
    found = context.complements(_placed(c), _seeds(c, o))
    return found.filter("reason in ('same_document', 'paired_source')").select("chunk_id", "path", "reason", "source_rank", "strength", "group", "distance")


@query()
def contextual_search(d, o, c, spark, sf_dir):
    policy, limit, per_path = context.Policy(), 10, 2
    seeds = _seeds(c, o)
    chosen = context.select_complements(context.complements(_placed(c), seeds, policy), policy)
    places = context.slots(limit, per_path, policy)
    baseline = seeds.select("rank", "chunk_id", "path", "chunk_hash", "score")
    return context.interleave(baseline.filter(F.col("rank") <= places["candidates"]), chosen, limit, per_path)
