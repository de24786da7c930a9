"""Loads into a store as queries: three runs over the corpus, the second the same as the first, the third of changed repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.ids import stable_id
from lodestone.operators import loading
from lodestone.plans import registry
from lodestone.plans.base import query
from lodestone.sources.store import Store, cut, scratch

#: The third run stages the repositories of even numbers, without one document in ten, and one in ten with other content.
_EVEN, _GONE, _NEW = "cast(substr(repository_id, 4) as int) % 2 = 0", "cast(floor(doc_id / 20.0) as bigint) % 10 = 3", "cast(floor(doc_id / 20.0) as bigint) % 10 = 4"


def _tables(d, o, c, third=False):
    d = d.select("doc_id", "repository_id", "path", "access_class", "content_hash")
    c = c.select("chunk_id", "doc_id", "repository_id", "line", F.sha2("text", 256).alias("chunk_hash"))
    o = o.select("doc_id", "repository_id", "branch", "commit_sha", "canonical")
    if third:
        d, c, o = (x.filter(_EVEN).filter(f"not ({_GONE})") for x in (d, c, o))
        d = d.withColumn("content_hash", F.when(F.expr(_NEW), F.concat("content_hash", F.lit("-2"))).otherwise(F.col("content_hash")))
        c = c.filter(f"not ({_NEW} and line = 1)")
    return {"documents": (d, ["doc_id"]), "occurrences": (o, ["doc_id", "branch"]), "chunks": (c, ["chunk_id"])}


def _loaded(d, o, c, spark):
    store = Store(spark, scratch(spark))
    done = [loading.load(store, run, _tables(d, o, c, run == 3)).withColumn("run", F.lit(run)) for run in (1, 2, 3)]
    return store, done


_STAGED = f"""
, t as (select 'documents' as name, repository_id as scope, doc_id, null as line, ({_NEW}) as fresh from docs
        union all select 'occurrences', repository_id, doc_id, null, false from occ
        union all select 'chunks', repository_id, doc_id, line, false from chunks)
, ev as (select *, ({_EVEN.replace('repository_id', 'scope')}) as ev, ({_GONE}) or (name = 'chunks' and {_NEW} and line = 1) as gone from t)
, same as (select name, scope, bool_or(gone or fresh) as moved, any_value(ev) as ev from ev group by all)
, moved as (select scope from same group by scope having any_value(ev) and bool_or(moved))
"""


@query(_STAGED + """
, n as (select name, scope, count(*) as n, count(*) filter (gone) as gone, count(*) filter (fresh and not gone) as fresh from ev group by all)
select 1 as run, scope, name, false as reused, n as inserted, 0 as updated, 0 as unchanged, 0 as deleted from n
union all select 2, scope, name, true, 0, 0, n, 0 from n
union all select 3, scope, name, false, 0, fresh, n - gone - fresh, gone from n where scope in (from moved)
union all select 3, scope, name, true, 0, 0, n, 0 from n where scope in (select scope from same where ev) and scope not in (from moved)
""")
def corpus_loads(d, o, c, spark, sf_dir):
    _, (a, b, third) = _loaded(d, o, c, spark)
    return a.union(b).union(third).select("run", "scope", "name", "reused", "inserted", "updated", "unchanged", "deleted")


@query(f"select doc_id, repository_id, content_hash || (case when ({_EVEN}) and {_NEW} then '-2' else '' end) as content_hash, 1 as first_run, case when ({_EVEN}) and {_NEW} then 3 else 1 end as updated_run from docs where not (({_EVEN}) and {_GONE})")
def corpus_after_loads(d, o, c, spark, sf_dir):
    store, _ = _loaded(d, o, c, spark)
    return store.read("documents").select("doc_id", "repository_id", "content_hash", "first_run", "updated_run")


@query(registry._REL + f"""
, s as (select 'symbols' as name, repository_id as scope, false as gone, ({_NEW}) as fresh from sym
        union all select 'relations', s.repository_id, ({_GONE.replace('doc_id', 'r.doc_id')}), false from rel r join docs s on r.doc_id = s.doc_id)
, moved as (select scope, bool_or(gone or fresh) as moved from s group by scope)
select scope, name, not any_value(moved) as reused, count(*) filter (not gone and not fresh) as unchanged, count(*) filter (fresh) as updated, count(*) filter (gone) as deleted
from s join moved using (scope) group by scope, name
""")
def semantic_map_loads(d, o, c, spark, sf_dir):
    """The map loaded twice, the second time with one symbol in ten under another name and one source's relations in ten gone."""
    symbols = registry._symbols(c).select(stable_id("doc_id", "qualified_name", "line").alias("symbol_id"), "repository_id", "doc_id", "name", "line")
    relations = registry._relations(o, c).join(d.select("doc_id", "repository_id"), "doc_id")
    relations = relations.select(stable_id("doc_id", "line", "leaf", "resolution", F.coalesce("target_doc", F.lit(-1))).alias("relation_id"), "repository_id", "doc_id", "line", "leaf", "resolution", "target_doc", "branches")
    symbols, relations = cut(symbols), cut(relations)  # each load reads them several times
    store = Store(spark, scratch(spark))
    loading.load(store, 1, {"symbols": (symbols, ["symbol_id"]), "relations": (relations, ["relation_id"])})
    renamed = symbols.withColumn("name", F.when(F.expr(_NEW), F.concat("name", F.lit("2"))).otherwise(F.col("name")))
    again = loading.load(store, 2, {"symbols": (renamed, ["symbol_id"]), "relations": (relations.filter(f"not ({_GONE})"), ["relation_id"])})
    return again.select("scope", "name", "reused", "unchanged", "updated", "deleted")
