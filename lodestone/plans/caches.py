"""Work that is done once, as queries: parses of two runs over the documents, vectors of a run that is broken off and one that goes on."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import caching
from lodestone.plans.base import query
from lodestone.sources.store import Store, scratch

_EVEN = "cast(substr(repository_id, 4) as int) % 2 = 0"
_PARTS = 4


@query(f"""
, k as (select distinct content_hash, format, bool_or({_EVEN}) over (partition by content_hash, format) as early from docs)
select 1 as run, count(*) filter (early) as contents, count(*) filter (early) as parsed, 0 as reused from k
union all select 2, count(*), count(*) filter (not early), count(*) filter (early) from k
""")
def parse_cache_runs(d, o, c, spark, sf_dir):
    """The first run has the repositories of even numbers, the second all."""
    store = Store(spark, scratch(spark))
    _, first = caching.parsed(store, d.filter(_EVEN), "outline-1", 1)
    first = spark.createDataFrame(first.collect(), first.schema)  # one row
    return first.union(caching.parsed(store, d, "outline-1", 2)[1])


@query("""
, t as (select doc_id, content_hash, format, text, string_split(text, chr(10)) as l from docs)
select doc_id, len(l) as n_lines, len(regexp_extract_all(text, '[^\\t\\n\\x0b\\f\\r ]+')) as n_words, len(list_filter(l, lambda x: regexp_matches(x, '^#{1,6} '))) as n_headings from t
""")
def parsed_documents(d, o, c, spark, sf_dir):
    store = Store(spark, scratch(spark))
    caching.parsed(store, d.filter(_EVEN), "outline-1", 1)
    rows, _ = caching.parsed(store, d, "outline-1", 2)
    return d.select("doc_id", "content_hash", "format").join(rows, ["content_hash", "format"]).select("doc_id", "n_lines", "n_words", "n_headings")


@query(f"""
, h as (select distinct sha256(text) as h from chunks)
, n as (select count(*) as n, count(*) filter (cast(('0x' || substr(h, 1, 8)) as bigint) % {_PARTS} < 2) as early from h)
select 1 as run, early as made, 2 as checkpoints, 0 as reused from n
union all select 2, n - early, 1, early from n
union all select 3, 0, 0, n from n
""")
def embedding_checkpoints(d, o, c, spark, sf_dir):
    """A run of four parts that ends after two, one that makes the others at once, one with nothing left to do."""
    store, texts = Store(spark, scratch(spark)), c.select(F.sha2("text", 256).alias("chunk_hash"), "text")
    n = texts.select("chunk_hash").distinct().count()
    runs = [caching.embed(store, texts, "words-1", 1, checkpoint=-(-n // _PARTS), stop_after=2), caching.embed(store, texts, "words-1", 2, checkpoint=n), caching.embed(store, texts, "words-1", 3)]
    had = [0, runs[0][0], runs[0][0] + runs[1][0]]
    return spark.createDataFrame([(k + 1, *r, had[k]) for k, r in enumerate(runs)], "run int, made long, checkpoints int, reused long")
