"""The positional index and its ranking as queries: built once from the corpus, then asked."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.ids import tied
from lodestone.operators import fulltext
from lodestone.plans.base import query
from lodestone.sources.store import scratch

ASKED = "that thble"
#: A phrase, a word, an alternative, and what must not occur.
COMPOSED = '"the in" of or thble -whth'

_POSTINGS = """
, ws as (select chunk_id, len(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+')) as nt, list_concat(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+'), regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as w from chunks)
, post as materialized (select chunk_id, pos, w[pos] as term, pos <= nt as in_title from (select chunk_id, nt, w, unnest(range(1, len(w) + 1)) as pos from ws))
"""


def _covers(terms: str, start: str) -> str:
    """Covers from `start`, the latest start of a run that ends at an event: events are joined back to their starts by number."""
    return _POSTINGS + f"""
, ev as materialized (select *, row_number() over w as nth, sum(case when in_title then 1.0 else 2.5 end) over w as upto, lag(term) over w as term1, lag(pos) over w as pos1
          from post where term in ({terms}) window w as (partition by chunk_id order by pos))
, st as (select *, {start} as start from ev)
, mono as (select *, max(start) over (partition by chunk_id order by pos rows between unbounded preceding and 1 preceding) as past from st)
, cov as (select q.chunk_id, (q.nth - p.nth + 1) / (q.upto - p.upto + (case when p.in_title then 1.0 else 2.5 end)) / (1 + (q.pos - p.pos) - (q.nth - p.nth)) as own
          from mono q join ev p on q.chunk_id = p.chunk_id and p.nth = q.start where q.start > coalesce(past, 0))
, ranked as (select chunk_id, sum(own) / (sum(own) + 1) as rank from cov group by chunk_id)
"""


_last = lambda on, value="nth": f"max(case when {on} then {value} end) over (partition by chunk_id order by pos rows unbounded preceding)"
_word = lambda w: _last(f"term = '{w}'")
_all = lambda *starts: f"least({', '.join(starts)}) + 0 * {' + 0 * '.join(starts)}"  # noqa: E731  null if one is
_AND = _covers("'that', 'thble'", _all(_word("that"), _word("thble")))
_PHRASE = "term = 'in' and term1 = 'the' and pos1 = pos - 1"
_NONE = "max(case when term = 'whth' then 1 end) over (partition by chunk_id) is null"
_OR = _covers("'the', 'in', 'of', 'thble', 'whth'", f"greatest({_all(_last(_PHRASE, 'nth - 1'), _word('of'))}, case when {_NONE} then {_word('thble')} end)")


def _index(c, spark):
    folder = scratch(spark)
    fulltext.build_index(c, folder)
    return fulltext.open_index(spark, folder)


@query(_POSTINGS + "select term, count(*) as occurrences, count(distinct chunk_id) as chunks, count(*) filter (in_title) as in_titles from post group by term")
def positional_index(d, o, c, spark, sf_dir):
    own = _index(c, spark).groupBy("term", "chunk_id").agg(F.count("*").alias("n"), F.count_if("in_title").alias("t"))
    return own.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("chunks"), F.sum("t").alias("in_titles"))


@query(_AND + "select chunk_id, floor(rank * 1000000 + 0.5) / 1000000.0 as rank from ranked")
def cover_density(d, o, c, spark, sf_dir):
    return fulltext.cover_density(_index(c, spark), ASKED).select("chunk_id", tied(F.col("rank")).alias("rank"))


@query(_OR + "select chunk_id, floor(rank * 1000000 + 0.5) / 1000000.0 as rank from ranked")
def cover_density_composed(d, o, c, spark, sf_dir):
    return fulltext.cover_density(_index(c, spark), COMPOSED).select("chunk_id", tied(F.col("rank")).alias("rank"))


@query(_AND + """
, scored as (select c.*, branch, sha256(text) as chunk_hash, floor((10 * coalesce(rank, 0) + (case when contains(lower(path), 'that thble') then 8 else 0 end) + (case when contains(lower(title), 'that thble') then 4 else 0 end) + (case when contains(lower(text), 'that thble') then 2 else 0 end) + (case when canonical then 0.25 else 0 end)) * 1000000 + 0.5) / 1000000.0 as score
             from chunks c join pref p on c.doc_id = p.doc_id left join ranked r on r.chunk_id = c.chunk_id
             where access_class in ('public', 'lab') and (rank is not null or contains(lower(path), 'that thble') or contains(lower(title), 'that thble') or contains(lower(text), 'that thble')))
, one as (select * from (select *, row_number() over (partition by chunk_hash order by score desc, path, chunk_id) as r from scored) where r = 1)
, two as (select * from (select * exclude (r), row_number() over (partition by repository_id, path order by score desc, chunk_id) as r from one) where r <= 3)
select chunk_id, path, line, score, project || ' ' || branch || '@' || substr(repository_id || '@' || branch, 1, 12) || ' ' || path || ':L' || line || '-L' || line as citation from two order by score desc, path, chunk_id limit 10
""")
def full_text_ranked(d, o, c, spark, sf_dir):
    return fulltext.search(_index(c, spark), c, o, ASKED).select("chunk_id", "path", "line", "score", "citation")
