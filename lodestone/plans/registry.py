"""The engine's operators as queries over the derived corpus, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.ids import slug, stable_id, tied
from lodestone.functions import ids, text
from lodestone.functions.text import bounded, citation_ids, leaf_name
from lodestone.plans.base import QUERIES, SQL, query  # noqa: F401  the registered ones
from lodestone.operators import access, answers, chunking, graph, investigation, rollups, search
from lodestone.sources import corpus

QUERY, TERM, VECTOR = "that thble", "thble", 0
SEED_LIMIT = 10



def _count(needle: str) -> str:
    return f"((length(h) - length(replace(h, '{needle}', ''))) / {len(needle)}.0)"


_damp = lambda c: f"(case when {c} > 0 then 1 + ln({c}) else 0 end)"
_grid = lambda x: f"floor(({x}) * 1000000 + 0.5) / 1000000.0"
_words = QUERY.split()
_LEX = f"""
, hits as (select c.*, p.branch, p.canonical, lower(path || chr(10) || title || chr(10) || text) as h from chunks c join pref p on c.doc_id = p.doc_id where access_class in ('public', 'lab'))
, scored as (select *, sha256(text) as chunk_hash, {_grid(f"8 * {_damp(_count(QUERY))} + " + " + ".join(f"{_damp(_count(w))} + (case when contains(lower(path), '{w}') then 2 else 0 end)" for w in _words) + " + (case when canonical then 0.25 else 0 end)")} as score from hits where contains(h, '{QUERY}') or {" or ".join(f"contains(h, '{w}')" for w in _words)})
, one as (select * from (select *, row_number() over (partition by chunk_hash order by score desc, path, line) as r from scored) where r = 1)
, two as (select * exclude (r) from (select * exclude (r), row_number() over (partition by repository_id, path order by score desc, path, line) as r from one) where r <= 2)
"""
_OUT = ["chunk_id", "path", "line", "score", "citation"]
_cite = "project || ' ' || branch || '@' || substr(repository_id || '@' || branch, 1, 12) || ' ' || path || ':L' || line || '-L' || line as citation"


@query(_LEX + f"select chunk_id, path, line, score, {_cite} from two order by score desc, path, line limit 10")
def lexical_search(d, o, c, spark, sf_dir):
    return search.lexical_search(c, o, QUERY).select(*_OUT)


@query(_LEX + f"select chunk_id, path, line, score, {_cite} from scored order by score desc, path, line limit 10")
def lexical_search_dupes(d, o, c, spark, sf_dir):
    return search.lexical_search(c, o, QUERY, duplicates=True).select(*_OUT)


@query(_LEX + "select chunk_id, score from two")
def diversify_ranked(d, o, c, spark, sf_dir):
    return search.diversify_ranked(search.lexical_matches(c, o, QUERY), 2, [F.desc("score"), F.col("path"), F.col("line")]).select("chunk_id", "score")


_fts = lambda col, w: f"cast(len(list_filter(regexp_split_to_array(lower({col}), '[^a-z0-9à-ÿ]+'), lambda x: x = '{w}')) as double)"
_r = " + ".join(f"({_fts('title', w)} + 0.4 * {_fts('text', w)})" for w in _words)


@query(f"""
, m as (select c.*, p.canonical, {" and ".join(f"{_fts('text', w)} > 0" for w in _words)} as fts, cast({_r} as double) as r from chunks c join pref p on c.doc_id = p.doc_id where access_class in ('public', 'lab'))
select chunk_id, {_grid(f"10 * (case when fts then r / (r + 1) else 0 end) + (case when contains(lower(path), '{QUERY}') then 8 else 0 end) + (case when contains(lower(title), '{QUERY}') then 4 else 0 end) + (case when contains(lower(text), '{QUERY}') then 2 else 0 end) + (case when canonical then 0.25 else 0 end)")} as score from m where fts or contains(lower(path), '{QUERY}') or contains(lower(text), '{QUERY}') order by score desc, path, line limit 10
""")
def full_text_search(d, o, c, spark, sf_dir):
    return search.full_text_search(c, o, QUERY).select("chunk_id", "score")


_IDS = [f"{i}:{k}" for i in (0, 5, 6, 11, 10) for k in (2, 1)]


@query(f"select chunk_id, path, text, cast(list_position({_IDS!r}, chunk_id) as int) as ordinal from chunks where access_class in ('public', 'lab') and chunk_id in ({', '.join(map(repr, _IDS))})")
def search_by_ids(d, o, c, spark, sf_dir):
    return search.by_ids(c, _IDS).select("chunk_id", "path", "text", "ordinal")


@query("""
, t as (select doc_id, max(line) as target_line from chunks group by doc_id)
select chunk_id, line, r, 1000.0 - r as score from (select chunk_id, line, cast(row_number() over (partition by c.doc_id order by abs(line - target_line), line) as int) as r from chunks c join t on c.doc_id = t.doc_id where access_class in ('public', 'lab')) where r <= 5
""")
def chunk_neighborhood(d, o, c, spark, sf_dir):
    return search.neighborhood(c, c.groupBy("doc_id").agg(F.max("line").alias("target_line"))).select("chunk_id", "line", "r", "score")


@query("select doc_id, branch, canonical from pref")
def preferred_occurrence(d, o, c, spark, sf_dir):
    return access.preferred_occurrence(o).select("doc_id", "branch", "canonical")


@query("select doc_id, string_agg(branch, ',' order by canonical desc, branch) as branches, count(*) as n from occ group by doc_id")
def occurrence_rollup(d, o, c, spark, sf_dir):
    return access.occurrence_rollup(o)


_COS = "list_dot_product(cast(embedding as double[]), q) / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) / sqrt(list_dot_product(q, q))"
_KNN = f", qv as (select cast(embedding as double[]) as q from embeddings where vec_id = {VECTOR}), knn as (select vec_id as doc_id, {_grid(_COS)} as score from embeddings, qv where vec_id in (select doc_id from docs where access_class in ('public', 'lab')))"


def _vector(spark, sf_dir) -> list[float]:
    return corpus.table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == VECTOR).first()["embedding"]


@query(_KNN + "select doc_id, round(score, 4) as score from knn order by knn.score desc, doc_id limit 10")
def knn_cosine(d, o, c, spark, sf_dir):
    return search.nearest(corpus.vectors(spark, sf_dir), d, _vector(spark, sf_dir), 10).select("doc_id", F.round("score", 4).alias("score"))


@query(_LEX + _KNN + """
, lex as (select doc_id, row_number() over (order by s desc, doc_id) as rank from (select doc_id, max(score) as s from scored group by doc_id order by s desc, doc_id limit 50))
, sem as (select doc_id, row_number() over (order by score desc, doc_id) as rank from (select * from knn order by score desc, doc_id limit 50))
, al as (select doc_id, 1.0 / (60 + rank) as part from lex union all select doc_id, 1.0 / (60 + rank) from sem)
select doc_id, floor(sum(part) * 1000000 + 0.5) / 1000000.0 as rrf, count(*) as n_lists from al group by doc_id
""")
def rrf_hybrid(d, o, c, spark, sf_dir):
    from pyspark.sql import Window

    lex = search.lexical_matches(c, o, QUERY).groupBy("doc_id").agg(F.max("score").alias("s")).orderBy(F.desc("s"), "doc_id").limit(50)
    sem = search.nearest(corpus.vectors(spark, sf_dir), d, _vector(spark, sf_dir), 50)
    ranked = lambda x, s: x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(s), "doc_id")))  # noqa: E731  of 50 rows
    fused = search.reciprocal_rank_fusion([ranked(lex, "s"), ranked(sem, "score")], "doc_id")
    return fused.select("doc_id", tied(F.col("rrf")).alias("rrf"), "n_lists")


@query()
def diversify_greedy(d, o, c, spark, sf_dir):
    from pyspark.sql import Window

    top = search.lexical_matches(c, o, QUERY).orderBy(F.desc("score"), "path", "line").limit(200)
    return search.diversify_greedy(top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path", "line"))), 20, 1)


@query(_LEX + """
, s as (select distinct doc_id, path from (select * from two order by score desc, path, line limit 10))
, r as (select doc_id, array_to_string((string_split(path, '/'))[1:k], '/') as root from (select doc_id, path, unnest(range(1, len(string_split(path, '/')))) as k from s))
, f as (select root, count(distinct doc_id) as n_docs from r group by root having count(distinct doc_id) >= 2)
select root, n_docs from f where not exists (select 1 from f g where g.root <> f.root and regexp_replace(g.root, '/[^/]*$', '') = f.root)
""")
def context_bundles(d, o, c, spark, sf_dir):
    return search.directory_bundles(search.lexical_search(c, o, QUERY).select("doc_id", "path").distinct())


@query("""
select d.repository_id, project, documents, coalesce(occurrences, 0) as occurrences, coalesce(branches, 0) as branches, branch_names, coalesce(canonical_branches, '') as canonical_branches, coalesce(chunks, 0) as chunks, coalesce(embedded, 0) as embedded
from (select repository_id, min(project) as project, count(*) as documents from docs group by repository_id) d
left join (select repository_id, count(*) as occurrences, count(distinct branch) as branches, string_agg(distinct branch, ',' order by branch) as branch_names, string_agg(distinct branch, ',' order by branch) filter (where canonical) as canonical_branches from occ group by repository_id) o on d.repository_id = o.repository_id
left join (select repository_id, count(*) as chunks from chunks group by repository_id) c on d.repository_id = c.repository_id
left join (select repository_id, count(*) as embedded from docs where doc_id in (select vec_id from embeddings) group by repository_id) e on d.repository_id = e.repository_id
""")
def repo_status(d, o, c, spark, sf_dir):
    return rollups.repository_status(d, o, c, corpus.vectors(spark, sf_dir))


@query("select (select count(*) from docs) as documents, (select count(*) from occ) as occurrences, (select count(*) from chunks) as chunks, (select count(*) from embeddings) as vectors")
def db_status(d, o, c, spark, sf_dir):
    one = lambda x, n: x.agg(F.count("*").alias(n))
    return one(d, "documents").join(F.broadcast(one(o, "occurrences"))).join(F.broadcast(one(c, "chunks"))).join(F.broadcast(one(corpus.vectors(spark, sf_dir), "vectors")))


@query("select label, count(*) as vectors, count(distinct len(embedding)) as widths from embeddings group by label", pre=False)
def embedding_status(d, o, c, spark, sf_dir):
    return corpus.vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("vectors"), F.countDistinct(F.size("embedding")).alias("widths"))


@query("select user_id, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id", pre=False)
def latest_run(d, o, c, spark, sf_dir):
    runs = corpus.table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("run"))
    return rollups.latest(runs, "user_id", "run").select("user_id", "run.ts", "run.event_id")


_STRUCT = "select repository_id, {by} as {name}, count(*) as documents, cast(coalesce(sum(n), 0) as bigint) as chunks, cast(sum(size_bytes) as bigint) as bytes from docs d left join (select doc_id, count(*) as n from chunks group by doc_id) c on d.doc_id = c.doc_id group by all"


@query(_STRUCT.format(by="format", name="fmt"))
def repo_structure_formats(d, o, c, spark, sf_dir):
    return rollups.structure(d, c, F.col("format"), "fmt")


@query(_STRUCT.format(by="string_split(path, '/')[1]", name="top"))
def repo_structure_top_level(d, o, c, spark, sf_dir):
    return rollups.structure(d, c, F.substring_index("path", "/", 1), "top")


_AUTH = "((case when name like 'readme%' then (case when depth = 0 then 12 else 7 end) else 0 end) + (case when depth = 0 then 4 else 0 end) + (case when name in ('cmakelists.txt', 'makefile', 'dockerfile', 'readme') then 3 else 0 end) + (case when regexp_matches(lower(path), '(^|/)docs?/') then 2 else 0 end) - (case when regexp_matches(lower(path), 'draft|wip|provisional|tmp') then 6 else 0 end))"
_PAGES = "pg as (select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', ''), '/$', '') || '.html' as path, length(html) as size from pages)"


def _pages(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[?#].*$", ""), "/$", "")
    return corpus.table(spark, sf_dir, "pages").select("page_id", F.concat(path, F.lit(".html")).alias("path"), F.length("html").cast("long").alias("size"))


@query(f"with {_PAGES} select page_id, path, cast({_AUTH} as int) as authority from (select *, lower(regexp_replace(path, '^.*/', '')) as name, length(path) - length(replace(path, '/', '')) as depth from pg)", pre=False)
def overview_authority(d, o, c, spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "path", rollups.authority(F.col("path")).alias("authority"))


_FORMAT = "coalesce(case regexp_extract(lower(regexp_replace(path, '^.*/', '')), '\\.([^.]+)$', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in rollups.SUFFIX_FORMATS.items()) + " end, 'unknown')"
_REASON = f"case when regexp_matches(path, '(^|/)(\\.git|node_modules|build|__pycache__)/') then 'excluded_directory' when regexp_matches(path, '^docs/html/') then 'generated_documentation' when regexp_matches(lower(path), '(^|/)(\\.env|id_rsa|.*\\.pem|.*\\.key|credentials[^/]*)$') then 'possible_secret' when regexp_matches(lower(path), '\\.(png|jpg|gif|zip|gz|pdf|exe|so|o|a|bin|mp4)$') then 'binary_or_large_result' when {_FORMAT} = 'unknown' then 'unsupported_format' when size > 4000 then 'file_too_large' end"


@query(f"with {_PAGES} select page_id, path, {_FORMAT} as format, {_REASON} as reason from pg", pre=False)
def inventory_classify(d, o, c, spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "path", rollups.classify_format(F.col("path")).alias("format"), rollups.exclusion_reason(F.col("path"), F.col("size"), 4000).alias("reason"))


@query(f"with {_PAGES} select coalesce(reason, 'indexable') as reason, count(*) as files, cast(sum(size) as bigint) as bytes from (select *, {_REASON} as reason from pg) group by 1", pre=False)
def inventory_summary(d, o, c, spark, sf_dir):
    return _pages(spark, sf_dir).groupBy(F.coalesce(rollups.exclusion_reason(F.col("path"), F.col("size"), 4000), F.lit("indexable")).alias("reason")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("select path, case when regexp_matches(path, '^(?:de/.*|.*/doc_1[0-9]*\\.py)$') then 'profile_excluded' when not regexp_matches(path, '^(?:.*\\.md|.*\\.?pp|.*\\.py|.*\\.[ch]pp)$') then 'outside_profile_scope' else 'kept' end as verdict from docs".replace("|.*\\.?pp", ""))
def glob_policy(d, o, c, spark, sf_dir):
    return rollups.glob_policy(d.select("path"), ["*.md", "*.[ch]pp", "*.py"], ["de/*", "*/doc_1*([0-9]).py"])


@query("""
, b as (select repository_id, substr(sha256(path), 1, 2) as b, sha256(string_agg(path || chr(0) || content_hash || chr(10), '' order by path || chr(0) || content_hash || chr(10))) as h from docs group by 1, 2)
select repository_id, sha256(string_agg(h, '' order by b)) as snapshot from b group by 1
""")
def snapshot_hash(d, o, c, spark, sf_dir):
    return rollups.snapshot_hash(d, "repository_id")


@query("select project, content_hash, access_class, count(*) as copies, count(distinct branch) as branches, min(d.doc_id) as first_doc from docs d left join occ o on d.doc_id = o.doc_id group by all")
def document_dedup(d, o, c, spark, sf_dir):
    return d.join(o.select("doc_id", "branch"), "doc_id", "left").groupBy("project", "content_hash", "access_class").agg(F.count("*").alias("copies"), F.countDistinct("branch").alias("branches"), F.min("doc_id").alias("first_doc"))


@query("select doc_id, document_id, sha256(document_id || chr(0) || '1' || chr(0) || 'p1' || chr(0)) as first_chunk_id, trim(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '-') as slug from docs")
def stable_ids(d, o, c, spark, sf_dir):
    return d.select("doc_id", "document_id", stable_id("document_id", F.lit(1), F.lit("p1")).alias("first_chunk_id"), slug(F.col("path")).alias("slug"))


@query()
def chunk_windows(d, o, c, spark, sf_dir):
    return chunking.chunk_windows(d).drop("text")


_MD = ", src as (select doc_id, regexp_replace(text, '(^|\\n)([A-Z][a-zéèê]*\\.)', '\\1## \\2', 'g') as text from docs where format = 'md')"


@query()
def heading_sections(d, o, c, spark, sf_dir):
    marked = d.filter("format = 'md'").select("doc_id", F.regexp_replace("text", r"(?m)^(\S+)\.", "## $1.").alias("text"))
    return chunking.heading_sections(marked)


_SYM = ", sym as (select doc_id, repository_id, path, access_class, trim(split_part(split_part(text, ' ', 1), '.', 1)) as name, repository_id || '::' || trim(split_part(split_part(text, ' ', 1), '.', 1)) as qualified_name, line from (select *, row_number() over (partition by doc_id order by line) as r from chunks) where r = 1)"
_REL = _SYM + """
, calls as (select doc_id, repository_id, line, split_part(split_part(text, ' ', 1), '.', 1) as leaf from (select *, row_number() over (partition by doc_id order by line) as r from chunks) where r > 1)
, nn as (select repository_id, lower(name) as l, count(distinct doc_id) as n from sym group by 1, 2)
, there as (select s.repository_id, lower(s.name) as l, o.branch, count(distinct s.doc_id) as here, min(s.doc_id) as target_doc from sym s join occ o on s.doc_id = o.doc_id group by 1, 2, 3)
, res as (select c.doc_id, c.line, c.leaf, o.branch, case when here > 1 then 'unresolved' when n = 1 then 'unique_name' else 'branch_unique' end as resolution, case when here = 1 then target_doc end as target_doc from calls c join nn on c.repository_id = nn.repository_id and lower(c.leaf) = nn.l join occ o on c.doc_id = o.doc_id join there t on t.repository_id = c.repository_id and t.l = lower(c.leaf) and t.branch = o.branch)
, rel as (select doc_id, line, leaf, resolution, target_doc, string_agg(distinct branch, ',' order by branch) as branches from res group by all)
"""


def _symbols(c):
    name = F.trim(F.substring_index(F.substring_index("text", " ", 1), ".", 1))  # before the shuffle, which then leaves the lines' texts behind
    one = rollups.first_by(c.select("doc_id", "repository_id", "path", "access_class", name.alias("name"), "line"), ["doc_id"], [F.col("line")])
    return one.select("doc_id", "repository_id", "path", "access_class", "name", F.concat("repository_id", F.lit("::"), "name").alias("qualified_name"), "line")


def _relations(o, c):
    from pyspark.sql import Window

    calls = c.select("doc_id", "repository_id", "line", F.substring_index(F.substring_index("text", " ", 1), ".", 1).alias("leaf"))
    later = calls.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))).filter("_r > 1").drop("_r")
    return graph.resolve_calls(later, _symbols(c), o)


@query(_REL + "select * replace (coalesce(target_doc, -1) as target_doc) from rel")
def call_resolution(d, o, c, spark, sf_dir):
    return _relations(o, c).na.fill(-1, ["target_doc"])


@query(_REL + "select resolution, count(*) as relations, count(distinct doc_id) as sources, count(target_doc) as resolved from rel group by 1")
def relation_kind_counts(d, o, c, spark, sf_dir):
    return graph.relation_summary(_relations(o, c))


@query(_SYM + f"""
select s.doc_id, name, {_grid("(case when lower(qualified_name) = 'the' then 20 when lower(name) = 'the' then 16 else 8 end) + (case when contains(lower(path), 'the') then 4 else 0 end) + (case when canonical then 0.25 else 0 end)")} as score from sym s join pref p on s.doc_id = p.doc_id where access_class in ('public', 'lab') and contains(lower(qualified_name), 'the') order by score desc, path, line, s.doc_id limit 10
""")
def symbol_search(d, o, c, spark, sf_dir):
    return graph.symbol_search(_symbols(c).join(access.preferred_occurrence(o), "doc_id"), "the").select("doc_id", "name", "score")


@query(_REL + """
select r.doc_id, r.line, leaf, resolution, coalesce(case when t.access_class in ('public', 'lab') then target_doc end, -1) as target_doc, case when t.access_class in ('public', 'lab') then t.path end as target_path, case when lower(leaf) = 'the' then 20.0 else 8.0 end as score from rel r join docs s on r.doc_id = s.doc_id left join docs t on r.target_doc = t.doc_id where s.access_class in ('public', 'lab') and contains(lower(leaf), 'the') order by score desc, r.doc_id, r.line, leaf, case when t.access_class in ('public', 'lab') then target_doc end nulls last, resolution limit 10
""")
def relation_search(d, o, c, spark, sf_dir):
    return graph.relation_search(_relations(o, c), d, "the").na.fill(-1, ["target_doc"])


_VIS = _REL + ", vis as (select rel.* from rel join docs s on rel.doc_id = s.doc_id left join docs t on rel.target_doc = t.doc_id where s.access_class in ('public', 'lab') and (rel.target_doc is null or t.access_class in ('public', 'lab')))"
_HUB = "(select min(target_doc) from (select target_doc, count(*) as n from vis where target_doc is not null group by 1) where n = (select max(n) from (select count(*) as n from vis where target_doc is not null group by target_doc)))"


def _hub(rel):
    """The most called document, the first of those: one row."""
    return rel.filter("target_doc is not null").groupBy("target_doc").count().orderBy(F.desc("count"), "target_doc").first()[0]


@query(_VIS + f"select doc_id, min(line) as line, count(*) as calls from vis where target_doc = {_HUB} group by 1")
def callers(d, o, c, spark, sf_dir):
    rel = graph.visible(_relations(o, c), d)
    return graph.callers(rel, _hub(rel))


@query(_VIS + f"select target_doc, min(line) as line, count(*) as calls from vis where doc_id = {_HUB} and target_doc is not null group by 1")
def callees(d, o, c, spark, sf_dir):
    rel = graph.visible(_relations(o, c), d)
    return graph.callees(rel, _hub(rel))


@query(_VIS + f"""
, both_ends as (select doc_id as other, 0 as priority, line from vis where target_doc = {_HUB} union all select target_doc, 1, line from vis where doc_id = {_HUB} and target_doc is not null)
select other, priority, line from (select *, row_number() over (partition by other order by priority, line) as r from both_ends where other <> {_HUB}) where r = 1
""")
def related_chunks(d, o, c, spark, sf_dir):
    rel = graph.visible(_relations(o, c), d)
    return graph.related(rel, _hub(rel))


@query("""
, w as (select conv_id as doc_id, role as kind, 'T' || (conv_id % 3) as title, turn * 2 + 1 as line_start, turn * 2 + 1 + length(coalesce(text, '')) % 5 as line_end from conversations)
select doc_id, kind, title, line_start, line_end, title as name, sha256(doc_id || chr(0) || kind || chr(0) || title || chr(0) || line_start || chr(0)) as symbol_id from (select *, max(line_end) over (partition by doc_id, kind, title order by line_start, line_end rows between unbounded preceding and 1 preceding) as until from w) where until is null or line_start > until
""")
def symbol_islands(d, o, c, spark, sf_dir):
    t = corpus.table(spark, sf_dir, "conversations")
    start = F.col("turn") * 2 + 1
    w = t.select(F.col("conv_id").alias("doc_id"), F.col("role").alias("kind"), F.concat(F.lit("T"), F.col("conv_id") % 3).alias("title"), start.alias("line_start"), (start + F.length(F.coalesce("text", F.lit(""))) % 5).alias("line_end"))
    return graph.symbol_islands(w)


_scoped = "((project = 'P1' and branch = 'main') or project = 'P3')"


@query(f"select c.chunk_id, project, branch from chunks c join pref p on c.doc_id = p.doc_id where access_class in ('public', 'lab') and {_scoped} and starts_with(path, 'en/src')")
def scope_filter(d, o, c, spark, sf_dir):
    rows = access.allowed(c, ("public", "lab")).join(access.preferred_occurrence(o), "doc_id")
    return search.in_scope(rows, [("P1", "main"), ("P3", None)], "en/src").select("chunk_id", "project", "branch")


@query(_REL + """
, s as (select case when lower(qualified_name) = 'the' then 20.0 when lower(name) = 'the' then 16.0 else 8.0 end as score, 'symbol' as result_type, 's' || doc_id as item_id, path, line from sym where access_class in ('public', 'lab') and contains(lower(qualified_name), 'the'))
, r as (select case when lower(leaf) = 'the' then 20.0 else 8.0 end as score, 'relation' as result_type, 'r' || r.doc_id || ':' || line || ':' || leaf || ':' || coalesce(case when t.access_class in ('public', 'lab') then target_doc end, -1) as item_id, d.path, line from rel r join docs d on r.doc_id = d.doc_id left join docs t on t.doc_id = r.target_doc where d.access_class in ('public', 'lab') and contains(lower(leaf), 'the'))
select * from (select * from s union all select * from r) order by score desc, path, line, item_id limit 10
""")
def semantic_map_search(d, o, c, spark, sf_dir):
    q, seen = "the", access.allowed(d, ("public", "lab")).select("doc_id", "path")
    s = access.allowed(_symbols(c), ("public", "lab")).filter(F.lower("qualified_name").contains(q))
    s = s.select(F.when(F.lower("qualified_name") == q, 20.0).when(F.lower("name") == q, 16.0).otherwise(8.0).alias("score"), F.concat(F.lit("s"), "doc_id").alias("item_id"), "path", "line")
    r = _relations(o, c).filter(F.lower("leaf").contains(q)).join(seen, "doc_id")
    r = r.join(seen.select(F.col("doc_id").alias("target_doc"), F.lit(True).alias("_open")), "target_doc", "left").withColumn("target_doc", F.when(F.col("_open"), F.col("target_doc")))
    r = r.select(F.when(F.lower("leaf") == q, 20.0).otherwise(8.0).alias("score"), F.concat(F.lit("r"), "doc_id", F.lit(":"), "line", F.lit(":"), "leaf", F.lit(":"), F.coalesce("target_doc", F.lit(-1))).alias("item_id"), "path", "line")
    return graph.search_map(s, r)


@query(_REL + """
select coalesce(s.repository_id, r.repository_id) as repository_id, coalesce(symbols, 0) as symbols, coalesce(relations, 0) as relations, coalesce(resolved, 0) as resolved
from (select repository_id, count(*) as symbols from sym group by 1) s full join (select repository_id, count(*) as relations, count(target_doc) as resolved from rel join docs using (doc_id) group by 1) r on s.repository_id = r.repository_id
""")
def semantic_map_status(d, o, c, spark, sf_dir):
    return graph.map_status(_symbols(c), _relations(o, c).join(d.select("doc_id", "repository_id"), "doc_id"))


@query("""
, k as (select doc_id, repository_id, repository_id || doc_id // 60 as p, format, access_class from docs)
, pairs as (select a.doc_id as source_doc, b.doc_id as header_doc, a.access_class as x, b.access_class as y from k a join k b on a.p = b.p and a.repository_id = b.repository_id and a.format = 'cpp' and b.format = 'f90')
, rk(c, r) as (values ('public', 0), ('lab', 1), ('project', 2), ('restricted', 3), ('pending', 4))
select source_doc, header_doc, min(case when x.r >= y.r then x.c else y.c end) as access_class, string_agg(distinct o1.branch, ',' order by o1.branch) as branches from pairs join rk x on x.c = pairs.x join rk y on y.c = pairs.y join occ o1 on o1.doc_id = source_doc join occ o2 on o2.doc_id = header_doc and o1.branch = o2.branch and o1.commit_sha = o2.commit_sha group by 1, 2
""")
def companion_pairs(d, o, c, spark, sf_dir):
    block = F.floor(F.col("doc_id") / 60)
    grouped = d.withColumn("path", F.concat("repository_id", block, F.lit("/stem."), "format"))
    return graph.companions(grouped, o, headers=("f90",))


@query("select 'duplicate_document' as \"check\", count(*) as violations from (select document_id from docs group by 1 having count(*) > 1) union all select 'chunk_without_document', count(*) from chunks where doc_id not in (select doc_id from docs) union all select 'empty_path', count(*) from docs where path is null or path = ''")
def corpus_validation(d, o, c, spark, sf_dir):
    return rollups.validate(d, c)


_OLD = ", old as (select doc_id, path, content_hash, access_class from docs where doc_id % 5 <> 1), new as (select doc_id, path, case when doc_id % 11 = 0 then 'sha256:new' else content_hash end as content_hash, access_class from docs where doc_id % 7 <> 3)"


def _versions(d):
    columns = ["doc_id", "path", "content_hash", "access_class"]
    new = d.filter("doc_id % 7 <> 3").withColumn("content_hash", F.when(F.col("doc_id") % 11 == 0, "sha256:new").otherwise(F.col("content_hash")))
    return d.filter("doc_id % 5 <> 1").select(columns), new.select(columns)


@query(_OLD + " select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.doc_id is null then 'insert' when n.doc_id is null then 'delete' when o.path is not distinct from n.path and o.content_hash is not distinct from n.content_hash and o.access_class is not distinct from n.access_class then 'keep' else 'update' end as action from old o full join new n on o.doc_id = n.doc_id")
def upsert_diff(d, o, c, spark, sf_dir):
    old, new = _versions(d)
    return rollups.upsert_actions(old, new, "doc_id", ["path", "content_hash", "access_class"])


@query(_OLD + " select * from new union all select * from old where doc_id not in (select doc_id from new)")
def upsert_rows(d, o, c, spark, sf_dir):
    old, new = _versions(d)
    return rollups.upsert(old, new, "doc_id")


@query(_OLD + " select chunk_id from chunks where doc_id not in (select doc_id from new)")
def stale_cleanup(d, o, c, spark, sf_dir):
    return c.join(_versions(d)[1].select("doc_id"), "doc_id", "left_anti").select("chunk_id")


@query("select doc_id, sha256('Project: ' || project || chr(10) || 'Path: ' || path || chr(10) || 'Format: ' || format || chr(10) || 'Content: ' || text) as input_hash from docs where access_class <> 'pending' and doc_id not in (select vec_id from embeddings)")
def embedding_backlog(d, o, c, spark, sf_dir):
    text = F.concat(F.lit("Project: "), "project", F.lit("\nPath: "), "path", F.lit("\nFormat: "), "format", F.lit("\nContent: "), "text")
    return rollups.backlog(d, corpus.vectors(spark, sf_dir)).select("doc_id", F.sha2(text, 256).alias("input_hash"))


#: A user's turn is a question: what begins it goes by the turn, the project that it names, if any, by the conversation.
_BEGIN = ("Give an overview of ", "Compare ", "Where is ", "How does it work in ", "List ", "Which file has ", "What is the difference to ")
_Q = "q as (select conv_id * 1000 + turn as question_id, case (conv_id + turn) % 7 " + " ".join(f"when {k} then '{t}'" for k, t in enumerate(_BEGIN)) + " end || case when conv_id % 3 = 0 then '' else 'P' || conv_id % 7 || ' ' end || coalesce(text, '') as question from conversations where role = 'user')"


def _questions(spark, sf_dir):
    t = corpus.table(spark, sf_dir, "conversations").filter("role = 'user'")
    named = F.when(F.col("conv_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("P"), F.col("conv_id") % 7, F.lit(" ")))
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.concat(corpus.pick(F.col("conv_id") + F.col("turn"), _BEGIN), named, F.coalesce("text", F.lit(""))).alias("question"))


@query(f"with {_Q} select question_id, case " + " ".join(f"when regexp_matches(lower(question), '{p}') then '{n}'" for n, p in answers.INTENTS) + " else 'direct' end as intent from q", pre=False)
def intent_classification(d, o, c, spark, sf_dir):
    return _questions(spark, sf_dir).select("question_id", answers.intent(F.col("question")).alias("intent"))


@query(f", {_Q}" + ", n as (select question_id, string_agg(distinct project, ',' order by project) as projects from (select question_id, unnest(regexp_split_to_array(lower(question), '[^a-z0-9]+')) as w from q) join (select distinct project from docs) on lower(project) = w group by 1) select q.question_id, coalesce(projects, '*') as projects, case when projects is null then 'broad' else 'projects' end as mode from q left join n on q.question_id = n.question_id")
def scope_resolution(d, o, c, spark, sf_dir):
    return answers.scopes(_questions(spark, sf_dir), d)


@query("select repository_id, case when max(case when branch = 'feature/x' then 1 else 0 end) = 1 then 'feature/x' else min(branch) filter (where canonical) end as branch, case when max(case when branch = 'feature/x' then 1 else 0 end) = 1 then 'configured' when min(branch) filter (where canonical) is not null then 'canonical' else 'none' end as status from occ group by 1")
def preferred_branch(d, o, c, spark, sf_dir):
    return answers.preferred_branch(o, "feature/x")


@query(_LEX + """
, g as (select project as grp, chunk_id, row_number() over (partition by project order by score desc, path, line) as pos from two)
select grp, cast(pos as int) as pos, chunk_id from g where pos <= 20 order by pos, grp limit 20
""")
def scope_interleave(d, o, c, spark, sf_dir):
    from pyspark.sql import Window

    rows = search.diversify_ranked(search.lexical_matches(c, o, QUERY), 2, [F.desc("score"), F.col("path"), F.col("line")])
    pos = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), "path", "line"))
    return answers.interleave(rows.select(F.col("project").alias("grp"), pos.alias("pos"), "chunk_id").filter("pos <= 20"), 20)


@query()
def context_budget(d, o, c, spark, sf_dir):
    from pyspark.sql import Window

    top = search.lexical_search(c, o, QUERY, limit=8)
    return answers.pack(top.select(F.row_number().over(Window.orderBy(F.desc("score"), "path", "line")).alias("pos"), "chunk_id", F.length("text").alias("n_chars")), 1000, 80)


@query("""
, b as (select doc_id, text, substr(text, 1, 115) as h, right(text, 78) as t from docs)
, n as (select *, case when contains(h, chr(10)) then length(h) - strpos(reverse(h), chr(10)) else -1 end as e, strpos(t, chr(10)) as s from b)
select doc_id, case when length(text) <= 200 then text else (case when e >= 57 then substr(h, 1, e) else h end) || chr(10) || '[...]' || chr(10) || (case when s > 0 and s - 1 <= 39 then substr(t, s + 1) else t end) end as text from n
""")
def bounded_text(d, o, c, spark, sf_dir):
    return d.select("doc_id", bounded(F.col("text"), 200).alias("text"))


_ANS = "ans as (select conv_id * 1000 + turn as answer_id, '# Answer' || chr(10) || '- ' || coalesce(text, '') || ' [S' || (conv_id % 4 + 1) || case when turn % 3 = 0 then ', S2]' else ' text]' end || chr(10) || coalesce(text, '') || chr(10) || 'Sources of it:' || chr(10) || '```' || chr(10) || 'code [S1]' || chr(10) || '```' as text from conversations where role = 'assistant')"


def _answers(spark, sf_dir):
    t = corpus.table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    said = F.coalesce("text", F.lit(""))
    end = F.when(F.col("turn") % 3 == 0, ", S2]").otherwise(" text]")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.concat(F.lit("# Answer\n- "), said, F.lit(" [S"), F.col("conv_id") % 4 + 1, end, F.lit("\n"), said, F.lit("\nSources of it:\n```\ncode [S1]\n```")).alias("text"))


_CITE = r"'\[(S[0-9]+(?:[ ]*[,;][ ]*S[0-9]+)*)\]', 1"
_IDS_OF = lambda t: f"flatten(list_transform(regexp_extract_all({t}, {_CITE}), lambda g: regexp_extract_all(g, 'S[0-9]+')))"


@query(f"with {_ANS} select answer_id, array_to_string({_IDS_OF('text')}, ',') as cited from ans", pre=False)
def citation_id_lists(d, o, c, spark, sf_dir):
    return _answers(spark, sf_dir).select("answer_id", F.array_join(citation_ids(F.col("text")), ",").alias("cited"))


_UNITS = f"""with {_ANS}
, ls as (select answer_id, p, l from (select answer_id, unnest(string_split(text, chr(10))) as l, unnest(range(0, len(string_split(text, chr(10))))) as p from ans))
, fs as (select *, sum(case when starts_with(trim(l), '```') then 1 else 0 end) over (partition by answer_id order by p rows between unbounded preceding and current row) as f, trim(regexp_replace(l, '^\\s*[-*]\\s+|\\[S[0-9][^\\]]*\\]', '', 'g')) as unit from ls)
, units as (select answer_id, cast(p as int) as p, unit, array_to_string({_IDS_OF('l')}, ',') as cited from fs where f % 2 = 0 and not starts_with(trim(l), '```') and not regexp_matches(l, '^\\s*#') and length(unit) >= 12 and regexp_matches(unit, '[A-Za-zÀ-ÿ]') and not (length(unit) <= 60 and ends_with(unit, ':')))
, cov as (select answer_id, count(*) as units, count(*) filter (where cited <> '') as cited_units, count(*) filter (where cited <> '') / count(*) as coverage from units group by 1)
"""


@query(_UNITS + "select * from units", pre=False)
def factual_units(d, o, c, spark, sf_dir):
    return answers.factual_units(_answers(spark, sf_dir))


@query(_UNITS + "select * from cov", pre=False)
def citation_coverage(d, o, c, spark, sf_dir):
    return answers.coverage(answers.factual_units(_answers(spark, sf_dir)))


@query(_UNITS + f"""
, used as (select distinct answer_id, unnest({_IDS_OF('text')}) as s from ans)
, chk as (select answer_id, count(*) filter (where s in ('S1', 'S2', 'S3')) as valid, count(*) filter (where s not in ('S1', 'S2', 'S3')) as invalid from used group by 1)
select a.answer_id, coalesce(valid, 0) as valid, coalesce(invalid, 0) as invalid, case when coalesce(invalid, 0) > 0 then 'invalid_citations' when coalesce(valid, 0) = 0 then 'missing_citations' when coalesce(coverage, 1) < 1 then 'partial_citations' else 'cited' end as status from ans a left join chk on a.answer_id = chk.answer_id left join cov on a.answer_id = cov.answer_id
""", pre=False)
def grounding_status(d, o, c, spark, sf_dir):
    a = _answers(spark, sf_dir)
    return answers.grounding(a, a.select("answer_id", F.explode(F.array(F.lit("S1"), F.lit("S2"), F.lit("S3"))).alias("source_id")))


@query(f"""with {_ANS}
, cl as (select answer_id as claim_id, array_to_string({_IDS_OF('text')}, ',') as cited from ans)
, fi as (select claim_id, case when claim_id % 3 = 0 then 'supported' when claim_id % 3 = 1 then 'contradicted' else 'supported' end as verdict, 'S' || (claim_id % 4 + 1) as s from cl where claim_id % 5 <> 0)
select cl.claim_id, case when verdict is null then 'uncertain' when verdict = 'supported' and not list_contains(string_split(cited, ','), s) then 'unsupported' else verdict end as verdict from cl left join fi on cl.claim_id = fi.claim_id
""", pre=False)
def verdict_normalization(d, o, c, spark, sf_dir):
    claims = _answers(spark, sf_dir).select(F.col("answer_id").alias("claim_id"), F.array_join(citation_ids(F.col("text")), ",").alias("cited"))
    i = F.col("claim_id")
    findings = claims.filter(i % 5 != 0).select("claim_id", F.when(i % 3 == 1, "contradicted").otherwise("supported").alias("verdict"), F.concat(F.lit("S"), i % 4 + 1).alias("source_id"))
    return answers.verdicts(claims, findings)


_EVAL = """
, cs as (select item_id as case_id, string_split(text, ' ')[1] as w1, string_split(text, ' ')[2] as w2 from benchmark)
, res as (select case_id, path, row_number() over (partition by case_id order by doc_id) as rank from cs join (select distinct doc_id, path, w[k] || ' ' || w[k + 1] as phrase from (select doc_id, path, string_split(text, ' ') as w, unnest(range(1, len(string_split(text, ' ')))) as k from docs)) on phrase = w1 || ' ' || w2)
, ex as (select case_id, k as exp_id, case k when 0 then 'en/' when 1 then 'fr/' else 'de/' end as path_prefix, 3 * (k + 1) as within_rank from cs, (values (0), (1), (2)) as t(k))
, met as (select ex.case_id, exp_id, min(rank) as first_rank from ex join res on ex.case_id = res.case_id and starts_with(path, path_prefix) group by 1, 2)
, ranks as (select ex.case_id, ex.exp_id, cast(first_rank as int) as first_rank, coalesce(first_rank, 1000000000) <= within_rank as met from ex left join met on ex.case_id = met.case_id and ex.exp_id = met.exp_id)
"""


def _ranks(d, spark, sf_dir):
    from pyspark.sql import Window

    word = lambda k: F.element_at(F.split("text", " "), k)
    cases = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.concat_ws(" ", word(1), word(2)).alias("phrase"))
    w = F.split("text", " ")  # a text's two-word phrases, so that cases meet texts in an equi-join
    phrases = d.select("doc_id", "path", F.explode(F.array_distinct(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y)))).alias("phrase"))
    results = cases.join(phrases.filter("phrase is not null"), "phrase")
    results = results.select("case_id", "path", F.row_number().over(Window.partitionBy("case_id").orderBy("doc_id")).alias("rank"))
    k = F.col("exp_id")
    expectations = cases.select("case_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("exp_id")).select("case_id", "exp_id", F.element_at(F.array(F.lit("en/"), F.lit("fr/"), F.lit("de/")), k + 1).alias("path_prefix"), (3 * (k + 1)).alias("within_rank"))
    return answers.first_ranks(results, expectations)


@query(_EVAL + "select * replace (coalesce(first_rank, -1) as first_rank) from ranks")
def eval_ranks(d, o, c, spark, sf_dir):
    return _ranks(d, spark, sf_dir).na.fill(-1, ["first_rank"])


@query(_EVAL + f", pc as (select case_id, min(case when met then 1 else 0 end) as passed, sum(case when met then 1 else 0 end) as met, count(*) as n, min(first_rank) as best from ranks group by 1) select count(*) as cases, cast(sum(passed) as bigint) as passed, {_grid('sum(met) / sum(n)')} as recall, {_grid('avg(coalesce(1.0 / best, 0))')} as mrr from pc")
def eval_summary(d, o, c, spark, sf_dir):
    return answers.summary(_ranks(d, spark, sf_dir)).select("cases", "passed", tied(F.col("recall")).alias("recall"), tied(F.col("mrr")).alias("mrr"))


@query("select project, bool_and(access_class in ('public', 'lab') or doc_id % 5 > 1) as access_ok, bool_and(starts_with(path, 'en/') or starts_with(path, 'fr/')) as prefix_ok, count(*) as rows_checked from docs group by 1")
def filter_contract(d, o, c, spark, sf_dir):
    ok = F.col("access_class").isin("public", "lab") | (F.col("doc_id") % 5 > 1)
    return d.groupBy("project").agg(F.bool_and(ok).alias("access_ok"), F.bool_and(F.col("path").startswith("en/") | F.col("path").startswith("fr/")).alias("prefix_ok"), F.count("*").alias("rows_checked"))


@query(f"""
, w as (select doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 4))) as term from chunks)
select term, count(distinct doc_id) as df, {_grid("ln(((select count(distinct doc_id) from chunks) + 1) / (count(distinct doc_id) + 1)) + 1")} as rarity from w group by 1
""")
def term_rarity(d, o, c, spark, sf_dir):
    return answers.term_rarity(c).select("term", "df", tied(F.col("rarity")).alias("rarity"))


@query("select doc_id, qualified_name, name from (select doc_id, 'a::b::' || repository_id || ':: ' || title as qualified_name, trim(title) as name from chunks)")
def leaf_names(d, o, c, spark, sf_dir):
    q = F.concat(F.lit("a::b::"), "repository_id", F.lit(":: "), "title")
    return c.select("doc_id", q.alias("qualified_name"), leaf_name(q).alias("name"))


@query("select repository_id, branch, count(*) as documents, count(distinct commit_sha) as commits from occ where branch = 'main' or branch like 'feature/%' group by 1, 2")
def branch_filter(d, o, c, spark, sf_dir):
    return o.filter((F.col("branch") == "main") | F.col("branch").rlike(rollups.glob_regex("feature/*"))).groupBy("repository_id", "branch").agg(F.count("*").alias("documents"), F.countDistinct("commit_sha").alias("commits"))


@query("""
, m as (select repository_id, doc_id from occ where branch = 'main'), x as (select repository_id, branch, doc_id from occ where branch <> 'main')
, ah as (select repository_id, branch, count(*) filter (where doc_id not in (select doc_id from m)) as ahead, count(*) as n from x group by 1, 2)
, bh as (select a.repository_id, a.branch, count(*) as behind from ah a join m on a.repository_id = m.repository_id left join x on x.doc_id = m.doc_id and x.branch = a.branch where x.doc_id is null group by 1, 2)
select a.repository_id, a.branch, ahead, coalesce(behind, 0) as behind, case when ahead = n then 'unrelated' when ahead = 0 and coalesce(behind, 0) = 0 then 'same_commit' when ahead = 0 then 'merged' when coalesce(behind, 0) = 0 then 'ahead' else 'diverged' end as relation from ah a left join bh b on a.repository_id = b.repository_id and a.branch = b.branch
""")
def compare_branches(d, o, c, spark, sf_dir):
    main = o.filter("branch = 'main'").select("repository_id", "doc_id")
    other = o.filter("branch <> 'main'").select("repository_id", "branch", "doc_id")
    seen = other.join(main.select("doc_id", F.lit(1).alias("_m")), "doc_id", "left")
    ahead = seen.groupBy("repository_id", "branch").agg(F.sum(F.col("_m").isNull().cast("long")).alias("ahead"), F.count("*").alias("n"), F.count("_m").alias("common"))
    total = main.groupBy("repository_id").agg(F.count("*").alias("_total"))
    out = ahead.join(total, "repository_id", "left").withColumn("behind", F.coalesce("_total", F.lit(0)) - F.col("common"))
    a, b = F.col("ahead"), F.col("behind")
    return out.select("repository_id", "branch", "ahead", "behind", F.when(a == F.col("n"), "unrelated").when((a == 0) & (b == 0), "same_commit").when(a == 0, "merged").when(b == 0, "ahead").otherwise("diverged").alias("relation"))


@query("""with r as (select page_id, case page_id % 4 when 0 then 'refs/heads/' when 1 then 'refs/remotes/origin/' when 2 then 'origin/' else '' end || url as ref from pages),
b as (select page_id, regexp_replace(trim(ref), '^(refs/remotes/origin/|refs/heads/|origin/)', '') as branch from r),
p as (select page_id, branch, list_transform(string_split(branch, '/'), lambda x: {'x': x, 's': coalesce(nullif(regexp_replace(regexp_replace(x, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'branch')}) as p from b)
select page_id, branch, 'branches/' || array_to_string(list_transform(p, lambda y: case when y.s = y.x then y.x else y.s || '--' || substr(sha256(y.x), 1, 8) end), '/') || '.generated.yaml' as path from p""", pre=False)
def branch_catalog_paths(d, o, c, spark, sf_dir):
    prefix = F.when(F.col("page_id") % 4 == 0, "refs/heads/").when(F.col("page_id") % 4 == 1, "refs/remotes/origin/").when(F.col("page_id") % 4 == 2, "origin/").otherwise("")
    rows = corpus.table(spark, sf_dir, "pages").select("page_id", ids.canonical_branch(F.concat(prefix, "url")).alias("branch"))
    return rows.withColumn("path", ids.catalog_path(F.col("branch")))


@query("""
, n as (select doc_id, count(*) as chunks, arg_min(title, line) as title from chunks group by 1)
select d.doc_id, d.repository_id, path, branch, canonical, coalesce(chunks, 0) as chunks, case when not contains(path, '/') or starts_with(lower(regexp_extract(path, '[^/]*$')), 'readme') or (format = 'md' and length(path) - length(replace(path, '/', '')) <= 2) then title end as anchor_title from docs d join pref p on d.doc_id = p.doc_id left join n on d.doc_id = n.doc_id
""")
def scoped_documents(d, o, c, spark, sf_dir):
    return rollups.scoped_documents(d, access.preferred_occurrence(o).select("doc_id", "branch", "canonical"), c)


@query("""
, n as (select doc_id, count(*) as chunks from chunks group by 1)
, f as (select repository_id, format as name, count(*) as documents, sum(coalesce(chunks, 0)) as chunks from docs left join n using (doc_id) group by 1, 2)
, t as (select repository_id, string_split(path, '/')[1] as name, count(*) as documents from docs group by 1, 2)
, fx as (select repository_id, string_agg(name || ' (' || documents || ')', ', ' order by documents desc, name) filter (r <= 12) as fmt, sum(documents) as documents, cast(sum(chunks) as bigint) as chunks from (select *, row_number() over (partition by repository_id order by documents desc, name) as r from f) group by 1)
, tx as (select repository_id, string_agg(name || ' (' || documents || ')', ', ' order by documents desc, name) filter (r <= 16) as top from (select *, row_number() over (partition by repository_id order by documents desc, name) as r from t) group by 1)
select repository_id, 'Documents: ' || documents || '; chunks: ' || chunks || chr(10) || 'Formats: ' || fmt || chr(10) || 'Top level: ' || top as text from fx join tx using (repository_id)
""")
def structure_sources(d, o, c, spark, sf_dir):
    return rollups.structure_text(rollups.structure(d, c, F.col("format"), "fmt"), rollups.structure(d, c, F.substring_index("path", "/", 1), "top"))


_SAID = "said as (select conv_id * 1000 + turn as unit_id, coalesce(text, '') || case when turn % 2 = 0 then ' See this. (And) that! 7 more [S' || (turn % 3 + 1) || ', S1].' else ' All main, projects? Not so. [S3] The Principais  projetos' end as text from conversations)"


def _sentences(text: str) -> str:
    for pattern, to in answers.SENTENCES:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


def _said(spark, sf_dir):
    t = corpus.table(spark, sf_dir, "conversations")
    end = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" See this. (And) that! 7 more [S"), F.col("turn") % 3 + 1, F.lit(", S1]."))).otherwise(" All main, projects? Not so. [S3] The Principais  projetos")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("unit_id"), F.concat(F.coalesce("text", F.lit("")), end).alias("text"))


@query(f"""with {_SAID}
, s as (select unit_id, text, list_filter(list_transform(string_split({_sentences('text')}, chr(10)), lambda x: trim(x)), lambda x: x <> '') as parts from said)
, t as (select unit_id, case when len(parts) > 0 then parts else [trim(text)] end as parts from s)
, u as (select *, list_sort(list_distinct({_IDS_OF("parts[-1]")})) as tail, len(list_filter(parts, lambda x: len(regexp_extract_all(x, {_CITE})) > 0)) as n from t)
, v as (select unit_id, len(parts) > 1 and n = 1 and len(tail) > 0 as inherits, ' [' || array_to_string(tail, ', ') || ']' as suffix, unnest(parts) as claim, unnest(range(0, len(parts))) as p from u)
select unit_id, cast(p as int) as p, case when inherits and len(regexp_extract_all(claim, {_CITE})) = 0 then claim || suffix else claim end as claim from v
""", pre=False)
def atomic_claims(d, o, c, spark, sf_dir):
    return answers.atomic_claims(_said(spark, sf_dir))


@query(f"with {_SAID} select unit_id, regexp_matches(regexp_replace(translate(lower(text), 'áàâãäçéèêëíìîïñóòôõöúùûü', 'aaaaaceeeeiiiinooooouuuu'), '[^a-z0-9]+', ' ', 'g'), '{answers.OVERCLAIMS}') as overclaims from said", pre=False)
def overview_overclaims(d, o, c, spark, sf_dir):
    return _said(spark, sf_dir).select("unit_id", answers.overclaims(F.col("text")).alias("overclaims"))


@query("select event_type as suite, count(*) as cases, count(*) filter (event_id % 3 <> 0) as passed, round(count(*) filter (event_id % 3 <> 0) / count(*), 6) as pass_rate, round(avg(value), 4) as mean_duration, round(avg(event_id % 10), 4) as mean_coverage from events group by 1", pre=False)
def evaluation_report(d, o, c, spark, sf_dir):
    cases = corpus.table(spark, sf_dir, "events").select(F.col("event_type").alias("suite"), (F.col("event_id") % 3 != 0).alias("passed"), F.col("value").alias("duration"), (F.col("event_id") % 10).alias("coverage"))
    return answers.report(cases, "suite")


_TOOLS = ("find_callers", "find_callees", "open_related", "open_neighborhood", "search_text")


@query(f"""
, st as (select (['{"', '".join(_TOOLS)}'])[1 + line % 5] as tool, chunk_id as origin, lead(chunk_id, 1, chunk_id) over (partition by doc_id order by line) as result from chunks)
, fr as (select tool, case when tool = 'find_callers' then result else origin end as f, case when tool = 'find_callers' then origin else result end as t from st where tool <> 'search_text' and origin <> result)
select 'edge:' || substr(sha256(tool || chr(0) || f || chr(0) || t), 1, 20) as edge_id, 'chunk:' || f as source, 'chunk:' || t as target, case tool when 'open_related' then 'related' when 'open_neighborhood' then 'neighbor' else 'calls' end as kind, tool in ('find_callers', 'find_callees') as directed, tool from fr
""")
def traversal_edges(d, o, c, spark, sf_dir):
    from pyspark.sql import Window

    result = F.lead("chunk_id").over(Window.partitionBy("doc_id").orderBy("line"))
    return investigation.traversal_edges(c.select(corpus.pick(F.col("line"), _TOOLS).alias("tool"), F.col("chunk_id").alias("origin"), F.coalesce(result, "chunk_id").alias("result")))


@query(", sc(project, branch) as (values ('P0', null), ('P1', 'main'), ('P2', 'dev'), ('P2', 'main')) select d.doc_id, d.project, p.branch from docs d join pref p on d.doc_id = p.doc_id where exists (select 1 from sc where sc.project = d.project and (sc.branch is null or sc.branch = p.branch))")
def scope_post_filter(d, o, c, spark, sf_dir):
    scopes = spark.createDataFrame([("P0", None), ("P1", "main"), ("P2", "dev"), ("P2", "main")], "project string, branch string")
    return investigation.in_scope(d.join(access.preferred_occurrence(o).select("doc_id", "branch"), "doc_id"), scopes).select("doc_id", "project", "branch")


@query("""with w as (select conv_id as case_id, turn as aspect, unnest(string_split(text, ' ')) as chunk_id, unnest(range(1, len(string_split(text, ' ')) + 1)) as pos from conversations),
k as (select case_id, chunk_id, min(pos) as q from (select case_id, aspect * 1000000 + pos as pos, chunk_id from w where length(chunk_id) >= 6 union all select distinct case_id, 5, 'seen before' from w) group by 1, 2),
n as (select w.case_id, w.aspect, w.chunk_id, min(w.pos) as pos from w join k on w.case_id = k.case_id and w.chunk_id = k.chunk_id group by 1, 2, 3),
u as (select case_id, chunk_id, case when row_number() over (partition by case_id, aspect order by pos, chunk_id) = 1 then 0 else 1 end as late, aspect as a, pos as q from n union all select case_id, chunk_id, 2, 0, q from k),
f as (select * from (select *, row_number() over (partition by case_id, chunk_id order by late, a, q) as r from u) where r = 1)
select case_id, chunk_id, cast(row_number() over (partition by case_id order by late, a, q, chunk_id) as int) as place from f""", pre=False)
def kept_chunk_priority(d, o, c, spark, sf_dir):
    turns = corpus.table(spark, sf_dir, "conversations")
    words = turns.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("aspect"), F.posexplode(F.split("text", " ")).alias("pos", "chunk_id")).withColumn("pos", F.col("pos") + 1)
    kept = words.filter(F.length("chunk_id") >= 6).select("case_id", (F.col("aspect").cast("long") * 1000000 + F.col("pos")).alias("pos"), "chunk_id")
    seen = words.select("case_id").distinct().select("case_id", F.lit(5).cast("long").alias("pos"), F.lit("seen before").alias("chunk_id"))
    return investigation.kept_priority(kept.unionByName(seen), words)


@query(_UNITS + """
, once as (select answer_id, unit, cited, min(p) as p, count(*) as copies from (select answer_id, p, unit, cited from units union all select answer_id, p + 100000, unit, cited from units where p % 2 = 0) group by 1, 2, 3)
select answer_id, cast(p as int) as p, copies, cast((row_number() over (partition by answer_id order by p) - 1) // 5 as int) as batch from once
""", pre=False)
def claim_batches(d, o, c, spark, sf_dir):
    units = answers.factual_units(_answers(spark, sf_dir)).withColumnRenamed("unit", "claim")
    return investigation.claim_batches(units.unionByName(units.filter("p % 2 = 0").withColumn("p", F.col("p") + 100000)))


@query("select project, count(*) as claims, count(*) filter (v = 0) as supported, count(*) filter (v = 1) as unsupported, count(*) filter (v = 2) as contradicted, count(*) filter (v = 3) as uncertain, count(*) filter (v = 0) = count(*) as passed from (select project, case when project = 'P1' then 0 else doc_id % 4 end as v from docs) group by 1")
def verdict_counts(d, o, c, spark, sf_dir):
    verdict = F.when(F.col("project") == "P1", "supported").otherwise(corpus.pick(F.col("doc_id"), ("supported", "unsupported", "contradicted", "uncertain")))
    return investigation.verdict_counts(d.select("project", verdict.alias("verdict")), "project")


@query("""
, m as (select repository_id, branch, doc_id, commit_sha from occ union all select repository_id, 'release', doc_id, commit_sha from occ where branch = 'main')
, n as (select repository_id, commit_sha, count(distinct doc_id) as documents, count(distinct branch) > 1 as shared_commit from m group by 1, 2)
select distinct m.repository_id, m.commit_sha, m.branch, documents, shared_commit from m join n on m.repository_id = n.repository_id and m.commit_sha = n.commit_sha
""")
def branch_sync(d, o, c, spark, sf_dir):
    own = o.select("repository_id", "branch", "doc_id", "commit_sha")
    return investigation.branch_sync(own.unionByName(own.filter("branch = 'main'").withColumn("branch", F.lit("release"))))


@query("""
, f as (select format, case when size_bytes > 1500 then 'file_too_large' else 'included' end as reason, string_split(path, '/')[1] as top, size_bytes from docs)
select dimension, value, count(*) as files, cast(sum(size_bytes) as bigint) as bytes from (select 'format' as dimension, format as value, size_bytes from f union all select 'reason', reason, size_bytes from f union all select 'top', top, size_bytes from f) group by 1, 2
""")
def inventory_rollups(d, o, c, spark, sf_dir):
    reason = F.when(F.col("size_bytes") > 1500, "file_too_large").otherwise("included")
    return investigation.inventory_rollups(d.select("format", reason.alias("reason"), F.substring_index("path", "/", 1).alias("top"), "size_bytes"))


@query("select doc_id, path, case when format = 'txt' then 'unknown' else format end as format, case when doc_id % 3 = 0 then 'arquivo' else project end as title, case when doc_id % 4 = 0 then 'text' else 'code' end as kind, doc_id % 9 <> 0 as valid from (select doc_id, case when doc_id % 9 = 0 then '' else path end as path, format, project from docs)")
def load_projection(d, o, c, spark, sf_dir):
    i = F.col("doc_id")
    raw = d.select("doc_id", F.when(i % 9 == 0, "").otherwise(F.col("path")).alias("path"), F.when(F.col("format") != "txt", F.col("format")).alias("format"), F.when(i % 3 == 0, "").otherwise(F.col("project")).alias("title"), F.when(i % 4 != 0, "code").alias("kind"))
    return investigation.load_rows(raw)


@query("""
, kn as (select distinct repository_id as case_id, chunk_id from chunks where access_class in ('public', 'lab'))
, so as (select repository_id as case_id, doc_id as pos, chunk_id from chunks where access_class in ('public', 'lab') and format = 'md' and line = 1)
, nx as (select repository_id as case_id, doc_id * 100000 + line as pos, chunk_id as source, lead(chunk_id) over (partition by doc_id order by line) as target from chunks)
, ed as (select *, row_number() over (partition by case_id order by pos, source || '>' || target) as r from nx where exists (select 1 from kn where kn.case_id = nx.case_id and kn.chunk_id = nx.source) and exists (select 1 from kn where kn.case_id = nx.case_id and kn.chunk_id = nx.target))
, wa as (select * from ed where r <= 36)
, un as (select case_id, chunk_id, 0 as late, pos, 0 as e from so union all select case_id, source, 1, pos, 0 from wa union all select case_id, target, 1, pos, 1 from wa)
, fi as (select * from (select *, row_number() over (partition by case_id, chunk_id order by late, pos, e) as r from un) where r = 1)
, nd as (select * from (select case_id, chunk_id, row_number() over (partition by case_id order by late, pos, e, chunk_id) as place from fi) where place <= 24)
select case_id, 'node' as item, chunk_id as item_id, cast(place as int) as place from nd
union all select case_id, 'edge', source || '>' || target, 0 from wa where exists (select 1 from nd where nd.case_id = wa.case_id and nd.chunk_id = wa.source) and exists (select 1 from nd where nd.case_id = wa.case_id and nd.chunk_id = wa.target)
""")
def bounded_graph(d, o, c, spark, sf_dir):
    from pyspark.sql import Window

    seen = access.allowed(c, ("public", "lab"))
    case = F.col("repository_id").alias("case_id")
    following = F.lead("chunk_id").over(Window.partitionBy("doc_id").orderBy("line"))
    walked = c.select(case, (F.col("doc_id") * 100000 + F.col("line")).alias("pos"), F.col("chunk_id").alias("source"), following.alias("target")).filter("target is not null")
    sources = seen.filter("format = 'md' and line = 1").select(case, F.col("doc_id").alias("pos"), "chunk_id")
    nodes, edges = investigation.bounded_graph(seen.select(case, "chunk_id"), sources, walked.withColumn("edge_id", F.concat("source", F.lit(">"), "target")))
    shown = nodes.select("case_id", F.lit("node").alias("item"), F.col("chunk_id").alias("item_id"), "place")
    return shown.unionByName(edges.select("case_id", F.lit("edge").alias("item"), F.col("edge_id").alias("item_id"), F.lit(0).alias("place")))


from lodestone.plans import caches, context, evidence, fulltext, history, investigations, ledgers, loads, notebooks, sourcecode  # noqa: E402, F401  register their queries
