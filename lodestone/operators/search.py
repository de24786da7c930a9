"""Retrieval: lexical, full text, vectors, fusion, diversification, neighbourhoods."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.ids import citation, tied
from lodestone.functions.text import occurrences_of
from lodestone.operators.access import allowed, preferred_occurrence

TOKEN = re.compile(r"[\wÀ-ÖØ-öø-ÿ:.+/-]+")


def lexical_score(query: str, path: Column, title: Column, text: Column, canonical: Column) -> Column:
    """Damped counts of the phrase and its words in path, title and text; more for words in the path and canonical texts."""
    q = query.lower()
    h, p, damp = F.lower(F.concat_ws("\n", path, title, text)), F.lower(path), lambda c: F.when(c > 0, 1 + F.log(c)).otherwise(0.0)
    words = TOKEN.findall(q)
    score = 8 * damp(occurrences_of(q, h)) + F.when(canonical, 0.25).otherwise(0.0)
    for w in words:
        score = score + damp(occurrences_of(w, h)) + F.when(p.contains(w), 2.0).otherwise(0.0)
    hit = h.contains(q)
    for w in words:
        hit = hit | h.contains(w)
    return F.when(hit, score)


def lexical_matches(chunks: DataFrame, occurrences: DataFrame, query: str, classes=("public", "lab"), branch: str | None = None) -> DataFrame:
    """Chunks that match, with score, preferred occurrence and citation; access is filtered on the scan."""
    words = TOKEN.findall(query.lower())
    text = F.lower(F.concat_ws("\n", "path", "title", "text"))
    hit = text.contains(query.lower())
    for w in words:
        hit = hit | text.contains(w)
    rows = allowed(chunks, classes).filter(hit).join(preferred_occurrence(occurrences, branch), "doc_id")
    rows = rows.withColumn("score", tied(lexical_score(query, F.col("path"), F.col("title"), F.col("text"), F.col("canonical"))))
    return rows.withColumn("chunk_hash", F.sha2("text", 256)).withColumn("citation", citation(F.col("project"), F.col("branch"), F.col("commit_sha"), F.col("path"), F.col("line"), F.col("line")))


def diversify_ranked(rows: DataFrame, per_path: int, order: list[Column]) -> DataFrame:
    """The best row of each content, then the best `per_path` of each path."""
    one = rows.withColumn("_r", F.row_number().over(Window.partitionBy("chunk_hash").orderBy(*order))).filter("_r = 1")
    return one.withColumn("_r", F.row_number().over(Window.partitionBy("repository_id", "path").orderBy(*order))).filter(F.col("_r") <= per_path).drop("_r")


def lexical_search(chunks: DataFrame, occurrences: DataFrame, query: str, limit: int = 10, per_path: int = 2, duplicates: bool = False, **scope) -> DataFrame:
    order = [F.col("score").desc(), F.col("path"), F.col("line")]
    rows = lexical_matches(chunks, occurrences, query, **scope)
    return (rows if duplicates else diversify_ranked(rows, per_path, order)).orderBy(*order).limit(limit)


def full_text_search(chunks: DataFrame, occurrences: DataFrame, query: str, limit: int = 10, classes=("public", "lab")) -> DataFrame:
    """All words as whole words (title counts more), squashed to r / (r + 1), with boosts for the query as it is in path, title, text."""
    words = query.lower().split()
    rows = allowed(chunks, classes)
    count = lambda c, w: F.size(F.filter(F.split(F.lower(F.col(c)), "[^a-z0-9à-ÿ]+"), lambda x: x == w)).cast("double")
    r, every, q = F.lit(0.0), F.lit(True), query.lower()
    for w in words:
        every = every & (count("text", w) > 0)
        r = r + count("title", w) + 0.4 * count("text", w)
    boost = lambda c, x: F.when(F.lower(F.col(c)).contains(q), float(x)).otherwise(0.0)
    rows = rows.withColumn("_fts", every).filter(F.col("_fts") | F.lower("path").contains(q) | F.lower("text").contains(q)).join(preferred_occurrence(occurrences), "doc_id")
    score = 10 * F.when(F.col("_fts"), r / (r + 1)).otherwise(0.0) + boost("path", 8) + boost("title", 4) + boost("text", 2) + F.when(F.col("canonical"), 0.25).otherwise(0.0)
    return rows.withColumn("score", tied(score)).orderBy(F.desc("score"), "path", "line").limit(limit)


def neighborhood(chunks: DataFrame, targets: DataFrame, radius: int = 2, classes=("public", "lab"), occurrences: DataFrame | None = None, **scope) -> DataFrame:
    """For each target (doc_id, target_line): the 2 * radius + 1 chunks of its document, if it is allowed and in scope, that are nearest by line."""
    seen = allowed(chunks, classes)
    near = (seen if occurrences is None else scoped(seen, occurrences, **scope)).join(targets, "doc_id").withColumn("distance", F.abs(F.col("line") - F.col("target_line")))
    w = Window.partitionBy("doc_id", "target_line").orderBy("distance", "line")
    return near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2 * radius + 1).withColumn("score", (1000 - F.col("r")).cast("double"))


def in_scope(rows: DataFrame, scopes: list[tuple[str, str | None]], path_prefix: str | None = None) -> DataFrame:
    """Rows of one of the scopes (project, branch; None is any branch), and below a path (compared as it stands, no pattern)."""
    if not scopes:
        rows = rows.limit(0)
    else:
        hit = F.lit(False)
        for project, branch in scopes:
            hit = hit | ((F.col("project") == project) & (F.lit(True) if branch is None else F.col("branch").eqNullSafe(F.lit(branch))))
        rows = rows.filter(hit)
    return rows if path_prefix is None else rows.filter(F.col("path").startswith(path_prefix))


def scoped(rows: DataFrame, occurrences: DataFrame, scopes: list[tuple[str, str | None]] | None = None, branch: str | None = None, path_prefix: str | None = None) -> DataFrame:
    """rows (doc_id, project, path, ...) with the preferred occurrence of their document (of a branch, if one is named), where scopes and path admit it.

    A document without an occurrence there has no row.
    """
    rows = rows if path_prefix is None else rows.filter(F.col("path").startswith(path_prefix))
    rows = rows.join(preferred_occurrence(occurrences, branch), "doc_id")
    return rows if scopes is None else in_scope(rows, scopes)


def by_ids(chunks: DataFrame, ids: list[str], classes=("public", "lab"), occurrences: DataFrame | None = None, **scope) -> DataFrame:
    """Chunks by a list of at most 200 ids, in its order, where access and scope still admit them."""
    if len(ids) > 200:
        raise ValueError("at most 200 ids")
    at = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("chunk_id"))
    rows = allowed(chunks, classes).filter(F.col("chunk_id").isin(*ids))
    return (rows if occurrences is None else scoped(rows, occurrences, **scope)).withColumn("ordinal", at.cast("int")).withColumn("score", (1000 - F.col("ordinal")).cast("double"))


def cosine(vector: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(vector, q) / F.sqrt(dot(vector, vector)) / F.lit(sum(x * x for x in query) ** 0.5)


def nearest(vectors: DataFrame, documents: DataFrame, query: list[float], limit: int, classes=("public", "lab"), occurrences: DataFrame | None = None, **scope) -> DataFrame:
    """Exact nearest neighbours by cosine among the vectors of documents that are allowed and in scope: one scan and a top-k per task."""
    admitted = allowed(documents, classes)
    admitted = admitted if occurrences is None else scoped(admitted, occurrences, **scope)
    seen = vectors.join(admitted.select("doc_id"), "doc_id", "left_semi")
    return seen.withColumn("score", tied(cosine(F.col("embedding"), query))).orderBy(F.desc("score"), "doc_id").limit(limit)


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Each list has key and rank; a key's score is the sum of 1 / (k + rank) over the lists that have it."""
    out = None
    for one in lists:
        part = one.select(key, (1.0 / (k + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.sum("part").alias("rrf"), F.count("*").alias("n_lists"))


def diversify_greedy(ranked: DataFrame, limit: int, per_path: int) -> DataFrame:
    """One greedy pass over a short ranked list: a row that the path's quota skips does not mark its content as seen."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "path", "chunk_hash", "chunk_id")))
    step = lambda a, x: F.when(
        (F.size(a) >= limit) | (F.size(F.filter(a, lambda y: y["path"] == x["path"])) >= per_path) | F.exists(a, lambda y: y["chunk_hash"] == x["chunk_hash"]), a
    ).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate("rows", F.expr("cast(array() as array<struct<rank:int,path:string,chunk_hash:string,chunk_id:string>>)"), step)
    return ranked.withColumn("rank", F.col("rank").cast("int")).agg(rows.alias("rows")).select(F.posexplode(kept).alias("pos", "x")).select("pos", "x.*")


def directory_bundles(seeds: DataFrame) -> DataFrame:
    """Ancestor directories of at least two of the seeds' documents; of nested ones, the deepest."""
    parts = F.split("path", "/")
    roots = seeds.select("doc_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("root"))
    found = roots.groupBy("root").agg(F.countDistinct("doc_id").alias("n_docs")).filter("n_docs >= 2")
    deeper = found.select(F.col("root").alias("_deep")).withColumn("root", F.regexp_replace("_deep", "/[^/]*$", "")).filter("root <> _deep").select("root").distinct()
    return found.join(deeper, "root", "left_anti")
