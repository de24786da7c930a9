"""Symbols, references and calls: building the graph, and asking it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.ids import stable_id, tied
from lodestone.functions.text import leaf_name, parent, stem
from lodestone.operators.access import allowed, most_restrictive
from lodestone.operators.rollups import first_by


def symbol_islands(chunks: DataFrame) -> DataFrame:
    """Symbols from chunks (doc_id, kind, title, line_start, line_end): a window that begins within its predecessors is part of them; the first one's end stays."""
    w = Window.partitionBy("doc_id", "kind", "title").orderBy("line_start", "line_end").rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.withColumn("_until", F.max("line_end").over(w)).filter("_until is null or line_start > _until").drop("_until")
    return rows.withColumns({"name": leaf_name(F.col("title")), "symbol_id": stable_id("doc_id", "kind", "title", "line_start")})


def resolve_paths(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """The document whose path ends in the target, if it is the only one; targets with $ never resolve."""
    parts = F.split("path", "/")
    suffixes = docs.select(F.col("doc_id").alias("target_doc"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.lit(1000)), "/"))).alias("_suffix"))
    single = suffixes.groupBy("_suffix").agg(F.min("target_doc").alias("target_doc"), F.countDistinct("target_doc").alias("_n")).filter("_n = 1").drop("_n")
    wanted = F.regexp_replace("target", r"^[./]+", "")
    return refs.join(single, (wanted == F.col("_suffix")) & ~F.col("target").contains("$"), "left").drop("_suffix")


def companions(docs: DataFrame, occurrences: DataFrame, sources=("cpp",), headers=("hpp",)) -> DataFrame:
    """Source and header of one directory and stem that share a branch, with the more restrictive class."""
    key = lambda side: [F.col("repository_id").alias("_r"), parent(F.col("path")).alias("_p"), F.lower(stem(F.col("path"))).alias("_s"), F.col("doc_id").alias(side), F.col("access_class").alias(f"_{side}")]
    a, b = docs.filter(F.col("format").isin(*sources)).select(*key("source_doc")), docs.filter(F.col("format").isin(*headers)).select(*key("header_doc"))
    pairs = a.join(b, ["_r", "_p", "_s"])
    o = lambda side: occurrences.select(F.col("doc_id").alias(side), "branch", "commit_sha")
    shared = pairs.join(o("source_doc"), "source_doc").join(o("header_doc"), ["header_doc", "branch", "commit_sha"])
    return shared.groupBy("source_doc", "header_doc").agg(F.first(most_restrictive(F.col("_source_doc"), F.col("_header_doc"))).alias("access_class"), F.array_join(F.array_sort(F.collect_set("branch")), ",").alias("branches"))


def resolve_calls(calls: DataFrame, symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """For calls (doc_id, repository_id, leaf, line): candidates by name in the repository; then, for each of the source's branches, the one target that is there.

    resolution is unique_name (one candidate in the repository), branch_unique (one in the branch), or unresolved
    (several in the branch); a branch without candidates gives nothing.
    """
    c = symbols.select("repository_id", F.lower("name").alias("_leaf"), F.col("doc_id").alias("target_doc"))
    n = c.groupBy("repository_id", "_leaf").agg(F.countDistinct("target_doc").alias("_n"))
    o = occurrences.select("doc_id", "branch", "commit_sha")
    there = c.join(o.withColumnRenamed("doc_id", "target_doc"), "target_doc").groupBy("repository_id", "_leaf", "branch", "commit_sha").agg(F.countDistinct("target_doc").alias("_here"), F.min("target_doc").alias("target_doc"))
    called = calls.withColumn("_leaf", F.lower("leaf")).join(n, ["repository_id", "_leaf"]).join(o, "doc_id")
    out = called.join(there, ["repository_id", "_leaf", "branch", "commit_sha"])
    res = F.when(F.col("_here") > 1, "unresolved").when(F.col("_n") == 1, "unique_name").otherwise("branch_unique")
    out = out.select("doc_id", "line", "leaf", "branch", res.alias("resolution"), F.when(F.col("_here") == 1, F.col("target_doc")).alias("target_doc"))
    return out.groupBy("doc_id", "line", "leaf", "resolution", "target_doc").agg(F.array_join(F.array_sort(F.collect_set("branch")), ",").alias("branches"))


def visible(relations: DataFrame, documents: DataFrame, classes=("public", "lab")) -> DataFrame:
    """Relations whose evidence is in an allowed document, and whose target, if it is known, is one."""
    seen = allowed(documents, classes).select("doc_id")
    rows = relations.join(seen, "doc_id", "left_semi")
    return rows.join(seen.select(F.col("doc_id").alias("target_doc"), F.lit(True).alias("_seen")), "target_doc", "left").filter("target_doc is null or _seen").drop("_seen")


def symbol_search(symbols: DataFrame, query: str, limit: int = 10, classes=("public", "lab")) -> DataFrame:
    q, name, qualified = query.lower(), F.lower("name"), F.lower("qualified_name")
    score = F.when(qualified == q, 20.0).when(name == q, 16.0).when(qualified.contains(q), 8.0).otherwise(0.0) + F.when(F.lower("path").contains(q), 4.0).otherwise(0.0) + F.when(F.col("canonical"), 0.25).otherwise(0.0)
    return allowed(symbols, classes).withColumn("score", tied(score)).filter(qualified.contains(q)).orderBy(F.desc("score"), "path", "line", "doc_id").limit(limit)


def relation_search(relations: DataFrame, documents: DataFrame, query: str, classes=("public", "lab"), limit: int = 10) -> DataFrame:
    """Relations of allowed documents by target name; a target outside the allowed classes loses its identity and path."""
    relations = relations.join(allowed(documents, classes).select("doc_id"), "doc_id", "left_semi")
    t = documents.select(F.col("doc_id").alias("target_doc"), F.col("path").alias("_path"), F.col("access_class").isin(*classes).alias("_seen"))
    rows = relations.filter(F.lower("leaf").contains(query.lower())).join(t, "target_doc", "left")
    seen = F.coalesce(F.col("_seen"), F.lit(False))
    rows = rows.withColumn("score", F.when(F.lower("leaf") == query.lower(), 20.0).otherwise(8.0))
    return rows.select("doc_id", "line", "leaf", "resolution", F.when(seen, F.col("target_doc")).alias("target_doc"), F.when(seen, F.col("_path")).alias("target_path"), "score").orderBy(F.desc("score"), "doc_id", "line", "leaf", F.col("target_doc").asc_nulls_last(), "resolution").limit(limit)


def callers(relations: DataFrame, doc_id: int) -> DataFrame:
    return relations.filter(F.col("target_doc") == doc_id).groupBy("doc_id").agg(F.min("line").alias("line"), F.count("*").alias("calls"))


def callees(relations: DataFrame, doc_id: int) -> DataFrame:
    return relations.filter((F.col("doc_id") == doc_id) & F.col("target_doc").isNotNull()).groupBy("target_doc").agg(F.min("line").alias("line"), F.count("*").alias("calls"))


def related(relations: DataFrame, origin: int) -> DataFrame:
    """Documents at the other end of the origin's edges, as two equi-filters and a union; incoming edges first."""
    came = relations.filter(F.col("target_doc") == origin).select(F.col("doc_id").alias("other"), F.lit(0).alias("priority"), "line")
    went = relations.filter((F.col("doc_id") == origin) & F.col("target_doc").isNotNull()).select(F.col("target_doc").alias("other"), F.lit(1).alias("priority"), "line")
    return first_by(came.unionByName(went).filter(F.col("other") != origin), ["other"], [F.col("priority"), F.col("line")])


def relation_summary(relations: DataFrame) -> DataFrame:
    return relations.groupBy("resolution").agg(F.count("*").alias("relations"), F.countDistinct("doc_id").alias("sources"), F.count("target_doc").alias("resolved"))


def search_map(symbols: DataFrame, relations: DataFrame, limit: int = 10, result_type: str = "any") -> DataFrame:
    """One ranked list (score, result_type, item_id, path, line) of found symbols and relations, or of one of these types."""
    if result_type not in ("any", "symbol", "relation"):
        raise ValueError(f"no such type: {result_type}")
    both = symbols.select("score", F.lit("symbol").alias("result_type"), "item_id", "path", "line").unionByName(relations.select("score", F.lit("relation").alias("result_type"), "item_id", "path", "line"))
    both = both if result_type == "any" else both.filter(F.col("result_type") == result_type)
    return both.orderBy(F.desc("score"), "path", "line", "item_id").limit(limit)


def map_status(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Symbols, relations and resolved relations of each repository."""
    s = symbols.groupBy("repository_id").agg(F.count("*").alias("symbols"))
    r = relations.groupBy("repository_id").agg(F.count("*").alias("relations"), F.count("target_doc").alias("resolved"))
    return s.join(r, "repository_id", "full").na.fill(0, ["symbols", "relations", "resolved"])
