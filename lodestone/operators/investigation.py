"""What an investigation leaves behind: edges it walked, results in scope, kept evidence in order, claims to verify."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.rollups import first_by

#: Kind of edge, whether it goes from the result to the origin, and whether it is directed, by tool.
TRAVERSALS = {
    "find_callers": ("calls", True, True),
    "find_callees": ("calls", False, True),
    "open_related": ("related", False, False),
    "open_neighborhood": ("neighbor", False, False),
}


def traversal_edges(steps: DataFrame) -> DataFrame:
    """Edges of steps (tool, origin, result: chunk ids): none for other tools, empty ends, or a result that is its origin."""
    per_tool = lambda k: F.coalesce(*[F.when(F.col("tool") == t, F.lit(v[k])) for t, v in TRAVERSALS.items()])
    rows = steps.filter(F.col("tool").isin(*TRAVERSALS) & (F.col("origin") != "") & (F.col("result") != "") & (F.col("origin") != F.col("result")))
    rows = rows.withColumns({"_from": F.when(per_tool(1), F.col("result")).otherwise(F.col("origin")), "_to": F.when(per_tool(1), F.col("origin")).otherwise(F.col("result"))})
    identity = F.sha2(F.concat_ws("\0", "tool", "_from", "_to"), 256)
    ends = [F.concat(F.lit("chunk:"), c).alias(name) for c, name in (("_from", "source"), ("_to", "target"))]
    return rows.select(F.concat(F.lit("edge:"), F.substring(identity, 1, 20)).alias("edge_id"), *ends, per_tool(0).alias("kind"), per_tool(2).alias("directed"), "tool")


def bounded_graph(results: DataFrame, sources: DataFrame, edges: DataFrame, most_nodes: int = 24, most_edges: int = 36) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each case to be shown: case_id, chunk_id, place; case_id, edge_id, source, target.

    results are (case_id, chunk_id), sources (case_id, pos, chunk_id), edges (case_id, pos, edge_id, source, target). Edges between known
    chunks, each id once, go in by pos up to most_edges; nodes are the sources, then the edges' ends, up to most_nodes; edges that lose an end go.
    """
    known = results.select("case_id", "chunk_id").union(sources.select("case_id", "chunk_id")).distinct()

    def within(e: DataFrame, nodes: DataFrame) -> DataFrame:
        for end in ("source", "target"):
            e = e.join(nodes.select("case_id", F.col("chunk_id").alias(end)), ["case_id", end], "left_semi")
        return e

    def top(rows: DataFrame, order: list[str], most: int) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy(*order))).filter(F.col("place") <= most)

    walked = top(first_by(within(edges, known), ["case_id", "edge_id"], [F.col("pos")]), ["pos", "edge_id"], most_edges)
    end = lambda name, k: walked.select("case_id", F.col(name).alias("chunk_id"), F.lit(1).alias("_late"), F.col("pos").alias("_at"), F.lit(k).alias("_end"))
    shown = sources.select("case_id", "chunk_id", F.lit(0).alias("_late"), F.col("pos").alias("_at"), F.lit(0).alias("_end"))
    order = ["_late", "_at", "_end"]
    nodes = top(first_by(shown.unionByName(end("source", 0)).unionByName(end("target", 1)), ["case_id", "chunk_id"], [F.col(c) for c in order]), [*order, "chunk_id"], most_nodes)
    return nodes.select("case_id", "chunk_id", "place"), within(walked, nodes).select("case_id", "edge_id", "source", "target")


def in_scope(results: DataFrame, scopes: DataFrame) -> DataFrame:
    """Results (project, branch, ...) that one of the scopes (project, branch) admits; a scope without a branch admits each of its project's."""
    s = scopes.select(F.col("project").alias("_p"), F.col("branch").alias("_b"))
    return results.join(s, (F.col("project") == F.col("_p")) & (F.col("_b").isNull() | (F.col("_b") == F.coalesce("branch", F.lit("")))), "left_semi")


def kept_priority(kept: DataFrame, aspects: DataFrame) -> DataFrame:
    """case_id, chunk_id, place (from 1) of kept chunks (case_id, pos, chunk_id): the first of each aspect, then their others, then the rest.

    aspects are (case_id, aspect, pos, chunk_id); what isn't kept doesn't count; a chunk has its first place only.
    """
    own = kept.groupBy("case_id", "chunk_id").agg(F.min("pos").alias("_kept"))
    named = aspects.groupBy("case_id", "aspect", "chunk_id").agg(F.min("pos").alias("pos")).join(own, ["case_id", "chunk_id"])
    nth = F.row_number().over(Window.partitionBy("case_id", "aspect").orderBy("pos", "chunk_id"))
    named = named.select("case_id", "chunk_id", F.when(nth == 1, 0).otherwise(1).alias("_late"), F.col("aspect").alias("_a"), F.col("pos").alias("_at"))
    rest = own.select("case_id", "chunk_id", F.lit(2).alias("_late"), F.lit(0).alias("_a"), F.col("_kept").alias("_at"))
    rows = first_by(named.unionByName(rest), ["case_id", "chunk_id"], [F.col("_late"), F.col("_a"), F.col("_at")])
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("_late", "_a", "_at", "chunk_id"))
    return rows.select("case_id", "chunk_id", place.alias("place"))


def claim_batches(claims: DataFrame, size: int = 5) -> DataFrame:
    """Claims (answer_id, p, claim, cited) that need a verdict, each text with the same citations once an answer, in batches of `size`: answer_id, p of the first, copies, batch."""
    once = claims.groupBy("answer_id", "claim", "cited").agg(F.min("p").alias("p"), F.count("*").alias("copies"))
    nth = F.row_number().over(Window.partitionBy("answer_id").orderBy("p"))
    return once.select("answer_id", "p", "copies", F.floor((nth - 1) / size).cast("int").alias("batch"))


def verdict_counts(verdicts: DataFrame, by: str) -> DataFrame:
    """Claims of each verdict, and whether all are supported; none at all is no pass."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(v)
    out = verdicts.groupBy(by).agg(F.count("verdict").alias("claims"), n("supported"), n("unsupported"), n("contradicted"), n("uncertain"))
    return out.withColumn("passed", (F.col("claims") > 0) & (F.col("supported") == F.col("claims")))


def branch_sync(occurrences: DataFrame) -> DataFrame:
    """One inventory a commit, joined back to its branches: repository_id, branch, commit_sha, documents, shared_commit.

    occurrences are (repository_id, branch, commit_sha, doc_id); branches of one commit have the same documents, and these are counted once.
    """
    heads = occurrences.select("repository_id", "branch", "commit_sha").distinct()
    inventory = occurrences.groupBy("repository_id", "commit_sha").agg(F.countDistinct("doc_id").alias("documents"))
    shared = heads.groupBy("repository_id", "commit_sha").agg((F.count("*") > 1).alias("shared_commit"))
    return heads.join(inventory.join(shared, ["repository_id", "commit_sha"]), ["repository_id", "commit_sha"])


def inventory_rollups(files: DataFrame) -> DataFrame:
    """Files (format, reason, top, size_bytes) counted by each of format, reason and top in one pass: dimension, value, files, bytes."""
    which = F.stack(F.lit(3), F.lit("format"), "format", F.lit("reason"), "reason", F.lit("top"), "top").alias("dimension", "value")
    return files.select("size_bytes", which).groupBy("dimension", "value").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def load_rows(documents: DataFrame, required=("doc_id", "path")) -> DataFrame:
    """Documents as they are loaded: defaults for format, title and kind; valid is false if a required field is null or empty."""
    default = lambda c, value: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(value))
    filled = documents.withColumns({"format": default("format", "unknown"), "title": default("title", "arquivo"), "kind": default("kind", "text")})
    valid = F.lit(True)
    for c in required:
        valid = valid & (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return filled.withColumn("valid", valid)
