"""Context expansion of a ranked list: hints from its seeds, complements found by them, and their place in the list.

Seeds and candidates are short ranked lists (at most Policy.candidates rows), so that the greedy choices are folds over one
array; finding the candidates is a join of the allowed chunks with the hints, which are broadcast (a few for each seed).
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.access import allowed

#: Files that go together, by suffix.
PAIRS = {".c": (".h",), ".cc": (".hh", ".hpp"), ".cpp": (".hpp", ".h"), ".cxx": (".hxx", ".hpp"), ".h": (".c", ".cpp"), ".hh": (".cc", ".cpp"), ".hpp": (".cpp", ".cc", ".cxx"), ".hxx": (".cxx", ".cpp")}
FAR = 1_000_000_000


def _within(value: int, low: int, high: int):
    return field(default=value, metadata={"low": low, "high": high})


@dataclass(frozen=True)
class Policy:
    """Limits and strengths of context expansion, each with the values it may have (all fixed values); any other is an error."""

    results: int = _within(2, 0, 10)
    same_document_hits: int = _within(2, 2, 20)
    same_document: int = _within(6, 0, 100)
    paired_source: int = _within(5, 0, 100)
    directory_documents: int = _within(2, 2, 20)
    directory: int = _within(7, 0, 100)
    symbols: int = _within(24, 0, 100)
    symbol: int = _within(4, 0, 100)
    candidates: int = _within(50, 1, 500)
    headers: tuple[str, ...] = (".h", ".hh", ".hpp", ".hxx")
    configurations: tuple[str, ...] = (".cfg", ".ini", ".json", ".toml", ".xml", ".yaml", ".yml")

    def __post_init__(self) -> None:
        wrong = [f.name for f in fields(self) if f.metadata and not f.metadata["low"] <= getattr(self, f.name) <= f.metadata["high"]]
        if wrong:
            raise ValueError(f"out of range: {', '.join(wrong)}")


def slots(limit: int, per_path: int, policy: Policy = Policy()) -> dict[str, int]:
    """How many candidates each list gives, how many of a path, and how many seeds keep their places beside complements."""
    context = min(policy.results, max(0, limit - 1))
    return {"candidates": min(100, max(10 * limit, 50)), "per_path": min(100, max(per_path, 10)), "context": context, "seeds": max(0, limit - context)}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def path_hints(seeds: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """path, reason, rank, strength: headers that several seeds are from, and the other file of a pair, the strongest hint of each path."""
    s = seeds.withColumn("_x", suffix(F.col("path")))
    same = s.filter(F.col("_x").isin(*policy.headers)).groupBy("path").agg(F.min("rank").alias("rank"), F.count("*").alias("_n")).filter(F.col("_n") >= policy.same_document_hits)
    other = F.coalesce(*[F.when(F.col("_x") == x, F.array(*map(F.lit, to))) for x, to in PAIRS.items()])
    pair = s.filter(F.col("_x").isin(*PAIRS)).select("rank", F.col("path").alias("_of"), F.explode(other).alias("_to"), "_x")
    pair = pair.select("rank", F.concat(F.expr("substring(_of, 1, length(_of) - length(_x))"), "_to").alias("path")).join(seeds.select("path").distinct(), "path", "left_anti").groupBy("path").agg(F.min("rank").alias("rank"))
    both = same.select("path", F.lit("same_document").alias("reason"), "rank", F.lit(policy.same_document).alias("strength")).unionByName(pair.select("path", F.lit("paired_source").alias("reason"), "rank", F.lit(policy.paired_source).alias("strength")))
    best = Window.partitionBy("path").orderBy(F.desc("strength"), "rank")
    return both.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def directory_hints(seeds: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """root, rank, strength: the deepest directories below which seeds are from several configuration files, one of them right in it."""
    parts = F.split("path", "/")
    s = seeds.filter(suffix(F.col("path")).isin(*policy.configurations)).filter(F.size(parts) > 1)
    roots = s.select("path", "rank", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("root"))
    own = F.max((F.regexp_replace("path", "/[^/]*$", "") == F.col("root")).cast("int"))
    found = roots.groupBy("root").agg(F.countDistinct("path").alias("_n"), F.min("rank").alias("rank"), own.alias("_own")).filter((F.col("_n") >= policy.directory_documents) & (F.col("_own") == 1))
    outer = F.split("root", "/")
    above = found.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(outer) - 1, F.lit(1))), lambda k: F.when(k < F.size(outer), F.array_join(F.slice(outer, 1, k), "/")))).alias("root")).filter("root is not null").distinct()
    return found.join(above, "root", "left_anti").select("root", "rank", F.lit(policy.directory).alias("strength"))


def symbol_hints(seeds: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """symbol, rank: identifiers of ten letters or more, some small and two capital, in titles and texts; by rank, then the longest."""
    words = F.regexp_extract_all(F.concat_ws("\n", "title", "text"), F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\b"), F.lit(1))
    s = seeds.select("rank", F.explode(F.array_distinct(words)).alias("symbol"))
    s = s.filter((F.length("symbol") >= 10) & F.col("symbol").rlike("[a-z]") & F.col("symbol").rlike("[A-Z].*[A-Z]"))
    return s.groupBy("symbol").agg(F.min("rank").alias("rank")).orderBy("rank", F.desc(F.length("symbol")), "symbol").limit(policy.symbols)


def complements(chunks: DataFrame, seeds: DataFrame, policy: Policy = Policy(), classes=("public", "lab")) -> DataFrame:
    """Allowed chunks (chunk_id, path, title, text, chunk_hash, line_start, line_end, score) that a hint finds, with why, the seed's rank, the group and the order.

    A path's hint goes before a directory's, the deepest directory's before a symbol's. Chunks of seeds are left out.
    """
    seeds = seeds.orderBy("rank", "chunk_id").limit(policy.candidates)  # so that what is broadcast below has a bound
    rows = allowed(chunks, classes).join(F.broadcast(seeds.select("chunk_id")), "chunk_id", "left_anti")
    p = path_hints(seeds, policy).select("path", F.struct(F.lit(0).alias("step"), F.lit(0).alias("deep"), "rank", F.col("path").alias("name"), "reason", "strength").alias("h"))
    d = directory_hints(seeds, policy).select(F.col("root"), F.struct(F.lit(1).alias("step"), (-F.size(F.split("root", "/"))).alias("deep"), "rank", F.col("root").alias("name"), F.lit("directory_bundle").alias("reason"), "strength").alias("h"))
    s = symbol_hints(seeds, policy).select("symbol", F.struct(F.lit(2).alias("step"), F.lit(0).alias("deep"), "rank", F.lower("symbol").alias("name"), F.lit("symbol_reference").alias("reason"), F.lit(policy.symbol).alias("strength")).alias("h"))
    text = F.lower(F.concat_ws("\n", "title", "text"))
    found = rows.join(F.broadcast(p), "path").unionByName(rows.join(F.broadcast(d), F.col("path").startswith(F.concat("root", F.lit("/")))).drop("root")).unionByName(rows.join(F.broadcast(s), text.contains(F.lower("symbol"))).drop("symbol"))
    one = found.groupBy("chunk_id").agg(F.min_by(F.struct(*rows.columns, "h"), "h").alias("x")).select("x.*")
    near = F.broadcast(seeds.groupBy(F.col("path").alias("path")).agg(F.collect_list(F.struct("line_start", "line_end")).alias("_at")))
    gap = lambda x: F.greatest(F.lit(0), x["line_start"] - F.col("line_end"), F.col("line_start") - x["line_end"])
    distance = F.when(F.col("h.reason") == "same_document", F.coalesce(F.array_min(F.transform("_at", gap)), F.lit(FAR))).otherwise(F.lit(FAR))
    one = one.join(near, "path", "left").withColumn("distance", distance).drop("_at")
    return one.select("chunk_id", "path", "chunk_hash", "score", "distance", F.col("h.reason").alias("reason"), F.col("h.rank").alias("source_rank"), F.col("h.strength").alias("strength"), F.concat("h.reason", F.lit(":"), "h.name").alias("group"))


def select_complements(found: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The strongest complements, one of each group, path and content, with context_rank; a pass over the first Policy.candidates."""
    order = [F.desc("strength"), F.col("source_rank"), F.col("distance"), F.desc("score"), F.col("chunk_id")]
    top = found.orderBy(*order).limit(policy.candidates).withColumn("_at", F.row_number().over(Window.orderBy(*order)))  # so many rows
    rows = F.array_sort(F.collect_list(F.struct("_at", "group", "path", "chunk_hash", "chunk_id", "source_rank", "reason")))
    taken = lambda a, x: F.exists(a, lambda y: (y["group"] == x["group"]) | (y["path"] == x["path"]) | (y["chunk_hash"] == x["chunk_hash"]))
    empty = F.expr("cast(array() as array<struct<_at:int,group:string,path:string,chunk_hash:string,chunk_id:string,source_rank:int,reason:string>>)")
    kept = F.aggregate("rows", empty, lambda a, x: F.when((F.size(a) >= policy.results) | taken(a, x), a).otherwise(F.concat(a, F.array(x))))
    typed = top.withColumns({"_at": F.col("_at").cast("int"), "source_rank": F.col("source_rank").cast("int")})
    return typed.agg(rows.alias("rows")).select(F.posexplode(kept).alias("_p", "x")).select((F.col("_p") + 1).alias("context_rank"), "x.chunk_id", "x.path", "x.chunk_hash", "x.source_rank", "x.reason")


def interleave(baseline: DataFrame, context: DataFrame, limit: int, per_path: int) -> DataFrame:
    """baseline (rank, chunk_id, path, chunk_hash, score) with each complement right after its seed, a millionth of score below the one before; quotas hold."""
    b = baseline.select(F.col("rank").cast("int").alias("at"), F.lit(0).alias("step"), "chunk_id", "path", "chunk_hash", F.col("score").cast("double").alias("score"))
    place = F.row_number().over(Window.partitionBy("source_rank").orderBy("context_rank"))
    c = context.withColumn("step", place).join(b.select(F.col("at").alias("source_rank"), F.col("score")), "source_rank")
    c = c.select(F.col("source_rank").cast("int").alias("at"), F.col("step").cast("int"), "chunk_id", "path", "chunk_hash", F.greatest(F.lit(0.0), F.col("score") - F.col("step") * 0.000001).alias("score"))
    rows = F.array_sort(F.collect_list(F.struct("at", "step", "chunk_id", "path", "chunk_hash", "score")))
    full = lambda a, x: (F.size(a) >= limit) | (F.size(F.filter(a, lambda y: y["path"] == x["path"])) >= per_path) | F.exists(a, lambda y: (y["chunk_id"] == x["chunk_id"]) | (y["chunk_hash"] == x["chunk_hash"]))
    kept = F.aggregate("rows", F.expr("cast(array() as array<struct<at:int,step:int,chunk_id:string,path:string,chunk_hash:string,score:double>>)"), lambda a, x: F.when(full(a, x), a).otherwise(F.concat(a, F.array(x))))
    return b.unionByName(c).agg(rows.alias("rows")).select(F.posexplode(kept).alias("pos", "x")).select("pos", "x.chunk_id", "x.path", "x.score")
