"""The frontier of an investigation: which results to go on from, and what to open next, for all cases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.rollups import first_by
from lodestone.sources.store import cut

#: Letters with marks and what they are without.
_MARKED, _PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
#: Words of questions that say nothing of what is looked for.
IDLE = ("and", "are", "for", "from", "how", "that", "the", "this", "what", "where", "which", "with")
#: Kinds of evidence that came by a call and may be followed further, rounds and sizes.
FOLLOWED = ("agent_callers_evidence", "agent_callees_evidence", "agent_terminal_neighborhood_evidence", "agent_terminal_callees_evidence")
ROUNDS, ACTIONS, KEPT, POOL, RADIUS, CALLEES = 3, 8, 8, 96, 5, 12


def search_terms(text: Column) -> Column:
    """The distinct words of a text, those within identifiers too, of three letters or digits or more, without marks and case."""
    plain = F.translate(F.coalesce(text, F.lit("")), _MARKED, _PLAIN)
    words = F.regexp_extract_all(F.lower(F.regexp_replace(plain, "([a-z0-9])([A-Z])", "$1 $2")), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*IDLE)))


def evenly(nth: Column, n: Column, most: Column) -> Column:
    """Whether place nth (from 0) of n is one of `most` places that are evenly spaced, first and last among them."""
    k = F.least(n, most)
    gap = F.when(k > 1, (n - 1) / (k - 1)).otherwise(F.lit(0.0))
    near = F.when(gap > 0, F.floor(nth / gap)).otherwise(F.lit(0))
    hit = lambda i: (i >= 0) & (i < k) & (F.bround(i * gap, 0) == nth)
    return hit(near - 1) | hit(near) | hit(near + 1)


def family(path: Column) -> Column:
    """A path without its last suffix."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def select_frontier(results: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """results with place (from 1) of those to go on from, at most `limit` a case.

    results are (case_id, pos, chunk_id, path, title, text, source_kind), terms (case_id, terms: array). A result scores four for each of the
    terms in its path and title and one for each in its text. In a case without any score, evenly spaced results come first. Then: the
    first result; one caller and one callee, of families not taken yet if there are such; the first of each other family, of those that
    score if any do, until two places are left; the others, those that score first. A chunk counts once.
    """
    case = Window.partitionBy("case_id")
    hits = lambda c: F.size(F.array_intersect(F.coalesce("terms", F.array().cast("array<string>")), search_terms(c)))
    rows = results.join(terms, "case_id", "left").withColumn("_score", 4 * hits(F.concat_ws(" ", "path", "title")) + hits(F.col("text"))).drop("terms")
    rows = rows.withColumns({"_any": F.max("_score").over(case) > 0, "_nth": F.row_number().over(case.orderBy("pos", "chunk_id")) - 1, "_n": F.count("*").over(case)})
    tier = F.when(F.col("_any") | evenly(F.col("_nth"), F.col("_n"), F.lit(limit)), 0).otherwise(1)
    rows = rows.withColumns({"_tier": tier, "_family": F.when(F.coalesce("path", F.lit("")) != "", family(F.col("path"))).otherwise(F.concat(F.lit("\0"), "chunk_id"))})
    order = [F.col("_tier"), F.desc("_score"), F.col("_nth")]
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("case_id", "chunk_id").orderBy(*order))).filter("_copy = 1")
    rows = rows.withColumn("_o", F.row_number().over(case.orderBy(*order)))
    least = lambda on: F.min(F.when(on, F.col("_o"))).over(case)
    at = lambda o: F.max(F.when(F.col("_o") == F.col(o), F.col("_family"))).over(case)
    unlike = lambda *names: [F.coalesce(F.col("_family") != F.col(n), F.lit(True)) for n in names]
    rows = rows.withColumn("_f0", F.max(F.when(F.col("_o") == 1, F.col("_family"))).over(case))
    for k, role in ((1, "callers"), (2, "callees")):
        own, new = F.contains(F.coalesce("source_kind", F.lit("")), F.lit(role)), F.lit(True)
        for on in unlike(*[f"_f{i}" for i in range(k)]):
            new = new & on
        rows = rows.withColumn(f"_o{k}", F.coalesce(least(own & new), least(own))).withColumn(f"_f{k}", at(f"_o{k}"))
    reserved = F.coalesce(F.when(F.col("_o") == 1, 0), F.when(F.col("_o") == F.col("_o1"), 1), F.when(F.col("_o") == F.col("_o2"), 2))
    rows = rows.withColumn("_phase", reserved).withColumn("_taken", F.count("_phase").over(case))
    pool = (F.col("_score") > 0) | ~F.col("_any")
    for on in unlike("_f0", "_f1", "_f2"):
        pool = pool & on
    rows = rows.withColumn("_new", pool)
    lead = rows.withColumn("_lead", F.col("_new") & (F.row_number().over(Window.partitionBy("case_id", "_new", "_family").orderBy("_o")) == 1))
    nth = F.row_number().over(Window.partitionBy("case_id", "_lead").orderBy("_o"))
    wide = F.col("_lead") & (nth <= F.greatest(F.lit(min(limit, max(3, limit - 2))) - F.col("_taken"), F.lit(1)))
    phased = lead.withColumn("_phase", F.coalesce("_phase", F.when(wide, 3), F.when(F.col("_score") > 0, 4), F.lit(5)))
    placed = phased.withColumn("place", F.row_number().over(case.orderBy("_phase", "_o"))).filter(F.col("place") <= limit)
    return placed.select(*results.columns, "place")


def next_actions(frontier: DataFrame, done: DataFrame, limit: int = ACTIONS) -> DataFrame:
    """(case_id, nth, tool, chunk_id): what to open next, at most `limit` a case, from frontier (case_id, place, chunk_id, source_kind).

    Neighbourhoods of chunks have half of the places or what they need, callees of chunks that came by a call the rest, each
    sampled evenly in the order of the frontier. Actions of `done` (case_id, tool, chunk_id) aren't repeated.
    """
    once = first_by(frontier.filter(F.coalesce("chunk_id", F.lit("")) != ""), ["case_id", "chunk_id"], [F.col("place")]).select("case_id", "chunk_id", "place")
    called = first_by(frontier.filter(F.col("source_kind").isin(*FOLLOWED)), ["case_id", "chunk_id"], [F.col("place")]).select("case_id", "chunk_id", "place")

    def sampled(rows: DataFrame, tool: str, most: Column) -> DataFrame:
        case = Window.partitionBy("case_id")
        left = rows.withColumn("tool", F.lit(tool)).join(done.select("case_id", "tool", "chunk_id"), ["case_id", "tool", "chunk_id"], "left_anti")
        left = left.withColumns({"_nth": F.row_number().over(case.orderBy("place")) - 1, "_n": F.count("*").over(case)})
        return left.filter((most > 0) & evenly(F.col("_nth"), F.col("_n"), most))

    near = sampled(once, "open_neighborhood", F.lit(max(1, (limit + 1) // 2))).select("case_id", F.lit(0).alias("_kind"), "place", "tool", "chunk_id")
    room = near.groupBy("case_id").agg(F.count("*").alias("_near"))
    calls = called.join(room, "case_id", "left")
    calls = sampled(calls, "find_callees", F.lit(limit) - F.coalesce("_near", F.lit(0))).select("case_id", F.lit(1).alias("_kind"), "place", "tool", "chunk_id")
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("_kind", "place"))
    return near.union(calls).withColumn("nth", nth).filter(F.col("nth") <= limit).select("case_id", "nth", "tool", "chunk_id")


def expand(results: DataFrame, terms: DataFrame, chunks: DataFrame, calls: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(case_id, round, nth, tool, origin, result_pos, chunk_id): what a bounded expansion from each case's results opens.

    chunks are (chunk_id, doc_id, line, path, title, text), only those that may be seen; calls (chunk_id, target: chunk ids). A round takes
    the frontier of what is known, acts, and adds what is new, up to POOL a case. A case ends after a round that finds nothing. An
    action without results has a row of a null chunk_id. What is known and done is written after each round.
    """
    known = cut(first_by(results, ["case_id", "chunk_id"], [F.col("pos")]).select("case_id", "pos", "chunk_id", "source_kind"))
    spark = results.sparkSession
    done = spark.createDataFrame([], "case_id string, tool string, chunk_id string").withColumn("case_id", F.col("case_id").cast(results.schema["case_id"].dataType))
    alive, opened = known.select("case_id").distinct(), None
    about = chunks.select("chunk_id", "path", "title", "text")
    places = chunks.select("chunk_id", "doc_id", "line")
    for turn in range(1, rounds + 1):
        pool = known.join(alive, "case_id", "left_semi").join(about, "chunk_id")
        actions = cut(next_actions(select_frontier(pool, terms, KEPT), done))
        if actions.isEmpty():
            break
        own = actions.filter("tool = 'open_neighborhood'").join(places, "chunk_id").select("case_id", "nth", "doc_id", F.col("line").alias("_at"))
        near = own.join(places.select("doc_id", "line", F.col("chunk_id").alias("found")), "doc_id")
        near = near.withColumn("_r", F.row_number().over(Window.partitionBy("case_id", "nth").orderBy(F.abs(F.col("line") - F.col("_at")), "line"))).filter(F.col("_r") <= 2 * RADIUS + 1)
        near = near.withColumn("result_pos", F.row_number().over(Window.partitionBy("case_id", "nth").orderBy("line")))
        via = actions.filter("tool = 'find_callees'").join(calls, "chunk_id").select("case_id", "nth", F.col("target").alias("chunk_id")).distinct().join(chunks.select("chunk_id", "path", "line"), "chunk_id")
        via = via.withColumn("result_pos", F.row_number().over(Window.partitionBy("case_id", "nth").orderBy("path", "line", "chunk_id"))).filter(F.col("result_pos") <= CALLEES)
        found = near.select("case_id", "nth", "result_pos", "found").union(via.select("case_id", "nth", "result_pos", F.col("chunk_id").alias("found")))
        rows = cut(actions.withColumnRenamed("chunk_id", "origin").join(found, ["case_id", "nth"], "left").select("case_id", F.lit(turn).alias("round"), "nth", "tool", "origin", "result_pos", F.col("found").alias("chunk_id")))
        opened = rows if opened is None else opened.union(rows)
        done = done.union(actions.select("case_id", "tool", "chunk_id"))
        alive = rows.filter("chunk_id is not null").select("case_id").distinct()
        kind = F.when(F.col("tool") == "find_callees", "agent_terminal_callees_evidence").otherwise("agent_terminal_neighborhood_evidence")
        new = first_by(rows.filter("chunk_id is not null"), ["case_id", "chunk_id"], [F.col("nth"), F.col("result_pos")]).join(known, ["case_id", "chunk_id"], "left_anti")
        size = known.groupBy("case_id").agg(F.count("*").alias("_n"), F.max("pos").alias("_last"))
        new = new.withColumn("_k", F.row_number().over(Window.partitionBy("case_id").orderBy("nth", "result_pos"))).join(size, "case_id").filter(F.col("_n") + F.col("_k") <= POOL)
        known = cut(known.union(new.select("case_id", (F.col("_last") + F.col("_k")).alias("pos"), "chunk_id", kind.alias("source_kind"))))
    empty = "round int, nth int, tool string, origin string, result_pos int, chunk_id string"
    return opened if opened is not None else results.select("case_id").limit(0).join(spark.createDataFrame([], empty))
