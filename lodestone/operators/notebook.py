"""The evidence notebook: which sources speak to each facet of a question, and sections of facets that share their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of facets that tell no subject, words that ask how parts connect, kinds of sources that show it, sizes.
GENERIC = (
    "advanc", "advancement", "code", "config", "configu", "configuration", "configure", "entry", "excerp", "excerpt", "explain", "explanation",
    "flow", "functi", "initia", "initialization", "initialize", "integration", "integr", "mechan", "mechanism", "method", "snippet", "source", "stage",
)
CONNECTING, CONNECTED = ("flow", "integr", "integration", "mechan", "mechanism"), "callers|callees|neighborhood|related"
SECTIONS, SOURCES = 4, 4


def match_terms(text: Column) -> Column:
    """Words of three letters or digits or more, and the first six of longer ones."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    return F.array_union(words, F.transform(F.filter(words, lambda w: F.length(w) >= 6), lambda w: F.left(w, F.lit(6))))


def rank_sources(facets: DataFrame, sources: DataFrame, questions: DataFrame) -> DataFrame:
    """(case_id, nth, source_id, score, rank) for each facet and source of a case: by metadata alone.

    facets are (case_id, nth, aspect), sources (case_id, pos, source_id, path, title, source_kind, format), questions (case_id, question).
    Terms that three fifths of a case's sources have, two at least, don't count for a facet, but do for the question's subject.
    A facet's term found scores 8, one that is not generic 4 more, each of the question's subjects 2; without a facet's term subjects
    score 1 each; generic terms alone nothing. Sources that came along connections have 10 more where the facet asks for one. Ties
    by pos, then by source_id.
    """
    terms = match_terms(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("path", "title", "source_kind", "format")]))
    s = sources.select("case_id", "pos", "source_id", "source_kind", terms.alias("own"))
    n = s.groupBy("case_id").agg(F.count("*").alias("n"))
    often = s.select("case_id", F.explode("own").alias("term")).groupBy("case_id", "term").count().join(n, "case_id")
    often = often.filter(F.col("count") >= F.greatest(F.lit(2), F.floor((F.col("n") * 3 + 4) / 5))).groupBy("case_id").agg(F.collect_list("term").alias("common"))
    generic, none = F.array(*map(F.lit, GENERIC)), F.array().cast("array<string>")
    f = facets.select("case_id", "nth", match_terms(F.col("aspect")).alias("asked")).join(questions.select("case_id", F.array_except(match_terms(F.col("question")), generic).alias("subject")), "case_id", "left")
    rows = f.join(s, "case_id").join(often, "case_id", "left").withColumns({"common": F.coalesce("common", none), "subject": F.coalesce("subject", none)})
    rows = rows.withColumns({"distinct_own": F.array_except("own", "common"), "facet": F.array_except("asked", "common")})
    hits = lambda a, b: F.size(F.array_intersect(a, b))
    facet, special, subject = hits("facet", "distinct_own"), hits(F.array_except("facet", generic), F.col("distinct_own")), hits("subject", "own")
    score = F.when((facet == 0) | ((subject == 0) & (special == 0)), F.when(facet == 0, subject).otherwise(0)).otherwise(8 * facet + 4 * special + 2 * subject)
    linked = F.arrays_overlap("asked", F.array(*map(F.lit, CONNECTING))) & F.coalesce(F.col("source_kind").rlike(CONNECTED), F.lit(False))
    rows = rows.withColumn("score", score + F.when((score > 0) & linked, 10).otherwise(0))
    order = Window.partitionBy("case_id", "nth").orderBy(F.desc("score"), "pos", "source_id")
    return rows.select("case_id", "nth", "source_id", "score", F.row_number().over(order).alias("rank"))


def facet_sources(facets: DataFrame, sources: DataFrame, questions: DataFrame) -> DataFrame:
    """facets (case_id, nth, aspect, status, chunk_ids) with anchors (sources of their chunks, in their order) and source_ids: these and the best ranked others, two in all, three where a connection is asked for."""
    by_chunk = sources.groupBy("case_id", "chunk_id").agg(F.min_by("source_id", F.struct("pos", "source_id")).alias("source_id"))
    each = facets.select("case_id", "nth", F.posexplode("chunk_ids").alias("at", "chunk_id")).join(by_chunk, ["case_id", "chunk_id"])
    once = each.groupBy("case_id", "nth", "source_id").agg(F.min("at").alias("at")).groupBy("case_id", "nth").agg(F.array_sort(F.collect_list(F.struct("at", "source_id"))).alias("x"))
    anchors = once.select("case_id", "nth", F.transform("x", lambda x: x["source_id"]).alias("anchors"))
    best = rank_sources(facets, sources, questions).filter("score > 0").groupBy("case_id", "nth").agg(F.array_sort(F.collect_list(F.struct("rank", "source_id"))).alias("r"))
    rows = facets.join(anchors, ["case_id", "nth"], "left").join(best, ["case_id", "nth"], "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"anchors": F.coalesce("anchors", none), "_more": F.coalesce(F.transform("r", lambda x: x["source_id"]), none)})
    wanted = F.when(F.arrays_overlap(match_terms(F.col("aspect")), F.array(*map(F.lit, CONNECTING))), 3).otherwise(2)
    size = F.least(F.lit(SOURCES), F.greatest(wanted, F.size("anchors")))
    return rows.withColumn("source_ids", F.slice(F.array_union("anchors", "_more"), F.lit(1), size)).drop("r", "_more")


_STATE = "struct<sections:array<struct<anchors:array<string>,sources:array<string>,aspects:array<int>>>,gaps:array<int>>"


def sections(ranked: DataFrame) -> DataFrame:
    """(case_id, section, aspects, source_ids) of facet_sources: a pass over each case's facets, by nth; section 0 holds the gaps.

    A facet that is covered or partial and has sources joins the section that shares most of its anchors, if that has all of them; else
    all sections that share some, if these together have all; else it begins a section, while there are less than SECTIONS; else it
    joins the one that shares most, with its anchors. Without any it is a gap. A section keeps SOURCES sources.
    """
    ready = F.col("status").isin("covered", "partial") & (F.size("source_ids") > 0)
    facet = F.struct(F.col("nth").cast("int").alias("nth"), F.coalesce(ready, F.lit(False)).alias("ready"), "anchors", "source_ids")
    rows = ranked.groupBy("case_id").agg(F.array_sort(F.collect_list(facet)).alias("facets"))

    def step(state: Column, f: Column) -> Column:
        held = state["sections"]
        shared = F.transform(held, lambda x: F.size(F.array_intersect(x["anchors"], f["anchors"])))
        most = F.coalesce(F.array_max(shared), F.lit(0))
        best = F.array_position(shared, most).cast("int") - 1
        lacks = lambda have: F.size(F.array_except(f["anchors"], have)) > 0
        inside = (most > 0) & ~lacks(F.coalesce(F.get(held, best)["anchors"], F.array().cast("array<string>")))
        across = (F.size(f["anchors"]) > 0) & ~lacks(F.flatten(F.transform(held, lambda x: x["anchors"])))
        named = lambda x: F.concat(x["aspects"], F.array(f["nth"])).alias("aspects")
        widened = lambda x: F.slice(F.array_union(x["sources"], f["source_ids"]), 1, SOURCES).alias("sources")
        joined = lambda also: F.transform(held, lambda x, k: F.when(k == best, F.struct((F.array_union(x["anchors"], f["anchors"]) if also else x["anchors"]).alias("anchors"), widened(x), named(x))).otherwise(x))
        spread = F.transform(held, lambda x: F.when(F.arrays_overlap(x["anchors"], f["anchors"]), F.struct(x["anchors"].alias("anchors"), x["sources"].alias("sources"), named(x))).otherwise(x))
        begun = F.concat(held, F.array(F.struct(f["anchors"].alias("anchors"), F.slice(f["source_ids"], 1, SOURCES).alias("sources"), F.array(f["nth"]).alias("aspects"))))
        lost = ~f["ready"] | (~inside & ~across & (F.size(held) >= SECTIONS) & (most == 0))
        now = F.when(lost, held).when(inside, joined(False)).when(across, spread).when(F.size(held) < SECTIONS, begun).otherwise(joined(True))
        return F.struct(now.alias("sections"), F.when(lost, F.concat(state["gaps"], F.array(f["nth"]))).otherwise(state["gaps"]).alias("gaps"))

    start = F.expr(f"cast(named_struct('sections', array(), 'gaps', array()) as {_STATE})")
    done = rows.select("case_id", F.aggregate("facets", start, lambda a, f: step(a, f).cast(_STATE)).alias("s"))
    kept = done.select("case_id", F.posexplode("s.sections").alias("k", "x")).select("case_id", (F.col("k") + 1).alias("section"), "x.aspects", F.col("x.sources").alias("source_ids"))
    return kept.union(done.filter(F.size("s.gaps") > 0).select("case_id", F.lit(0), "s.gaps", F.array().cast("array<string>")))
