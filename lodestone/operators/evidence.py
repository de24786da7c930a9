"""Evidence in answers: code that stands so in a source, claims that outlive their verification, expectations of a suite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, body, indent): lines of texts from 1, without white space at their ends, and their indents; blank lines have neither."""
    lines = F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n", "\n"), "\n")).alias("_p", "_line")
    body = F.regexp_replace("_line", r"^\s+|\s+$", "")
    indent = F.when(body == "", F.lit("")).otherwise(F.regexp_extract("_line", r"^\s*", 0))
    return rows.select(F.col(key), lines).select(key, (F.col("_p") + 1).alias("line"), body.alias("body"), indent.alias("indent"))


def code_blocks(answers: DataFrame, most_chars: int = 8000) -> DataFrame:
    """(answer_id, nth, language, code): fenced blocks of answers (answer_id, text) that are not empty nor longer than `most_chars`."""
    found = F.regexp_extract_all(F.regexp_replace("text", "\r\n", "\n"), F.lit(r"(?s)```([^\n`]*\n.*?)```"), F.lit(1))
    rows = answers.select("answer_id", F.posexplode(found).alias("_p", "_b"))
    language = F.regexp_replace(F.substring_index("_b", "\n", 1), "[^A-Za-z0-9_+.#-]", "")
    rows = rows.select("answer_id", (F.col("_p") + 1).alias("nth"), language.alias("language"), F.regexp_replace("_b", r"^[^\n]*\n", "").alias("code"))
    return rows.filter((F.regexp_replace("code", r"\s", "") != "") & (F.length("code") <= most_chars))


def excerpts(blocks: DataFrame, sources: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(block_id, source_id, first_line, last_line): where blocks (block_id, code) stand in sources (source_id, text) as whole lines in a row.

    Blank lines around a block don't count; white space at lines' ends doesn't either, nor one indent before all of its lines. A block's
    places are those of its rarest line, each then compared line by line, so that a line of every source multiplies nothing.
    `allowed` (block_id, source_id) says which sources a block may come from. A blank block has no place.
    """
    own = source_lines(blocks, "block_id", "code")
    ends = own.filter("body <> ''").groupBy("block_id").agg(F.min("line").alias("_first"), F.max("line").alias("_last"), F.min("indent").alias("_a"), F.max("indent").alias("_b"))
    common = F.size(F.filter(F.transform(F.split("_a", ""), lambda _, k: k + 1), lambda k: F.left("_a", k) == F.left("_b", k)))
    ends = ends.withColumn("_common", F.when(F.col("_a") == "", 0).otherwise(common))  # of the first and the last in order, so of all
    own = own.join(ends, "block_id").filter("line between _first and _last").select("block_id", (F.col("line") - F.col("_first")).alias("at"), "body", F.expr("substring(indent, _common + 1)").alias("indent"), (F.col("_last") - F.col("_first") + 1).alias("size"))
    lines = source_lines(sources, "source_id", "text")
    asked = own.filter("body <> ''")
    frequent = lines.join(asked.select("body").distinct(), "body", "left_semi").groupBy("body").agg(F.count("*").alias("n"))
    rarest = asked.join(frequent, "body").groupBy("block_id").agg(F.min(F.struct("n", "at", "body", "indent", "size")).alias("x")).select("block_id", "x.*")
    starts = rarest.withColumnRenamed("indent", "_indent").join(lines, "body").filter(F.col("indent").endswith(F.col("_indent")))
    if allowed is not None:
        starts = starts.join(allowed.select("block_id", "source_id"), ["block_id", "source_id"], "left_semi")
    before = F.expr("left(indent, length(indent) - length(_indent))")
    starts = starts.select("block_id", "source_id", (F.col("line") - F.col("at")).alias("first_line"), before.alias("before"), "size")
    wanted = starts.join(own.drop("size"), "block_id").withColumn("line", F.col("first_line") + F.col("at"))
    wanted = wanted.withColumn("indent", F.when(F.col("body") == "", F.lit("")).otherwise(F.concat("before", "indent")))
    met = wanted.join(lines, ["source_id", "line", "body", "indent"], "left_semi").groupBy("block_id", "source_id", "first_line", "before", "size").agg(F.count("*").alias("n"))
    return met.filter("n = size").select("block_id", "source_id", "first_line", (F.col("first_line") + F.col("size") - 1).alias("last_line"))


def kept_blocks(found: DataFrame, cited: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block_id, verdict, source_id) of blocks: cited if a source that has it is cited nearby, attached if just one has it, else removed.

    found are (block_id, source_id), cited the citations near each block, of the same columns. source_id is the smallest that holds.
    """
    each = found.select("block_id", "source_id").distinct().join(cited.select("block_id", "source_id").distinct().withColumn("_cited", F.lit(1)), ["block_id", "source_id"], "left")
    sums = each.groupBy("block_id").agg(F.count("*").alias("_n"), F.min("source_id").alias("_any"), F.min(F.when(F.col("_cited") == 1, F.col("source_id"))).alias("_own"))
    rows = blocks.select("block_id").join(sums, "block_id", "left")
    verdict = F.when(F.col("_own").isNotNull(), "cited").when(F.col("_n") == 1, "attached").otherwise("removed")
    return rows.select("block_id", verdict.alias("verdict"), F.when(verdict != "removed", F.coalesce("_own", "_any")).alias("source_id"))


def supported_subset(lines: DataFrame, claims: DataFrame, nested: bool = False) -> DataFrame:
    """(answer_id, n_claims, n_headings, text): what is left of answers when only supported claims are.

    lines are (answer_id, line, text, level), level 0 for no heading; claims (answer_id, line, nth, claim, verdict, n_sources); a claim
    without a line stands at the end. Supported claims with a source stay, each once in a section, in their order; a heading stays if a
    claim does before the next heading, or, if `nested`, before the next one of its level or above. An answer without such claims is none.
    """
    good = claims.filter((F.col("verdict") == "supported") & (F.trim("claim") != "") & (F.col("n_sources") > 0)).withColumn("claim", F.trim("claim"))
    good = good.withColumn("line", F.coalesce("line", F.lit(2**31 - 1)))
    heads = lines.filter("level > 0").select("answer_id", "line", F.lit(0).alias("nth"), F.trim("text").alias("claim"), "level")
    rows = heads.unionByName(good.select("answer_id", "line", F.col("nth").cast("int").alias("nth"), "claim", F.lit(0).alias("level")))
    order = Window.partitionBy("answer_id").orderBy("line", "level", "nth")
    rows = rows.withColumn("_section", F.when(F.col("line") == 2**31 - 1, -1).otherwise(F.count(F.when(F.col("level") > 0, 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    after = order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("_nth", F.row_number().over(order))
    claim = F.min(F.when((F.col("level") == 0) & (F.col("_section") >= 0), F.col("_nth"))).over(after)
    if nested:
        until = F.coalesce(*[F.when(F.col("level") == k, F.min(F.when(F.col("level").between(1, k), F.col("_nth"))).over(after)) for k in range(1, 7)])
    else:
        until = F.min(F.when(F.col("level") > 0, F.col("_nth"))).over(after)
    rows = rows.withColumn("_lives", F.coalesce(claim < F.coalesce(until, F.lit(2**31 - 1)), F.lit(False)))
    copy = F.row_number().over(Window.partitionBy("answer_id", "_section", "level", "claim").orderBy("_nth"))
    elsewhere = F.max((F.col("_section") >= 0).cast("int")).over(Window.partitionBy("answer_id", "level", "claim"))
    rows = rows.withColumns({"_copy": copy, "_else": elsewhere})
    rows = rows.filter(((F.col("level") > 0) & F.col("_lives")) | ((F.col("level") == 0) & (F.col("_copy") == 1) & ((F.col("_section") >= 0) | (F.col("_else") == 0))))
    out = rows.groupBy("answer_id").agg(F.count_if(F.col("level") == 0).alias("n_claims"), F.count_if(F.col("level") > 0).alias("n_headings"), F.array_sort(F.collect_list(F.struct("_nth", "claim"))).alias("_x"))
    return out.filter("n_claims > 0").select("answer_id", "n_claims", "n_headings", F.array_join(F.transform("_x", lambda x: x["claim"]), "\n\n").alias("text"))


#: What each kind of expectation compares: `want` is a text, `wants` a list; the columns of a response otherwise.
CHECKS = {
    "abstained": "abstained = try_cast(want as boolean)",
    "grounding_status": "grounding_status = want",
    "answer_completeness": "answer_completeness = want",
    "allowed_grounding_statuses": "array_contains(wants, grounding_status)",
    "min_valid_citations": "size(citations) >= try_cast(want as double)",
    "max_invalid_citations": "size(invalid_citations) <= try_cast(want as double)",
    "min_sources": "size(sources) >= try_cast(want as double)",
    "min_citation_coverage": "coverage >= try_cast(want as double)",
    "min_scope_citation_coverage": "scope_coverage >= try_cast(want as double)",
    "allowed_finish_reasons": "array_contains(wants, finish_reason)",
    "max_client_duration_seconds": "client_seconds <= try_cast(want as double)",
    "max_generation_duration_seconds": "seconds <= try_cast(want as double)",
    "scope_warning": "scope_warning = try_cast(want as boolean)",
    "exploration_intent": "intent = want",
    "required_source_projects": "size(array_except(wants, sources.project)) = 0",
    "required_source_paths": "size(array_except(wants, sources.path)) = 0",
    "forbidden_answer_phrases": "not exists(wants, x -> contains(lower(answer), lower(x)))",
}
COMPLETENESS = ("complete", "coverage_limited", "supported_subset", "not_delivered")


def expectation_checks(responses: DataFrame, expectations: DataFrame) -> DataFrame:
    """(case_id, check, passed, problem): a row for each expectation (case_id, check, want, wants), which is data, not code.

    responses are (case_id, abstained, grounding_status, answer_completeness, citations, invalid_citations, sources: array of (project,
    path), coverage, scope_coverage, finish_reason, client_seconds, seconds, scope_warning, intent, answer). A missing list is empty, a missing
    duration 0, any other missing value meets nothing, nor does a case without a response. An expectation that is none of CHECKS, or whose
    value is none for it, has a problem and no result; so has a case that names both one grounding status and several.
    """
    lists = {c: F.coalesce(c, F.array().cast(dict(responses.dtypes)[c])) for c in ("citations", "invalid_citations", "sources")}
    filled = responses.withColumns(lists).withColumns({"seconds": F.coalesce("seconds", F.lit(0.0)), "answer": F.coalesce("answer", F.lit("")), "_known": F.lit(True)})
    plural = [k for k, v in CHECKS.items() if "wants" in v]
    numeric = [k for k in CHECKS if k.startswith(("min_", "max_"))]
    rows = expectations.join(filled, "case_id", "left")
    passed = F.coalesce(*[F.when(F.col("check") == k, F.coalesce(F.expr(v), F.lit(False))) for k, v in CHECKS.items()])
    both = F.max(F.when(F.col("check") == "grounding_status", 1)).over(Window.partitionBy("case_id"))
    bad_list = F.col("wants").isNull() | F.exists("wants", lambda x: x.isNull()) | ((F.col("check") != "allowed_finish_reasons") & F.exists("wants", lambda x: F.coalesce(x, F.lit("")) == ""))
    problem = (
        F.when(~F.coalesce(F.col("check").isin(*CHECKS), F.lit(False)), "unknown")
        .when(F.col("check").isin(*plural), F.when(bad_list, "no list of texts").when((F.col("check") == "allowed_grounding_statuses") & (both == 1), "given twice"))
        .when(F.col("check").isin(*numeric), F.when(F.expr("try_cast(want as double) is null"), "no number"))
        .when(F.col("check").isin("abstained", "scope_warning"), F.when(~F.coalesce(F.col("want").isin("true", "false"), F.lit(False)), "no boolean"))
        .when(F.col("check") == "answer_completeness", F.when(~F.coalesce(F.col("want").isin(*COMPLETENESS), F.lit(False)), "unknown value"))
        .when(F.col("want").isNull(), "no text")
    )
    return rows.select("case_id", "check", F.when(problem.isNull(), passed & F.coalesce("_known", F.lit(False))).alias("passed"), problem.alias("problem"))
