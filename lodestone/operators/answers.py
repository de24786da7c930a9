"""Questions, answers and their evaluation: intent, scope, packing, citations, grounding, ranks."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import citation_ids

#: Intents in the order in which they are tried, and the words that show them.
INTENTS = (
    ("overview", r"\b(overview|structure|architecture|summary|summarize)\b"),
    ("comparison", r"\b(compare|difference|versus|vs|between)\b"),
    ("location", r"\b(where|which file|located|defined)\b"),
    ("mechanism", r"\b(how|why|flow|works)\b"),
)


def normalized(text: str) -> str:
    """Words of a text without marks and case, joined by spaces."""
    import re

    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return " ".join(re.findall("[a-z0-9]+", plain))


def intent(question: Column) -> Column:
    out = F.lit("direct")
    for name, pattern in reversed(INTENTS):
        out = F.when(F.lower(question).rlike(pattern), name).otherwise(out)
    return out


def scopes(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """(question_id, project): projects that a question names as a word; a question that names none has all, mode broad."""
    words = questions.select("question_id", F.explode(F.array_distinct(F.split(F.lower("question"), "[^a-z0-9]+"))).alias("_w"))
    named = words.join(catalog.select("project", F.lower("project").alias("_w")).distinct(), "_w").groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set("project")), ",").alias("projects"))
    return questions.select("question_id").join(named, "question_id", "left").select("question_id", F.coalesce("projects", F.lit("*")).alias("projects"), F.when(F.col("projects").isNull(), "broad").otherwise("projects").alias("mode"))


def preferred_branch(occurrences: DataFrame, configured: str) -> DataFrame:
    """The configured branch where a repository has it, else the canonical one, else none."""
    o = occurrences.groupBy("repository_id").agg(F.max((F.col("branch") == configured).cast("int")).alias("_has"), F.min(F.when(F.col("canonical"), F.col("branch"))).alias("_canonical"))
    return o.select("repository_id", F.when(F.col("_has") == 1, configured).otherwise(F.col("_canonical")).alias("branch"), F.when(F.col("_has") == 1, "configured").when(F.col("_canonical").isNotNull(), "canonical").otherwise("none").alias("status"))


def interleave(groups: DataFrame, limit: int) -> DataFrame:
    """Round robin over ranked groups (grp, pos, chunk_id): first of each, then seconds; a chunk counts once."""
    once = groups.withColumn("_r", F.row_number().over(Window.partitionBy("chunk_id").orderBy("pos", "grp"))).filter("_r = 1").drop("_r")
    return once.orderBy("pos", "grp").limit(limit)


def pack(ranked: DataFrame, budget: int, least: int) -> DataFrame:
    """Shares of a character budget for a short ranked list (pos, chunk_id, n_chars): each gets the fair share of what remains."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "chunk_id", F.col("n_chars").cast("long").alias("n"))))
    init = F.struct(F.lit(budget).cast("long").alias("left"), F.expr("cast(array() as array<struct<pos:int,chunk_id:string,given:bigint>>)").alias("out"))

    def step(size):
        def one(a, x):
            slots = size - F.size(a["out"])
            share = F.greatest(F.lit(least).cast("long"), F.ceil(a["left"] / slots))
            given = F.least(x["n"], share)
            return F.when(a["left"] <= 0, a).otherwise(F.struct((a["left"] - given).alias("left"), F.concat(a["out"], F.array(F.struct(x["pos"].alias("pos"), x["chunk_id"].alias("chunk_id"), given.alias("given")))).alias("out")))

        return one

    return ranked.agg(rows.alias("r")).select(F.explode(F.aggregate("r", init, step(F.size("r")), lambda a: a["out"])).alias("x")).select("x.*")


def factual_units(answers: DataFrame) -> DataFrame:
    """Units of answers (answer_id, text): lines outside code fences that are no headings, of 12 characters with a letter at least, and no labels; with their citations."""
    lines = answers.select("answer_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    fences = F.sum(F.trim("line").startswith("```").cast("int")).over(Window.partitionBy("answer_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    plain = F.trim(F.regexp_replace("line", r"^\s*[-*]\s+|\[S[0-9][^\]]*\]", ""))
    rows = lines.withColumns({"_f": fences, "unit": plain}).filter("_f % 2 = 0").filter(~F.trim("line").startswith("```") & ~F.col("line").rlike(r"^\s*#"))
    rows = rows.filter((F.length("unit") >= 12) & F.col("unit").rlike("[A-Za-zÀ-ÿ]") & ~((F.length("unit") <= 60) & F.col("unit").endswith(":")))
    return rows.select("answer_id", "p", "unit", F.array_join(citation_ids(F.col("line")), ",").alias("cited"))


def coverage(units: DataFrame) -> DataFrame:
    cited = F.sum((F.col("cited") != "").cast("int"))
    return units.groupBy("answer_id").agg(F.count("*").alias("units"), cited.alias("cited_units"), (cited / F.count("*")).alias("coverage"))


def grounding(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """invalid_citations, missing_citations, partial_citations or cited, for answers (answer_id, text) against their sources (answer_id, source_id)."""
    used = answers.select("answer_id", F.explode(F.array_distinct(citation_ids(F.col("text")))).alias("source_id"))
    checked = used.join(sources.withColumn("_ok", F.lit(1)), ["answer_id", "source_id"], "left").groupBy("answer_id").agg(F.count("_ok").alias("valid"), F.sum(F.col("_ok").isNull().cast("int")).alias("invalid"))
    out = answers.select("answer_id").join(checked, "answer_id", "left").join(coverage(factual_units(answers)), "answer_id", "left").na.fill(0, ["valid", "invalid"])
    status = F.when(F.col("invalid") > 0, "invalid_citations").when(F.col("valid") == 0, "missing_citations").when(F.coalesce("coverage", F.lit(1.0)) < 1, "partial_citations").otherwise("cited")
    return out.select("answer_id", "valid", "invalid", status.alias("status"))


def verdicts(claims: DataFrame, findings: DataFrame) -> DataFrame:
    """A claim is supported only by a finding that names one of the sources it cites; without a finding it is uncertain."""
    f = findings.select("claim_id", "verdict", F.col("source_id").alias("_s"))
    rows = claims.join(f, "claim_id", "left")
    own = F.array_contains(F.split("cited", ","), F.col("_s"))
    verdict = F.when(F.col("verdict").isNull(), "uncertain").when((F.col("verdict") == "supported") & ~F.coalesce(own, F.lit(False)), "unsupported").otherwise(F.col("verdict"))
    return rows.select("claim_id", verdict.alias("verdict"))


def first_ranks(results: DataFrame, expectations: DataFrame) -> DataFrame:
    """For each expectation (case_id, exp_id, path_prefix, within_rank): the first result (case_id, rank, path) that meets it."""
    met = expectations.join(results, "case_id").filter(F.col("path").startswith(F.col("path_prefix"))).groupBy("case_id", "exp_id").agg(F.min("rank").alias("first_rank"))
    return expectations.join(met, ["case_id", "exp_id"], "left").select("case_id", "exp_id", "first_rank", (F.coalesce("first_rank", F.lit(10**9)) <= F.col("within_rank")).alias("met"))


def summary(ranks: DataFrame) -> DataFrame:
    """Pass rate, recall of expectations, and mean reciprocal rank of each case's best first rank."""
    case = ranks.groupBy("case_id").agg(F.min(F.col("met").cast("int")).alias("passed"), F.sum(F.col("met").cast("int")).alias("met"), F.count("*").alias("n"), F.min("first_rank").alias("best"))
    return case.agg(F.count("*").alias("cases"), F.sum("passed").alias("passed"), (F.sum("met") / F.sum("n")).alias("recall"), F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr"))


def term_rarity(chunks: DataFrame) -> DataFrame:
    """ln((n + 1) / (df + 1)) + 1 of each word, by the documents that have it."""
    words = chunks.select("doc_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) >= 4))).alias("term")).groupBy("term").agg(F.countDistinct("doc_id").alias("df"))
    n = chunks.agg(F.countDistinct("doc_id").alias("n"))  # one row
    return words.join(F.broadcast(n)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("rarity"))


#: Phrases that give the indexed projects out as all there are.
OVERCLAIMS = r"\b(projetos principais|principais projetos|unicos projetos|main projects|principal projects|only projects|complete set of projects)\b"
#: What begins a sentence, and the steps that put each on a line: citations behind a stop are tied to it, stops cut, ties undone.
_BEGIN, _TIE = r"[`*_>(\[]*[A-ZÀ-ÖØ-Þ0-9]", "\x1f"
SENTENCES = (
    (r"([.!?])\s+(\[\s*S\d[S\d,;\s]*\])(\s+" + _BEGIN + "|$)", f"\\1{_TIE}\\2\\3"),
    (f"([.!?](?:{_TIE}[^\\]]*\\])?)\\s+({_BEGIN})", "\\1\n\\2"),
    (_TIE, " "),
)


def overclaims(text: Column) -> Column:
    """Whether an overview claims more than the scope: over words in small letters without marks."""
    plain = F.regexp_replace(F.translate(F.lower(text), "áàâãäçéèêëíìîïñóòôõöúùûü", "aaaaaceeeeiiiinooooouuuu"), "[^a-z0-9]+", " ")
    return plain.rlike(OVERCLAIMS)


def atomic_claims(units: DataFrame) -> DataFrame:
    """unit_id, p, claim: the sentences of units (unit_id, text). Where only the last one has citations, all others inherit them."""
    cut = F.col("text")
    for pattern, to in SENTENCES:
        cut = F.regexp_replace(cut, pattern, to.replace("\\", "$"))
    parts = F.filter(F.transform(F.split(cut, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    ids = lambda x: citation_ids(x)
    rows = units.select("unit_id", F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim("text"))).alias("parts"))
    rows = rows.withColumns({"_last": F.array_sort(F.array_distinct(ids(F.element_at("parts", -1)))), "_cited": F.size(F.filter("parts", lambda x: F.size(ids(x)) > 0))})
    inherits = (F.size("parts") > 1) & (F.col("_cited") == 1) & (F.size("_last") > 0)
    rows = rows.select("unit_id", inherits.alias("_inherits"), F.concat(F.lit(" ["), F.array_join("_last", ", "), F.lit("]")).alias("_suffix"), F.posexplode("parts").alias("p", "claim"))
    return rows.select("unit_id", "p", F.when(F.col("_inherits") & (F.size(ids(F.col("claim"))) == 0), F.concat("claim", "_suffix")).otherwise(F.col("claim")).alias("claim"))


def report(cases: DataFrame, by: str) -> DataFrame:
    """Cases, passed, pass rate, mean duration and mean citation coverage of cases (passed, duration, coverage), by suite."""
    passed = F.sum(F.col("passed").cast("long"))
    return cases.groupBy(by).agg(F.count("*").alias("cases"), passed.alias("passed"), F.round(passed / F.count("*"), 6).alias("pass_rate"), F.round(F.avg("duration"), 4).alias("mean_duration"), F.round(F.avg("coverage"), 4).alias("mean_coverage"))
