"""Quality rules, line first: lines that fail a rule go, then documents that lose too much of their text.

Built of SQL functions alone. A line (between \\n, with a word) fails if it lacks closing punctuation, if it is
dense in symbols or exclamations, if it looks like navigation (bars, or a short line of menu words), or if it holds
a boilerplate phrase. A document is kept if its base measures pass and at least KEPT_TENTHS tenths of its words are
in lines that stay.

Null and empty texts have no words, and fail; repeated rows are judged each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import narrow

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SPLIT = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
CLOSING = ".!?:;)]\"'…”»"
MENU = r"^[\x20\x09-\x0D]*(home|menu|login|log in|sign in|sign up|search|contact|about|next|previous|back|accueil|connexion|recherche|startseite|anmelden|suche|inicio|buscar|contacto)([^a-z]|$)"
BOILERPLATE = (
    "cookie",
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "licensed under",
    "copyright",
    "javascript",
    "subscribe to",
    "click here",
    "lorem ipsum",
    "tous droits réservés",
    "mentions légales",
    "cliquez ici",
    "alle rechte vorbehalten",
    "datenschutz",
    "impressum",
    "todos los derechos reservados",
    "política de privacidad",
    "haga clic",
)
KEPT_TENTHS = 7


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """How many words are in windows of three words that the text has twice or more."""

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1), x + 3) - x)), F.lit(0), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
        at = F.transform(pairs, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        return let(F.sort_array(F.filter(at, lambda i: i.isNotNull())), covered)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows(words), count))


def without(text: Column, what: str) -> Column:
    """text without the characters of `what`, one search of bytes each (translate looks up every character)."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), what, text)


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(without(text, what))


def line_fails(line: Column, n: Column) -> Column:
    """Whether a line of n words fails a rule."""
    bangs = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    return (
        ~F.contains(F.lit(CLOSING), F.right(F.rtrim(line, F.lit(SPACE)), F.lit(1)))
        | (5 * _count(line, SYMBOLS) > n)
        | (10 * bangs > 3 * n)
        | (_count(line, "|") >= 2)
        | let(F.lower(line), lambda low: ((n <= 10) & low.rlike(MENU)) | reduce(operator.or_, [F.contains(low, F.lit(phrase)) for phrase in BOILERPLATE]))
    )


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, n_kept_words, and clean_text: the lines that stay."""
    d = narrow(docs, "doc_id", "text").withColumn("t", F.coalesce("text", F.lit("")))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.ltrim(x, F.lit(SPACE)) != ""))
    d = d.withColumn("w", F.filter(F.split("t", SPLIT), lambda x: x != ""))
    kept = F.filter(F.transform("lines", lambda x: let(F.size(F.split(F.trim(x, F.lit(SPACE)), SPLIT)), lambda n: F.when(~line_fails(x, n), F.struct(x.alias("x"), n.alias("n"))))), lambda x: x.isNotNull())
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(without(F.col("t"), SPACE)).cast("long").alias("word_chars"),
        _count(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        kept.alias("_kept"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    d = d.withColumn("n_kept_words", F.aggregate("_kept", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    d = d.withColumn("kept", ~F.col("base_failed") & (10 * F.col("n_kept_words") >= KEPT_TENTHS * F.col("n_words")))
    return d.withColumn("clean_text", F.array_join(F.transform("_kept", lambda x: x["x"]), "\n")).drop("_kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("clean_text")


def _sql_count(what: str) -> str:
    return f"(length(x) - length(translate(x, '{what}', '')))"


_CHARS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_CLOSED = r"[.!?:;)\]\"'…”»][\x20\x09-\x0D]*$"
_QUOTED = {k: v.replace("'", "''") for k, v in {"closed": _CLOSED, "menu": MENU, "boiler": "|".join(BOILERPLATE)}.items()}
SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '{WORD}') as w from d),
g as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from (select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w))),
r as (select doc_id, count(distinct i + j) as n_repeat_words from (select doc_id, i, unnest(range(0, 3)) as j from g where n > 1) group by doc_id),
l as (select doc_id, x, len(regexp_extract_all(x, '{WORD}')) as n from (select doc_id, unnest(string_split(t, chr(10))) as x from d)),
k as (select doc_id, count(*) - count(distinct x) as n_dup_lines, sum(case when not regexp_matches(x, '{_QUOTED["closed"]}') or 5 * {_sql_count(SYMBOLS)} > n or 5 * (length(x) - length(replace(x, '!!', ''))) > 3 * n or {_sql_count("|")} >= 2 or (n <= 10 and regexp_matches(lower(x), '{_QUOTED["menu"]}')) or regexp_matches(lower(x), '{_QUOTED["boiler"]}') then 0 else n end) as n_kept_words from l where n > 0 group by doc_id),
m as (select w.doc_id, cast(len(w) as bigint) as n_words, cast(length(translate(t, {_CHARS}, '')) as bigint) as word_chars, cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as bigint) as n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(coalesce(n_kept_words, 0) as bigint) as n_kept_words from w left join r on w.doc_id = r.doc_id left join k on w.doc_id = k.doc_id),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select *, not base_failed and 10 * n_kept_words >= {KEPT_TENTHS} * n_words as kept from f
"""
