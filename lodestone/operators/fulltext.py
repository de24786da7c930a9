"""Full text: a positional inverted index, bucketed by term, and ranking by the density of covers.

A query is a web-style one: words that must all occur, "phrases", OR between alternatives, - before what must not occur. A cover is a
shortest run of words that satisfies an alternative: its start is the latest from which the run still does, and each cover starts after
the one before. A cover of n query words with weights w counts n / sum(1 / w), divided by one more than the other words between. The
sum over covers, r, gives r / (r + 1).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.ids import citation, tied
from lodestone.operators.access import allowed, preferred_occurrence
from lodestone.operators.search import in_scope

#: A word; the same in queries.
WORD = r"[\p{L}\p{N}_]+"
#: What a word in a title and in a text weighs.
TITLE_WEIGHT, TEXT_WEIGHT = 1.0, 0.4
BUCKETS = 32


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def postings(chunks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(term, chunk_id, pos, in_title, bucket): a row for each word of chunks (chunk_id, title, text); the text's places follow the title's."""
    title, text = words_of(F.col("title")), words_of(F.col("text"))
    rows = chunks.select("chunk_id", F.size(title).alias("_n"), F.posexplode(F.concat(title, text)).alias("_p", "term"))
    return rows.select("term", "chunk_id", (F.col("_p") + 1).alias("pos"), (F.col("_p") < F.col("_n")).alias("in_title"), F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"))


def build_index(chunks: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Write the postings to a folder: one directory for each bucket, files sorted by term, so that a query opens its terms' buckets only and skips other terms' row groups.

    A bucket's rows are dealt to several files by chunk, so that a word of every chunk is not one task's.
    """
    rows = postings(chunks, buckets)
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-tasks // buckets))))
    rows.repartition(max(tasks, buckets), "bucket", parts).sortWithinPartitions("bucket", "term", "chunk_id", "pos").write.partitionBy("bucket").parquet(folder)


INDEX = "term string, chunk_id string, pos int, in_title boolean, bucket int"


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(folder)


def parse(query: str) -> list[tuple[list[list[str]], list[list[str]]]]:
    """Alternatives of (items that must occur, items that must not); an item is the words of a phrase, or one word."""
    out, need, ban = [], [], []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query.lower()):
        if word == "or" and not minus:
            out.append((need, ban))
            need, ban = [], []
            continue
        words = re.findall(r"\w+", phrase or word)
        if words:
            (ban if minus else need).append(words)
    out.append((need, ban))
    return [a for a in out if a[0]]


def _terms(alternatives) -> list[str]:
    return sorted({w for need, ban in alternatives for item in [*need, *ban] for w in item})


def lookup(index: DataFrame, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings of some terms: other buckets' directories are not listed, other terms' row groups not read."""
    spark = index.sparkSession
    own = spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()
    return index.filter(F.col("bucket").isin([r.b for r in own]) & F.col("term").isin(terms))


def cover_density(index: DataFrame, query: str, buckets: int = BUCKETS) -> DataFrame:
    """(chunk_id, rank) of the chunks that satisfy the query, by the index alone."""
    alternatives = parse(query)
    terms = _terms(alternatives)
    if not alternatives:
        return index.limit(0).select("chunk_id", F.lit(0.0).alias("rank"))
    found = lookup(index, terms, buckets)
    chunk = Window.partitionBy("chunk_id").orderBy("pos")
    before = chunk.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.when(F.col("in_title"), F.lit(TITLE_WEIGHT)).otherwise(F.lit(TEXT_WEIGHT))
    rows = found.withColumns({"_inv": 1 / weight, "_nth": F.row_number().over(chunk)})
    rows = rows.withColumn("_at", F.struct("pos", "_nth", F.coalesce(F.sum("_inv").over(before), F.lit(0.0)).alias("sum")))

    def ends(item: list[str]) -> Column:
        """The start of the item if it ends here."""
        on = F.col("term") == item[-1]
        for back, word in enumerate(reversed(item[:-1]), 1):
            on = on & (F.lag("term", back).over(chunk) == word) & (F.lag("pos", back).over(chunk) == F.col("pos") - back)
        start = F.col("_at") if len(item) == 1 else F.lag("_at", len(item) - 1).over(chunk)
        return F.when(on, start)

    items = [item for need, ban in alternatives for item in [*need, *ban]]
    rows = rows.withColumns({f"_end{k}": ends(item) for k, item in enumerate(items)})
    so_far, whole = chunk.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("chunk_id")
    starts, k = [], 0
    for need, ban in alternatives:
        last = [F.last(f"_end{k + n}", True).over(so_far) for n in range(len(need))]
        every = reduce(lambda a, b: a & b, [x.isNotNull() for x in last])
        for n in range(len(ban)):
            every = every & F.max(f"_end{k + len(need) + n}").over(whole).isNull()
        starts.append(F.when(every, F.least(*last) if len(last) > 1 else last[0]))
        k += len(need) + len(ban)
    rows = rows.withColumn("_start", F.greatest(*starts) if len(starts) > 1 else starts[0])
    rows = rows.withColumn("_past", F.max("_start").over(before)).filter(F.col("_start").isNotNull() & (F.col("_past").isNull() | (F.col("_start") > F.col("_past"))))
    n = F.col("_nth") - F.col("_start._nth") + 1
    own = n / (F.col("_at.sum") + F.col("_inv") - F.col("_start.sum"))
    noise = (F.col("pos") - F.col("_start.pos")) - (n - 1)
    covers = rows.select("chunk_id", (own / (1 + noise)).alias("_own"))
    return covers.groupBy("chunk_id").agg(F.sum("_own").alias("_r")).select("chunk_id", (F.col("_r") / (F.col("_r") + 1)).alias("rank"))


def search(index: DataFrame, chunks: DataFrame, occurrences: DataFrame, query: str, limit: int = 10, per_path: int = 3, duplicates: bool = False, classes=("public", "lab"), scopes=None, branch: str | None = None, path_prefix: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The best chunks: ten times the rank, more where the query as it stands is in path, title or text, and for canonical ones.

    chunks are (chunk_id, doc_id, repository_id, project, path, line, title, text, access_class). Access classes and the scope hold
    before anything is ranked. Chunks of the query's words come from the index, those of its text from a scan.
    """
    seen = allowed(chunks, classes)
    if path_prefix is not None:
        seen = seen.filter(F.col("path").startswith(path_prefix))
    seen = seen.join(preferred_occurrence(occurrences, branch), "doc_id")
    if scopes is not None:
        seen = in_scope(seen, scopes)
    raw = query.lower()
    has = {c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(raw)) for c in ("path", "title", "text")}
    ranked = seen.join(cover_density(index, query, buckets), "chunk_id", "left").filter(F.col("rank").isNotNull() | has["path"] | has["title"] | has["text"])
    bonus = lambda on, x: F.when(on, F.lit(float(x))).otherwise(F.lit(0.0))
    score = 10 * F.coalesce("rank", F.lit(0.0)) + bonus(has["path"], 8) + bonus(has["title"], 4) + bonus(has["text"], 2) + bonus(F.col("canonical"), 0.25)
    rows = ranked.withColumns({"score": tied(score), "chunk_hash": F.sha2("text", 256)})
    rows = rows.withColumn("citation", citation(F.col("project"), F.col("branch"), F.col("commit_sha"), F.col("path"), F.col("line"), F.col("line")))
    best = lambda *keys: Window.partitionBy(*keys[0]).orderBy(F.desc("score"), *keys[1:])
    if not duplicates:
        rows = rows.withColumn("_r", F.row_number().over(best(["chunk_hash"], "path", "chunk_id"))).filter("_r = 1")
    rows = rows.withColumn("_r", F.row_number().over(best(["repository_id", "path"], "chunk_id"))).filter(F.col("_r") <= per_path).drop("_r")
    return rows.orderBy(F.desc("score"), "path", "chunk_id").limit(limit)
