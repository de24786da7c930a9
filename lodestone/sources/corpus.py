"""A knowledge-base corpus derived from the supplied tables: documents, occurrences on branches, line chunks, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.ids import stable_id

EXTENSIONS = ("md", "cpp", "hpp", "f90", "py", "txt")
ACCESS = ("public", "lab", "project", "restricted", "pending")


def pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ext = pick(F.col("doc_id"), EXTENSIONS)
    d = d.select(
        "doc_id",
        F.col("source").alias("repository_id"),
        F.concat(F.lit("P"), F.substring("source", 4, 9).cast("int") % 5).alias("project"),
        F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), "doc_id", F.lit("."), ext).alias("path"),
        ext.alias("format"),
        pick(F.col("doc_id"), ACCESS).alias("access_class"),
        F.col("n_chars").alias("size_bytes"),
        F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash"),
        "text",
    )
    return d.withColumn("document_id", stable_id("repository_id", "path", "content_hash", "access_class"))


def occurrences(docs: DataFrame) -> DataFrame:
    """A row for each document and branch: none to three branches a document."""
    i = F.col("doc_id")
    branch = lambda on, name, canonical: F.when(on, F.struct(F.lit(name).alias("branch"), F.lit(canonical).alias("canonical")))
    each = F.array(branch(i % 7 != 0, "main", True), branch(i % 2 == 0, "dev", False), branch(i % 3 == 0, "feature/x", False))
    return docs.select("doc_id", "repository_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("o")).select("doc_id", "repository_id", "o.branch", "o.canonical", F.concat("repository_id", F.lit("@"), "o.branch").alias("commit_sha"))


def chunks(docs: DataFrame) -> DataFrame:
    """A chunk for each line that isn't blank."""
    lines = docs.select("doc_id", "repository_id", "project", "path", "format", "access_class", F.posexplode(F.split("text", "\n")).alias("_p", "_line"))
    text = F.trim("_line")
    return lines.filter(text != "").select("doc_id", "repository_id", "project", "path", "format", "access_class", (F.col("_p") + 1).alias("line"), F.concat("doc_id", F.lit(":"), F.col("_p") + 1).alias("chunk_id"), text.alias("text"), F.substring_index(text, " ", 2).alias("title"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


_case = lambda values: "case doc_id % " + str(len(values)) + " " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values)) + " end"
#: The same corpus as DuckDB CTEs, to put before an oracle's own.
SQL = f"""
with docs as (select *, sha256(repository_id || chr(0) || path || chr(0) || content_hash || chr(0) || access_class || chr(0)) as document_id from (select doc_id, source as repository_id, 'P' || (cast(substr(source, 4) as int) % 5) as project, lang || '/' || source || '/doc_' || doc_id || '.' || {_case(EXTENSIONS)} as path, {_case(EXTENSIONS)} as format, {_case(ACCESS)} as access_class, n_chars as size_bytes, 'sha256:' || sha256(text) as content_hash, text from documents)),
occ as (select doc_id, repository_id, branch, canonical, repository_id || '@' || branch as commit_sha from (select doc_id, repository_id, 'main' as branch, true as canonical from docs where doc_id % 7 <> 0 union all select doc_id, repository_id, 'dev', false from docs where doc_id % 2 = 0 union all select doc_id, repository_id, 'feature/x', false from docs where doc_id % 3 = 0)),
chunks as (select doc_id, repository_id, project, path, format, access_class, cast(line as int) as line, doc_id || ':' || line as chunk_id, trim(l) as text, array_to_string((string_split(trim(l), ' '))[1:2], ' ') as title from (select *, unnest(string_split(text, chr(10))) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from docs) where trim(l) <> ''),
pref as (select doc_id, branch, canonical from (select *, row_number() over (partition by doc_id order by canonical desc, branch) as r from occ) where r = 1)
"""
