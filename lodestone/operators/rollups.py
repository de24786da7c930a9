"""Status, structure, inventory and change detection."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import file_name

SUFFIX_FORMATS = {"md": "markdown", "cpp": "cpp", "hpp": "cpp_header", "f90": "fortran", "py": "python", "txt": "text", "sh": "shell", "cmake": "cmake", "toml": "toml", "json": "config", "html": "html"}
SPECIAL_NAMES = {"cmakelists.txt": "cmake", "makefile": "make", "dockerfile": "config", "readme": "markdown"}
SECRET = r"(^|/)(\.env|id_rsa|.*\.pem|.*\.key|credentials[^/]*)$"
BINARY = r"\.(png|jpg|gif|zip|gz|pdf|exe|so|o|a|bin|mp4)$"


def classify_format(path: Column) -> Column:
    """By special file name, then by suffix."""
    pairs = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    name = F.lower(file_name(path))
    return F.coalesce(pairs(SPECIAL_NAMES)[name], pairs(SUFFIX_FORMATS)[F.regexp_extract(name, r"\.([^.]+)$", 1)], F.lit("unknown"))


def exclusion_reason(path: Column, size: Column, most: int = 2 * 1024 * 1024) -> Column:
    """The first rule that keeps a file out, or null."""
    return (
        F.when(path.rlike(r"(^|/)(\.git|node_modules|build|__pycache__)/"), "excluded_directory")
        .when(path.rlike(r"^docs/html/"), "generated_documentation")
        .when(F.lower(path).rlike(SECRET), "possible_secret")
        .when(F.lower(path).rlike(BINARY), "binary_or_large_result")
        .when(classify_format(path) == "unknown", "unsupported_format")
        .when(size > most, "file_too_large")
    )


def glob_regex(pattern: str) -> str:
    """A glob whose star crosses directories, as a regex; *([0-9]), as in a shell's extended globs, is any number of characters of a class."""
    plain = lambda glob: re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", fnmatch.translate(glob)).replace("(?s:", "(?:")
    return "^" + "".join(plain(x) + "*" * (k % 2) for k, x in enumerate(re.split(r"\*\((\[[^]]+\])\)", pattern))) + "$"


def glob_policy(rows: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    any_of = lambda globs: F.col("path").rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
    return rows.withColumn("verdict", F.when(any_of(exclude), "profile_excluded").when(~any_of(include), "outside_profile_scope").otherwise("kept"))


def snapshot_hash(rows: DataFrame, key: str) -> DataFrame:
    """A hash over the ordered (path, content) pairs of each key: of the sorted hashes of blocks of paths, so that no group is one list."""
    line = F.concat("path", F.lit("\x00"), "content_hash", F.lit("\n"))
    blocks = rows.groupBy(key, F.substring(F.sha2("path", 256), 1, 2).alias("_b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("_h"))
    return blocks.groupBy(key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda x: x["_h"]), ""), 256).alias("snapshot"))


def repository_status(docs: DataFrame, occurrences: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts of documents, occurrences, branches, chunks and embedded documents of each repository."""
    d = docs.groupBy("repository_id").agg(F.count("*").alias("documents"), F.min("project").alias("project"))
    o = occurrences.groupBy("repository_id").agg(F.count("*").alias("occurrences"), F.countDistinct("branch").alias("branches"), F.array_join(F.array_sort(F.collect_set("branch")), ",").alias("branch_names"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("canonical"), F.col("branch")))), ",").alias("canonical_branches"))
    c = chunks.groupBy("repository_id").agg(F.count("*").alias("chunks"))
    e = docs.join(vectors.select("doc_id"), "doc_id", "left_semi").groupBy("repository_id").agg(F.count("*").alias("embedded"))
    out = d.join(o, "repository_id", "left").join(c, "repository_id", "left").join(e, "repository_id", "left")
    return out.na.fill(0, ["occurrences", "branches", "chunks", "embedded"])


def structure(docs: DataFrame, chunks: DataFrame, by: Column, name: str) -> DataFrame:
    """Documents, chunks and bytes of each repository by a key of the path."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("_chunks"))
    return docs.withColumn(name, by).join(n, "doc_id", "left").groupBy("repository_id", name).agg(F.count("*").alias("documents"), F.coalesce(F.sum("_chunks"), F.lit(0)).alias("chunks"), F.sum("size_bytes").alias("bytes"))


def authority(path: Column) -> Column:
    """How much a file speaks for its repository."""
    name, depth = F.lower(file_name(path)), F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return F.when(name.startswith("readme"), F.when(depth == 0, 12).otherwise(7)).otherwise(0) + F.when(depth == 0, 4).otherwise(0) + F.when(name.isin(*SPECIAL_NAMES), 3).otherwise(0) + F.when(F.lower(path).rlike(r"(^|/)docs?/"), 2).otherwise(0) - F.when(F.lower(path).rlike("draft|wip|provisional|tmp"), 6).otherwise(0)


def upsert_actions(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """insert, update (only if a column differs, nulls being equal), keep or delete, for each key."""
    pack = lambda d, n: d.select(F.col(key), F.struct(*columns).alias(n))
    both = pack(old, "_o").join(pack(new, "_n"), key, "full")
    return both.select(key, F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").when(F.col("_o").eqNullSafe(F.col("_n")), "keep").otherwise("update").alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table after the upsert: new rows, and old ones whose key is not new."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def validate(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Violations of unique ids and of references, counted by check."""
    dup = docs.groupBy("document_id").count().filter("count > 1").agg(F.count("*").alias("violations")).withColumn("check", F.lit("duplicate_document"))
    lost = chunks.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("violations")).withColumn("check", F.lit("chunk_without_document"))
    empty = docs.filter("path is null or path = ''").agg(F.count("*").alias("violations")).withColumn("check", F.lit("empty_path"))
    return dup.unionByName(lost).unionByName(empty).select("check", "violations")


def backlog(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents that may be embedded and have no vector yet."""
    return docs.filter("access_class <> 'pending'").join(vectors.select("doc_id"), "doc_id", "left_anti")


def latest(runs: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    return runs.groupBy(key).agg(F.max_by(F.struct(order, *columns), order).alias("_x")).select(key, "_x.*")


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def scoped_documents(docs: DataFrame, preferred: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each document with its preferred occurrence and number of chunks; entry documents (at the root, readmes, Markdown up to two folders down) with their first chunk's title."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min_by("title", "line").alias("_title"))
    depth = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
    entry = (depth == 0) | F.lower(file_name(F.col("path"))).startswith("readme") | ((F.col("format") == "md") & (depth <= 2))
    rows = docs.join(preferred, "doc_id").join(n, "doc_id", "left")
    return rows.select("doc_id", "repository_id", "path", "branch", "canonical", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.when(entry, F.col("_title")).alias("anchor_title"))


def structure_text(by_format: DataFrame, by_top: DataFrame) -> DataFrame:
    """Each repository's layout as a short text: documents and chunks, the 12 commonest formats, the 16 largest entries at the top."""

    def listed(rows: DataFrame, name: str, most: int) -> DataFrame:
        own = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("documents")).alias("n"), F.col(name).alias("name")))), 1, most)
        text = F.array_join(F.transform(own, lambda x: F.concat(x["name"], F.lit(" ("), -x["n"], F.lit(")"))), ", ")
        return rows.groupBy("repository_id").agg(text.alias(name), F.sum("documents").alias("documents"), F.sum("chunks").alias("chunks"))

    both = listed(by_format, "fmt", 12).join(listed(by_top, "top", 16).select("repository_id", "top"), "repository_id")
    return both.select("repository_id", F.concat(F.lit("Documents: "), "documents", F.lit("; chunks: "), "chunks", F.lit("\nFormats: "), "fmt", F.lit("\nTop level: "), "top").alias("text"))
