"""Sources and sinks: file trees, JSON lines, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), size_bytes, content_hash and content of the files of a tree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.col("path"), r"^.*?\Q" + root.rstrip("/").split(":")[-1].lstrip("/") + r"\E/", "")
    return files.select(base.alias("path"), F.col("length").alias("size_bytes"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"), "content")


def decoded(files: DataFrame) -> DataFrame:
    """files with their text, and whether it is UTF-8 as it stands or with replacements."""
    return files.withColumns({"text": F.make_valid_utf8(F.col("content").cast("string")), "encoding": F.when(F.expr("is_valid_utf8(cast(content as string))"), "utf-8").otherwise("utf-8-replace")}).drop("content")


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines of a known schema; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def branch_items(manifest: DataFrame) -> DataFrame:
    """The items of a sync manifest (project, branches of name, commit_sha, canonical, items), one row each."""
    b = manifest.select("project", F.explode("branches").alias("b"))
    return b.select("project", F.col("b.name").alias("branch"), "b.commit_sha", "b.canonical", F.explode("b.items").alias("i")).select("project", "branch", "commit_sha", "canonical", "i.*")
