"""Access classes, branch scopes, and the occurrence that stands for a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From open to closed; the last is never retrievable.
RANKS = ("public", "lab", "project", "restricted", "pending")


def rank(access: Column) -> Column:
    return F.coalesce(*[F.when(access == c, F.lit(k)) for k, c in enumerate(RANKS)], F.lit(len(RANKS)))


def most_restrictive(a: Column, b: Column) -> Column:
    return F.when(rank(a) >= rank(b), a).otherwise(b)


def allowed(rows: DataFrame, classes: tuple[str, ...] = ("public",)) -> DataFrame:
    """Only rows of these classes: a predicate on the scan, before any text is looked at."""
    if bad := set(classes) - set(RANKS[:-1]):
        raise ValueError(f"not retrievable: {sorted(bad)}")
    return rows.filter(F.col("access_class").isin(*classes))


def preferred_occurrence(occurrences: DataFrame, branch: str | None = None) -> DataFrame:
    """One occurrence a document: canonical first, then by branch. An aggregate, so that no key's rows meet in a sort."""
    rows = occurrences if branch is None else occurrences.filter(F.col("branch") == branch)
    best = F.min(F.struct((~F.col("canonical")).alias("k"), F.col("branch").isNull().alias("b"), "branch", "commit_sha")).alias("o")
    return rows.groupBy("doc_id").agg(best).select("doc_id", "o.branch", (~F.col("o.k")).alias("canonical"), "o.commit_sha")


def occurrence_rollup(occurrences: DataFrame) -> DataFrame:
    """A document's occurrences as one ordered text, and their number."""
    own = F.array_sort(F.collect_list(F.struct((~F.col("canonical")).alias("k"), "branch")))
    return occurrences.groupBy("doc_id").agg(F.array_join(F.transform(own, lambda x: x["branch"]), ",").alias("branches"), F.count("*").alias("n"))
