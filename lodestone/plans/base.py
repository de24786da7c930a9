"""Where the queries and their SQL are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources import corpus
from lodestone.sources.corpus import SQL as PRE

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, pre: bool = True):
    """Registers a function of (docs, occurrences, chunks, spark, sf_dir)."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            d = corpus.documents(spark, sf_dir)
            return f(d, corpus.occurrences(d), corpus.chunks(d), spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = (PRE + sql) if pre else sql
        return f

    return add
