"""The incremental pipeline: a file stream of document batches, merged by key into versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()[8:]) for p in names if p.getName().startswith("version-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table as of its highest complete version."""
    versions = _versions(spark, folder)
    return spark.read.parquet(f"{folder}/version-{versions[-1]}") if versions else None


def merge(spark: SparkSession, folder: str, batch: DataFrame, key: str, order: str, version: int) -> None:
    """Writes version `version` of the table: of each key the row with the greatest `order`, in the batch or the table.

    A null order comes before all others, ties go to the batch, then by the row's hash. A repeated batch changes nothing.
    """
    if version in _versions(spark, folder):
        return
    if order not in batch.columns:
        raise ValueError(f"no column {order} that tells which row is newer")
    rows, old = batch.withColumn("_new", F.lit(1)), current(spark, folder)
    if old is not None:
        rows = rows.unionByName(old.withColumn("_new", F.lit(0)))
    own = [F.col(f"`{c}`") for c in batch.columns]
    newest = F.struct(F.col(f"`{order}`").isNotNull().alias("a"), F.col(f"`{order}`").alias("b"), F.col("_new").alias("c"), F.xxhash64(*own).alias("d"))
    out = rows.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max_by(F.struct(*own), newest).alias("x")).select("x.*")
    out.write.mode("overwrite").parquet(f"{folder}/version-{version}")


def index_available(spark: SparkSession, source: str, schema: StructType, folder: str, key: str, order: str) -> None:
    """Takes all files that are new in `source` into the table, exactly once by key, and stops."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(source)
    run = stream.writeStream.option("checkpointLocation", f"{folder}/_stream").trigger(availableNow=True).foreachBatch(lambda df, n: merge(spark, folder, df, key, order, n + 1)).start()
    run.awaitTermination()
