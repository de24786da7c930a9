"""The coverage ledger: what is known of each aspect of a case, from a stream of judgements or a table of them.

Keyed state is one row for each case and aspect: the name by which the aspect came first, its latest judgement, its place. It does not
depend on the order in which judgements arrive, as they are numbered; so a stream's state and one aggregate over all of them agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.sources.store import scratch

#: What a judgement may say, and how much a ledger holds.
STATUSES = ("covered", "partial", "gap")
ASPECT_CHARS, REQUIRED, ASPECTS, CHUNKS = 120, 6, 10, 8


def aspect_text(aspect: Column) -> Column:
    """An aspect as it is shown: white space in one piece, not too long, null if nothing is left."""
    return F.nullif(F.left(F.trim(F.regexp_replace(aspect, r"\s+", " ")), F.lit(ASPECT_CHARS)), F.lit(""))


def folded(judgements: DataFrame) -> DataFrame:
    """(case_id, key, aspect, first_seq, last_seq, status, chunk_ids) of judgements (case_id, seq, aspect, status, chunk_ids), a batch or a stream.

    Of each aspect, whatever the case of its letters, the judgement of the greatest seq counts. One that is none of STATUSES or names no
    aspect is left out; chunk ids are distinct, in their order, at most CHUNKS; covered without any is partial.
    """
    text = aspect_text(F.col("aspect"))
    ids = F.slice(F.array_distinct(F.filter(F.coalesce("chunk_ids", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")), 1, CHUNKS)
    rows = judgements.select("case_id", "seq", text.alias("aspect"), F.lower(text).alias("key"), "status", ids.alias("chunk_ids")).filter(F.col("status").isin(*STATUSES) & F.col("key").isNotNull() & F.col("seq").isNotNull())
    said = F.struct(F.when((F.col("status") == "covered") & (F.size("chunk_ids") == 0), "partial").otherwise(F.col("status")).alias("status"), "chunk_ids")
    out = rows.groupBy("case_id", "key").agg(F.min_by("aspect", "seq").alias("aspect"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by(said, "seq").alias("x"))
    return out.select("case_id", "key", "aspect", "first_seq", "last_seq", "x.status", "x.chunk_ids")


def reconciled(entries: DataFrame, required: DataFrame | None = None, required_only: bool = False) -> DataFrame:
    """(case_id, place, aspect, status, chunk_ids): the required aspects (case_id, nth, aspect) first, a gap where nothing is known, then the others as they came."""
    rows = entries.withColumns({"_late": F.lit(1), "_at": F.col("first_seq").cast("long")})
    if required is not None:
        text = aspect_text(F.col("aspect"))
        named = required.select("case_id", "nth", text.alias("label"), F.lower(text).alias("key")).filter("key is not null")
        named = named.groupBy("case_id", "key").agg(F.min(F.struct("nth", "label")).alias("x")).select("case_id", "key", "x.*")
        named = named.withColumn("_r", F.row_number().over(Window.partitionBy("case_id").orderBy("nth", "key"))).filter(F.col("_r") <= REQUIRED)
        both = entries.join(named, ["case_id", "key"], "right" if required_only else "full")
        rows = both.select("case_id", "key", F.coalesce("label", "aspect").alias("aspect"), F.coalesce("status", F.lit("gap")).alias("status"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"), F.when(F.col("label").isNull(), 1).otherwise(0).alias("_late"), F.coalesce(F.col("_r").cast("long"), F.col("first_seq").cast("long")).alias("_at"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("_late", "_at", "key"))
    return rows.withColumn("place", place).filter(F.col("place") <= ASPECTS).select("case_id", "place", "aspect", "status", "chunk_ids")


def complete_and_stable(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, stable): whether all aspects of a case (ledgers as of reconciled) are covered by chunks, and both ledgers say the same."""
    of = lambda rows, name: rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(F.lower("aspect").alias("key"), "status", F.array_sort("chunk_ids").alias("ids")))).alias(name))
    full = F.forall("now", lambda x: (x["status"] == "covered") & (F.size(x["ids"]) > 0))
    return of(after, "now").join(of(before, "past"), "case_id", "left").select("case_id", F.coalesce(full & (F.col("now") == F.col("past")), F.lit(False)).alias("stable"))


def stream_ledger(spark: SparkSession, source: str, schema: StructType, folder: str | None = None, files_per_batch: int = 1) -> DataFrame:
    """The folded ledger of all judgement files (Parquet) in a folder, as a stream that takes what is there and stops.

    State lives in the query's checkpoint below `folder`; a later call with the same folder goes on from it, and reads new files only.
    Each batch's changed rows are appended under its number, so that a batch that runs again writes over its own.
    """
    folder = folder or scratch(spark)
    judgements = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/changes/batch={batch:09d}")

    folded(judgements).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    kinds = StructType([*folded(spark.createDataFrame([], schema)).schema.fields]).add("_batch", "integer")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/changes")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], kinds).drop("_batch")
    changes = spark.read.schema(kinds).parquet(f"{folder}/changes")
    own = [c for c in changes.columns if c not in ("batch", "_batch")]
    return changes.groupBy("case_id", "key").agg(F.max_by(F.struct(*own), "_batch").alias("x")).select("x.*")
