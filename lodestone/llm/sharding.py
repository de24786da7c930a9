"""Size-tiered compaction of document shards, of SQL functions alone.

Arrivals (documents in the order of doc_id, PER_ARRIVAL ids each) are appended as small immutable shards, each a run of its own. A
run's tier follows its size: UNIT_BYTES * FANOUT^t bytes of text or more make tier t. Compaction goes through the tiers from
the lowest: of each CHUNK of arrival numbers, FANOUT runs of one tier at a time, in the order of their first arrivals, are merged into
one, whose tier is at least the next. The cascade is planned on the runs' sizes alone, so that each row is written once;
runs that no merge takes stay where they are, unread. A merged run is cut into files of TARGET_BYTES of text by prefix sums of
sizes, first over arrivals and then within one, so that no sum needs a whole run in one task. What the sums give, the keys
at which further files begin in an arrival, is written, so that Spark knows its size: a small table is broadcast and
documents move once, to their files; a large one is joined by arrival.

A manifest version is a file that must not exist when it is created, and whose last word says that it is whole; it names a
table of runs. Readers take the highest whole version. Data folders have unique names, and what no version lists doesn't count, so
that a writer lost between data and manifest leaves nothing behind that matters.

An append's arrivals are numbered after all earlier ones, so that small appends are merged with each other. Rows of a null doc_id are dealt
by their texts' digests to NULLS arrivals before those of the ids, in a first append of negative numbers; a null text has no bytes; repeated
rows stay, and equal ones that a file's end would part go to the later file together; an empty table adds no runs; other columns,
whatever their names, are kept in the shards.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.common import shared_folder, written

PER_ARRIVAL, FANOUT, UNIT_BYTES, TARGET_BYTES, TIERS, CHUNK, NULLS = 500, 4, 256_000, 16_000_000, 16, 65_536, 4096
RUNS = "seq long, tier int, bytes long, folder string"


class Manifest:
    """Numbered versions of a store's list of runs, in a folder of a Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self.path(self.folder)
        if not self.fs.exists(at):
            return []
        return sorted(int(n[9:-5]) for n in (s.getPath().getName() for s in self.fs.listStatus(at)) if n.startswith("manifest-"))

    def _read(self, version: int) -> dict | None:
        source = self.fs.open(self.path(f"{self.folder}/manifest-{version}.json"))
        try:
            found = json.loads(bytes(source.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            source.close()
        return found if found.get("whole") else None

    def latest(self) -> dict:
        """The committed manifest: version, runs (folder of their table), folders (of data), schema (of documents)."""
        for version in reversed(self.versions()):
            if found := self._read(version):
                return found
        return {"version": 0, "runs": None, "folders": [], "schema": None}

    def commit(self, new: dict, after: int) -> dict:
        """Commits the version that follows `after` and all later broken ones, or fails if another writer has."""
        if self.latest()["version"] != after:
            raise RuntimeError(f"another writer has committed a version after {after}")
        self.fs.mkdirs(self.path(self.folder))
        new = new | {"version": max([after, *self.versions()]) + 1, "whole": True}
        try:
            out = self.fs.create(self.path(f"{self.folder}/manifest-{new['version']}.json"), False)
        except Exception as e:
            raise RuntimeError(f"version {new['version']} was committed by another writer") from e
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        return new


def tier_of(size: Column) -> Column:
    """The tier of a run of this many bytes."""
    return sum((F.when(size >= UNIT_BYTES * FANOUT**t, 1).otherwise(0) for t in range(1, TIERS)), F.lit(0))


def merges(runs: DataFrame, levels: int) -> DataFrame:
    """runs (seq, tier, bytes, ...) with the run (first arrival), tier and bytes that each ends in."""
    out = runs.withColumnsRenamed({"tier": "was"}).withColumns({"run": F.col("seq"), "tier": F.col("was"), "total": F.col("bytes"), "chunk": F.floor(F.col("seq") / CHUNK)}).repartition("chunk")
    alike = Window.partitionBy("chunk", "tier")
    for t in range(levels):
        group = F.floor((F.dense_rank().over(alike.orderBy("run")) - 1) / FANOUT)
        out = out.withColumn("_group", F.when(F.col("tier") == t, group))
        rank = F.when(F.col("tier") == t, F.dense_rank().over(alike.orderBy("run")))
        out = out.withColumn("_whole", F.floor(F.max(rank).over(alike) / FANOUT)).withColumn("_taken", F.coalesce(F.col("_group") < F.col("_whole"), F.lit(False)))
        together = Window.partitionBy("chunk", "tier", "_group")
        out = out.withColumns({"_run": F.min("run").over(together), "_total": F.sum("bytes").over(together)})
        out = out.withColumns({"run": F.when(F.col("_taken"), F.col("_run")).otherwise(F.col("run")), "total": F.when(F.col("_taken"), F.col("_total")).otherwise(F.col("total")), "tier": F.when(F.col("_taken"), F.greatest(F.lit(t + 1), tier_of(F.col("_total")))).otherwise(F.col("tier"))})
    return out.drop("_group", "_whole", "_taken", "_run", "_total", "chunk")


class ShardStore:
    """A store of documents: append() adds small shards, compact() merges runs of similar size, read() gives what the manifest lists."""

    def __init__(self, spark: SparkSession, folder: str, per_arrival: int = PER_ARRIVAL, target_bytes: int = TARGET_BYTES):
        self.spark, self.folder, self.per_arrival, self.target, self.manifest = spark, folder, per_arrival, target_bytes, Manifest(spark, folder)

    def runs(self, manifest: dict) -> DataFrame:
        """The listed runs, as RUNS."""
        return self.spark.read.schema(RUNS).parquet(f"{self.folder}/{manifest['runs']}") if manifest["runs"] else self._none(StructType.fromDDL(RUNS))

    def _none(self, schema: StructType) -> DataFrame:
        return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    def _commit(self, runs: DataFrame, folders: list[str], schema: str, after: int) -> dict:
        name = f"runs-{uuid.uuid4().hex}"
        runs.coalesce(1).write.parquet(f"{self.folder}/{name}")
        return self.manifest.commit({"runs": name, "folders": folders, "schema": schema}, after)

    def _data(self, manifest: dict, folders: list[str]) -> DataFrame:
        """Rows (doc, arrival, run, shard, folder) of these folders, whether their runs are listed or not."""
        kind = StructType.fromJson(json.loads(manifest["schema"])) if manifest["schema"] else StructType().add("doc_id", "long").add("text", "string")
        stored = StructType().add("doc", kind).add("arrival", "long").add("run", "long").add("shard", "string")
        out = self._none(StructType([*stored.fields]).add("folder", "string"))
        for name in folders:
            out = out.unionByName(self.spark.read.schema(stored).parquet(f"{self.folder}/{name}").select("doc", "arrival", "run", "shard", F.lit(name).alias("folder")))
        return out

    def append(self, docs: DataFrame) -> dict:
        """Writes the arrivals of docs as small shards, without moving rows between tasks; arrival numbers go on after those of earlier appends."""
        now, name = self.manifest.latest(), f"data-{uuid.uuid4().hex}"
        runs = self.runs(now)
        last, base = runs.agg(F.max("seq")).first()[0], 0
        if last is not None:  # all numbers of this append, those of null and negative ids too, come after all there are
            least = docs.agg(F.min("doc_id")).first()[0] or 0
            base = last + 1 + max(NULLS, -(least // self.per_arrival))
        text = F.coalesce(F.col("text"), F.lit(""))
        nameless = -1 - F.conv(F.substring(F.md5(text), 1, 3), 16, 10).cast("long") % NULLS
        arrival = F.coalesce(F.floor(F.col("doc_id") / self.per_arrival), nameless).cast("long") + base
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), arrival.alias("arrival"))
        rows.select("doc", "arrival", F.col("arrival").alias("run"), F.concat(F.lit("a-"), "arrival").alias("shard")).write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        schema = docs.schema.json()
        size = F.coalesce(F.octet_length("doc.text"), F.lit(0)).cast("long")
        new = self._data({"schema": schema}, [name]).groupBy(F.col("run").alias("seq")).agg(F.sum(size).alias("bytes"))
        new = new.select("seq", tier_of(F.col("bytes")).alias("tier"), "bytes", F.lit(name).alias("folder"))
        return self._commit(runs.unionByName(new), [*now["folders"], name], schema, now["version"])

    def placed(self, rows: DataFrame, plan: DataFrame) -> DataFrame:
        """rows (doc, arrival, run, folder) with the merged run (tier, into) of plan (folder, run) and the file there."""
        size = F.coalesce(F.octet_length("doc.text"), F.lit(0)).cast("long")
        key = F.struct(F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.sha2(F.coalesce("doc.text", F.lit("")), 256).alias("digest"))
        sizes = rows.select("folder", "arrival", "run", size.alias("size"), key.alias("key")).groupBy("folder", "arrival", "run", "key").agg(F.sum("size").alias("size"))
        arrivals = sizes.groupBy("folder", "arrival", "run").agg(F.sum("size").alias("bytes")).join(plan, ["folder", "run"])
        earlier = Window.partitionBy("into").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)  # CHUNK arrivals at most
        arrivals = arrivals.select("folder", "arrival", "tier", "into", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"))
        within = Window.partitionBy("folder", "arrival").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
        files = sizes.join(arrivals, ["folder", "arrival"]).withColumn("file", F.floor((F.col("before") + F.col("within")) / self.target).cast("long"))
        begins = files.groupBy("folder", "arrival", "tier", "into", "file").agg(F.min("key").alias("key"))
        begins = begins.groupBy("folder", "arrival", "tier", "into").agg(F.min("file").alias("_first"), F.sort_array(F.collect_list(F.struct("key", "file"))).alias("_begins"))  # an item for TARGET_BYTES
        begins = written(begins.withColumn("_begins", F.filter("_begins", lambda x: x["file"] > F.col("_first"))))
        rows = rows.join(begins, ["folder", "arrival"])
        return rows.withColumn("file", F.coalesce(F.get(F.reverse(F.filter("_begins", lambda x: x["key"] <= key)), F.lit(0))["file"], "_first"))

    def compact(self) -> dict:
        """Merges runs of similar size, rewrites only these, and commits a manifest; the same one if there is nothing to merge."""
        now = self.manifest.latest()
        runs = self.runs(now)
        count, top = runs.agg(F.count("*"), F.max("tier")).first()
        if count < FANOUT:
            return now
        plan = written(merges(runs, min(TIERS, top + math.ceil(math.log(count, FANOUT)) + 1)))
        crowded = plan.filter("tier <> was").select("folder").distinct().collect()  # a folder for each append or compaction
        if not crowded:
            return now
        taken = [r.folder for r in crowded]
        moved = plan.filter("tier <> was").select(F.col("seq").alias("run"), F.col("folder").alias("_folder"), "tier", F.col("run").alias("into"))
        name = f"data-{uuid.uuid4().hex}"
        live = self._data(now, taken).select("doc", "arrival", "run", "folder").join(moved.select(F.col("run").alias("_run"), "_folder"), (F.col("run") == F.col("_run")) & (F.col("folder") == F.col("_folder")), "left_semi")
        rows = self.placed(live.select("doc", "arrival", "run", "folder"), moved.select(F.col("_folder").alias("folder"), "run", "tier", "into"))
        shard = F.concat_ws("-", F.lit("t"), "tier", "into", "file")
        rows = rows.select("doc", "arrival", F.col("into").alias("run"), shard.alias("shard"))
        rows.repartition("shard").sortWithinPartitions("shard", "doc.doc_id").withColumn("file", F.col("shard")).write.option("compression", "zstd").partitionBy("file").parquet(f"{self.folder}/{name}")
        merged = plan.filter("tier <> was").groupBy(F.col("run").alias("seq"), "tier").agg(F.sum("bytes").alias("bytes")).withColumn("folder", F.lit(name))
        left = plan.filter("tier = was").select("seq", "tier", "bytes", "folder")
        stay = {r.folder for r in left.select("folder").distinct().collect()}
        return self._commit(left.unionByName(merged), [*(f for f in now["folders"] if f in stay), name], now["schema"], now["version"])

    def vacuum(self, keep_versions: int = 1) -> int:
        """Deletes the data folders that none of the last whole versions lists; how many. Not while a writer is at work."""
        whole = [found for v in reversed(self.manifest.versions()) if (found := self.manifest._read(v))][:keep_versions]
        listed = {name for found in whole for name in found["folders"]}
        gone = [s.getPath() for s in self.manifest.fs.listStatus(self.manifest.path(self.folder)) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in listed]
        for path in gone:
            self.manifest.fs.delete(path, True)
        return len(gone)

    def read(self) -> DataFrame:
        """doc (the document's columns) and shard, as the committed manifest lists them."""
        now = self.manifest.latest()
        listed = self.runs(now).select(F.col("seq").alias("_seq"), F.col("folder").alias("_folder"))
        return self._data(now, now["folders"]).join(listed, (F.col("run") == F.col("_seq")) & (F.col("folder") == F.col("_folder")), "left_semi").select("doc", "shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ShardStore(spark, shared_folder(spark))
    store.append(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    store.compact()
    rows = store.read()
    return rows.select(F.col("doc.doc_id").alias("doc_id"), "shard", F.coalesce(F.octet_length("doc.text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("doc.text", F.lit("")), 256).alias("text_sha256"))


def _sql_tier(size: str) -> str:
    return "(" + " + ".join(f"case when {size} >= {UNIT_BYTES * FANOUT**t} then 1 else 0 end" for t in range(1, TIERS)) + ")"


def _sql_levels() -> str:
    """For each tier: ranks of its runs, groups that are whole, the merged runs."""
    out = ""
    for t in range(TIERS):
        out += f"""
x{t} as (select *, dense_rank() over (partition by chunk, tier order by run) as r from m{t}),
y{t} as (select *, case when tier = {t} then (r - 1) // {FANOUT} end as g, max(r) over (partition by chunk, tier) // {FANOUT} as most from x{t}),
z{t} as (select *, tier = {t} and g < most as taken, min(run) over (partition by chunk, tier, g) as g_run, sum(bytes) over (partition by chunk, tier, g) as g_total from y{t}),
m{t + 1} as (select arrival, bytes, chunk, case when taken then g_run else run end as run, case when taken then greatest({t + 1}, {_sql_tier("g_total")}) else tier end as tier, was from z{t}),"""
    return out


SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
s as (select *, cast(strlen(t) as bigint) as n_bytes, coalesce(cast(floor(doc_id / {PER_ARRIVAL}.0) as bigint), -1 - cast('0x' || substr(md5(t), 1, 3) as bigint) % {NULLS}) as arrival from d),
a as (select arrival, cast(sum(n_bytes) as bigint) as bytes from s group by arrival),
m0 as (select arrival, bytes, cast(floor(arrival / {CHUNK}.0) as bigint) as chunk, arrival as run, {_sql_tier("bytes")} as tier, {_sql_tier("bytes")} as was from a),{_sql_levels()}
b as (select *, coalesce(sum(bytes) over (partition by run order by arrival rows between unbounded preceding and 1 preceding), 0) as before from m{TIERS}),
k as (select doc_id, t, any_value(n_bytes) as each, arrival, count(*) as copies, sum(n_bytes) as n_bytes from s group by doc_id, t, arrival),
w as (select *, coalesce(sum(n_bytes) over (partition by arrival order by doc_id nulls first, sha256(t) rows between unbounded preceding and 1 preceding), 0) as within from k)
select doc_id, case when tier = was then 'a-' || w.arrival else 't-' || tier || '-' || run || '-' || cast((before + within) // {TARGET_BYTES} as bigint) end as shard, each as n_bytes, sha256(t) as text_sha256 from w join b on w.arrival = b.arrival, range(copies)
"""
