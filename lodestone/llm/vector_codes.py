"""Vector code compression: product quantisation by Lloyd's rounds that are maintained by what changed.

Each vector becomes PARTS indexes into small codebooks. A round is one pass over the state (vec_id, label, integers, indexes): a task
assigns its rows anew by the codebooks, writes them with their new indexes, and beside them what its rows add to and take from the
entries' sums: one line for each entry that a part came to or left, so nothing for parts that stayed. Only these lines are
shuffled; they are added to the running sums, a table of PARTS * ENTRIES rows of integers, which gives the next codebooks. State
and sums are written to the shared folder; when a round's state is whole, that of the round before is deleted.

Sums are integers, so that the order of rows and tasks can't change a result. The driver holds the codebooks, whatever the number
of rows. Errors are summed by label before they are joined back; the join is left to Spark, which knows the written sums' size and
splits a label that holds many rows.

Rows of a null vector, or of one with a null or infinite component or one that is no number, are dropped. Vectors are filled with
zeros to the longest one's length, and to a multiple of PARTS. Codebooks start from as many vectors as there are, where these are fewer than
ENTRIES; null ids come last, ties in the order of the integers. Repeated rows are rows of their own. Integers are held within
vectors.MOST. An empty table gives no rows. Columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, narrow, shared_folder, ship, written
from lodestone.llm.vectors import MOST, integers, widened

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each row and part of x [row, part, position]; ties to the lower index."""
    best = np.zeros(x.shape[:2], np.int64)
    least = np.full(x.shape[:2], np.iinfo(np.int64).max)
    for k in range(books.shape[1]):
        apart = x - books[:, k]
        far = np.einsum("rpd,rpd->rp", apart, apart)
        nearer = far < least
        best[nearer], least[nearer] = k, far[nearer]
    return best, least


class Changes:
    """What parts add to the sums of the entries that they came to, and take from those that they left."""

    def __init__(self, parts: int, entries: int, size: int):
        self.sums = np.zeros((parts * entries, size + 1), np.int64)
        self.met = np.zeros(parts * entries, bool)
        self.entries = entries

    def add(self, x: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        row, part = np.nonzero(before != after)
        own = np.concatenate([x[row, part], np.ones((len(row), 1), np.int64)], axis=1)
        for index, sign in ((after, 1), (before, -1)):
            at = part * self.entries + index[row, part]
            known = index[row, part] >= 0
            np.add.at(self.sums, at[known], sign * own[known])
            self.met[at[known]] = True

    def rows(self):
        for at in np.flatnonzero(self.met).tolist():
            yield at // self.entries, at % self.entries, self.sums[at].tolist()


class Round:
    """A pass over the state, and the folders that it leaves."""

    state = "vec_id long, label {label}, x array<bigint>, code binary, error bigint, part int, entry int, sums array<bigint>, kind int"

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.schema, self.folder = spark, self.state.format(label=label), None

    def write(self, rows: DataFrame, run) -> None:
        """Write what `run` makes of the rows, and delete the rows that the round before left."""
        before, self.folder = self.folder, shared_folder(self.spark)
        concurrent = "spark.sql.maxConcurrentOutputFileWriters"
        known = self.spark.conf.get(concurrent)
        self.spark.conf.set(concurrent, "2")  # else rows would be sorted by their kind
        try:
            rows.mapInArrow(run, self.schema).write.partitionBy("kind").parquet(self.folder)
        finally:
            self.spark.conf.set(concurrent, known)
        if before:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def read(self, kind: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder).filter(F.col("kind") == kind)


def _books(sums: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the floor of their parts' mean, where they have any."""
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code binary, error), codebooks [part, entry, position]) of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = vectors.schema["label"].dataType
    source = narrow(vectors, "vec_id", "label", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    whole = source.filter(F.col("embedding").isNotNull() & finite)
    quantised = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(MOST))), F.lit(float(MOST)))))
    first = [r.x for r in whole.select("vec_id", quantised.alias("x")).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
    longest = whole.agg(F.max(F.size("embedding"))).first()[0] or 0
    size = -(-longest // parts)
    width, k = parts * size, max(1, len(first))
    books = np.zeros((parts, k, size), np.int64)
    for at, row in enumerate(first):
        books[:, at] = np.pad(np.array(row, np.int64), (0, width - len(row))).reshape(parts, size)
    running, step = None, Round(spark, kind.simpleString())

    def lines(changes: Changes, at: pa.Schema) -> pa.RecordBatch:
        made = list(zip(*changes.rows())) or [(), (), ()]
        n = len(made[0])
        return pa.RecordBatch.from_arrays([*[pa.nulls(n, f.type) for f in list(at)[:5]], *[pa.array(m, f.type) for m, f in zip(made, list(at)[5:8])], pa.array([1] * n, pa.int32())], schema=at)

    def a_round(books: np.ndarray, fresh: bool, last: bool):
        def run(batches):
            changes, at = Changes(parts, k, size), None
            for batch in batches:
                if fresh:
                    places, x = integers(batch.column(2), scale)
                    if not len(places):
                        continue
                    batch = batch.take(pa.array(places))
                    before = np.full((len(x), parts), -1)
                else:
                    x = batch.column(2).flatten().to_numpy().reshape(len(batch), width)
                    before = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(batch), parts).astype(np.int64)
                x = widened(x, width).reshape(len(batch), parts, size)
                after, far = assign(x, books)
                if not last:
                    changes.add(x, before, after)
                n = len(batch)
                codes = after.astype(np.uint8).tobytes()
                flat = pa.array([] if last else x.reshape(-1), pa.int64())
                at = pa.schema([("vec_id", pa.int64()), ("label", batch.column(1).type), ("x", pa.list_(pa.int64())), ("code", pa.binary()), ("error", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.int64())), ("kind", pa.int32())])
                held = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (0 if last else width), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held, pa.array([codes[i * parts : (i + 1) * parts] for i in range(n)], pa.binary()), pa.array(far.sum(axis=1)), *[pa.nulls(n, f.type) for f in list(at)[5:8]], pa.array(np.zeros(n, np.int32))], schema=at)
            if at is not None and not last:
                yield lines(changes, at)

        return run

    for turn in range(rounds + 1):
        step.write(step.read(0) if turn else source, a_round(books, not turn, turn == rounds))
        if turn < rounds:
            changes = step.read(1).select("part", "entry", "sums")
            running = written((running.union(changes) if running else changes).groupBy("part", "entry").agg(F.array(*[F.sum(F.col("sums")[d]) for d in range(size + 1)]).alias("sums")))
            sums = np.zeros((parts, k, size + 1), np.int64)
            for r in running.collect():  # parts * entries rows at most
                sums[r.part, r.entry] = r.sums
            books = _books(sums, books)
    return step.read(0).select("vec_id", "label", "code", "error"), books[:, : len(first)]


def digest(books: np.ndarray) -> str:
    """SHA-256 of the codebooks' integers, in the order of part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    by_label = coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    code = F.lower(F.hex("code"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("own")), "left").select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The contract's rounds, one after the other: parts are rows of single components here."""
    near = lambda r: f"""a{r} as materialized (
    select place, part, arg_min(entry, struct_pack(far := far, entry := entry)) as entry, min(far) as far
    from (select x.place, x.part, b.entry, cast(sum((x.v - b.v) * (x.v - b.v)) as bigint) as far
          from x join b{r} b on x.part = b.part and x.d = b.d group by all) group by all)"""  # noqa: E731
    moved = lambda r: f"""b{r + 1} as materialized (
    select b.part, b.entry, b.d, coalesce(m.v, b.v) as v
    from b{r} b left join (select x.part, a.entry, x.d, cast(floor(sum(x.v) / count(*)) as bigint) as v
                           from x join a{r} a on x.place = a.place and x.part = a.part group by all) m
    on b.part = m.part and b.entry = m.entry and b.d = m.d)"""  # noqa: E731
    rounds = ",\n".join(f"{near(r)},\n{moved(r)}" for r in range(ROUNDS))
    return f"""
with kept as materialized (
    select row_number() over (order by vec_id) - 1 as place, vec_id, label, len(embedding) // {PARTS} as size,
           list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (
    select place, (i - 1) // size as part, (i - 1) % size as d, v[i] as v
    from (select place, size, v, unnest(range(1, len(v) + 1)) as i from kept)),
b0 as materialized (select part, place as entry, d, v from x where place < {ENTRIES}),
{rounds},
{near(ROUNDS)},
coded as (
    select place, string_agg(format('{{:02x}}', entry), '' order by part) as code, cast(sum(far) as bigint) as error from a{ROUNDS} group by place)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(cast(v as varchar), ',' order by part, entry, d)) from b{ROUNDS}) as codebooks_sha256
from coded join kept using (place)
"""


SQL = _sql()

ship(__name__)
