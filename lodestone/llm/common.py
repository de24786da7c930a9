"""What the operators share: byte views of Arrow columns, hashing in numpy, places to write to."""

from __future__ import annotations

import gc
import hashlib
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that a worker turns into arrays at a time; a longer document makes a block of its own.
BLOCK_BYTES = 1_000_000
#: Rows of an Arrow batch that a worker is given.
BATCH_ROWS = 1000

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_BASE = 0x9E3779B97F4A7C15 | 1


def ship(name: str) -> None:
    """Send the functions of a module to the workers by value: executors need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches small enough for a worker's memory, whatever the length of a row."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions_for(df: DataFrame, most: int = 64_000_000) -> int:
    """The session's number of shuffle partitions, or more, so that each has at most `most` bytes of df's files."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size >= 1 << 54 else max(least, -(-size // most))  # an unknown size is given as 2 ** 63 - 1, in proportion to the columns


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors and the driver see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = f"file://{tempfile.gettempdir()}/lodestone-checkpoints"
    return f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df, written to the shared folder as Parquet and read back: its lineage is cut by files that outlive executors.

    Shuffle files of earlier steps, which nothing reads any more, are let go first.
    """
    spark = df.sparkSession
    gc.collect()
    spark._jvm.System.gc()
    path = folder or shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> _S33)
    x *= _C1
    x ^= x >> _S33
    x *= _C2
    x ^= x >> _S33
    return x


def byte_table(seed: int) -> np.ndarray:
    """A random odd 64-bit number for each byte."""
    return mix((np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1000)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, None, None

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            one = np.ones(self.n, np.uint64)
            with np.errstate(over="ignore"):
                for attribute, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                    x = one * np.uint64(base)
                    x[0] = 1
                    setattr(self, attribute, np.multiply.accumulate(x))
        return self.up, self.down


class RangeHash:
    """64-bit hashes of any ranges of a byte array, from one pass of prefix sums."""

    def __init__(self, data: np.ndarray, powers: Powers, table: np.ndarray):
        up, self.down = powers.to(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.empty(len(data) + 1, np.uint64)
            self.sums[0] = 0
            np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start, end) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start])


_EIGHT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 128


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of a byte array, eight bytes at a time, each mixed in full before the next."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    size = ends - starts
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) * np.uint64(_BASE))
        short = np.flatnonzero(size <= _LONG)
        at, left = starts[short], size[short]
        while len(short):
            out[short] = mix(out[short] ^ (eight[at] & _EIGHT[np.minimum(left, 8)]))
            more = left > 8
            short, at, left = short[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that begins with `name` and that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """(first, last + 1) of runs of documents with at most `most` bytes together, or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal runs of word bytes that don't cross the documents' bounds."""
    inside = is_word[data]
    edge = np.empty(len(data), bool)
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    edge[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1], out=edge[1:])
    at = bounds[1:-1]
    at = at[at < len(data)]
    edge[at] |= inside[at]
    starts = np.flatnonzero(edge)
    last = np.empty(len(data), bool)
    last[-1] = inside[-1]
    np.logical_and(inside[:-1], ~inside[1:], out=last[:-1])
    before = bounds[1:-1] - 1
    before = before[before >= 0]
    last[before] |= inside[before]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_words() -> np.ndarray:
    """Which bytes belong to words [^\\x20\\x09-\\x0D]+."""
    t = np.ones(256, bool)
    t[[0x20, 9, 10, 11, 12, 13]] = False
    return t


def letter_words() -> np.ndarray:
    """Which bytes belong to words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of texts in lower case."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only these columns of docs: others, whatever their names, stay out of the plan."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def map_rows(df: DataFrame, run, columns: list[str]) -> DataFrame:
    """mapInArrow for rows of any columns, whatever their names: `run` gets batches of df and yields lists of the first columns, as changed."""
    kinds = [df.schema[k].dataType for k in range(len(columns))]
    plain = StructType([StructField(f"c{k}", kind) for k, kind in enumerate(kinds)])

    def named(batches):
        for out in run(batches):
            yield pa.RecordBatch.from_arrays(out, names=plain.names)

    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(named, plain).toDF(*columns)


def numbered(docs: DataFrame) -> tuple[DataFrame, str] | None:
    """(docs, written with one more column that tells documents apart, its name); None if doc_id does that: none is null or has two texts.

    The numbers are in the order of doc_id, nulls last, then of the text's hash. A row of the same doc_id and text is one
    row repeated, and has the same number; each row of a null doc_id is a document of its own.
    """
    own, key, row = [F.col(f"`{c}`") for c in docs.columns], F.xxhash64("text"), fresh(docs, "_row")
    each = narrow(docs, "doc_id", "text").select("doc_id", key.alias("key"))
    if each.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("doc_id is null or lo <> hi").isEmpty():
        return None
    place = F.monotonically_increasing_id()
    ranks = written(each.filter("doc_id is not null").distinct().orderBy("doc_id", "key").withColumn("row", place))
    packed = docs.select("doc_id", key.alias("key"), F.struct(*own).alias("doc"))
    known = packed.join(ranks, ["doc_id", "key"]).select("doc", "row")
    others = packed.filter("doc_id is null").withColumn("at", place).orderBy("key", "at").select("doc", (F.lit(1 << 62) + place).alias("row"))
    return written(known.union(others).select("doc.*", F.col("row").alias(row))), row
