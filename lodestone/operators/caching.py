"""Work that is done once: parses by content, vectors by checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.rollups import first_by
from lodestone.sources.store import Store, cut, scratch

#: Width of the vectors of hashed words.
WIDTH = 64


def prefix(digest: Column) -> Column:
    """The bucket of a digest: its first two digits after any name of a method."""
    return F.substring(F.regexp_replace(digest, "^[a-z0-9]+:", ""), 1, 2)


def parse_outline(docs: DataFrame) -> DataFrame:
    """(content_hash, format, n_lines, n_words, n_headings) of docs (content_hash, format, text)."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0)))
    return docs.select("content_hash", "format", F.size(lines).alias("n_lines"), words.alias("n_words"), F.size(F.filter(lines, lambda x: x.rlike("^#{1,6} "))).alias("n_headings"))


def parsed(store: Store, docs: DataFrame, version: str, run: int, parse: Callable[[DataFrame], DataFrame] = parse_outline) -> tuple[DataFrame, DataFrame]:
    """(what `parse` gives for each document's content, (run, contents, parsed, reused)); only contents that no run has parsed are parsed.

    The cache is keyed by content_hash, format and the parser's version; a null hash is never kept: such documents have no parse.
    Its files are by the digests' first digits and in their order. Counts are of contents, not of documents that share one.
    """
    name, key = f"parsed {version}", ["content_hash", "format"]
    asked = docs.filter("content_hash is not null").withColumn("format", F.coalesce("format", F.lit("unknown")))
    known = store.read(name)
    new = asked if known is None else asked.join(known.select(*key), key, "left_anti")
    once = first_by(new, key, [F.xxhash64("text")]).select(*key, "text")
    fresh = parse(once).withColumn("_bucket", prefix(F.col("content_hash")))
    store.append(name, fresh.repartition("_bucket").sortWithinPartitions("content_hash"), "_bucket", run)
    contents = asked.select(*key).distinct()
    done = store.live().filter((F.col("name") == name) & (F.col("run") == run)).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("parsed"))
    counts = contents.agg(F.count("*").alias("contents")).join(F.broadcast(done)).select(F.lit(run).alias("run"), "contents", "parsed", (F.col("contents") - F.col("parsed")).alias("reused"))
    return store.read(name).drop("_bucket"), counts


def hashed_words(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """A row for each text: its words, each added to or taken from one of `width` sums by its hash, then of length 1; no words: zeros."""
    import re
    import zlib

    out = np.zeros((len(texts), width), np.float32)
    for row, text in enumerate(texts):
        for word in re.findall(r"\w+", (text or "").lower()):
            h = zlib.crc32(word.encode())
            out[row, h % width] += 1 if h >> 31 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(store: Store, chunks: DataFrame, profile: str, run: int, checkpoint: int = 1_000_000, encoder: Callable[[list[str]], np.ndarray] = hashed_words, batch: int = 256, stop_after: int | None = None) -> tuple[int, int]:
    """(vectors made, checkpoints committed): vectors of the texts of chunks (chunk_hash, text) that the profile has none of.

    The backlog is cut by its hashes into parts of about `checkpoint` texts. Each part's vectors are committed as they are ready, so that
    a run that ends early, or is stopped after some parts, leaves them, and the next one makes only the others. A text is
    embedded once, however many chunks have it.
    """
    name = f"vectors {profile}"
    known = store.read(name)
    backlog = chunks.filter("chunk_hash is not null").select("chunk_hash", "text")
    if known is not None:
        backlog = backlog.join(known.select("chunk_hash"), "chunk_hash", "left_anti")
    backlog = cut(first_by(backlog, ["chunk_hash"], [F.xxhash64("text")]).select("chunk_hash", "text"))
    parts = -(-backlog.count() // checkpoint)
    if not parts:
        return 0, 0
    part = F.conv(F.substring("chunk_hash", 1, 8), 16, 10).cast("long") % parts
    folder = scratch(chunks.sparkSession)
    backlog.withColumn("part", part.cast("int")).repartition("part", F.pmod(F.xxhash64("chunk_hash"), F.lit(64))).write.partitionBy("part").parquet(folder)
    dealt = chunks.sparkSession.read.schema("chunk_hash string, text string, part int").parquet(folder)

    def run_encoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(0, rows.num_rows, batch):
                some = rows.slice(k, batch)
                made = encoder(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(list(made.astype(np.float32)), pa.list_(pa.float32()))], names=["chunk_hash", "embedding"])

    made = done = 0
    for k in range(parts if stop_after is None else min(parts, stop_after)):
        vectors = dealt.filter(F.col("part") == k).select("chunk_hash", "text").mapInArrow(run_encoder, "chunk_hash string, embedding array<float>")
        made += store.append(name, vectors.withColumn("_bucket", prefix(F.col("chunk_hash"))), "_bucket", run)
        done += 1
    return made, done
