"""Exact removal of repeated passages: depth-limited radix sort of suffixes, most significant digits first.

Only the order of suffixes through their first 100 bytes (the depth) matters: suffixes that agree so far are
the occurrences of a repeated window. The passes, each of which only goes on with groups that are not done:

1. The digit is the suffix's lowest 48-byte string within the depth (by a hash): all suffixes with one
   window share it, and so do most neighbours, so that a whole run of suffixes goes as one anchor: the string's
   hash, a hash of its surroundings (52 bytes on either side, as far as the document goes) and its place.
   Anchors are dealt by their digit. Where string and surroundings agree, all suffixes of the run agree, and all
   but the first run are covered. A digit with a single kind of surroundings is done.
2. Of digits with several kinds of surroundings, the first anchor of each kind goes on: its suffixes are dealt
   by a longer digit (74 or 75 bytes: the string and what follows, or what precedes), so that a frequent
   string does not bring unlike surroundings together. Suffixes are then ordered by their whole depth; groups of equal
   ones are exactly the repeated windows, and all but the first are covered. Equal ones agree in two hashes of the longer
   digit, of different make (128 bits), and in each of the other bytes.

A batch of documents keeps only the first anchor of each kind (the others are covered by it), so that a group of
copies, whatever its share of all rows, is dealt out as at most one anchor a batch.

Matches never cross documents; "earlier" is a smaller doc_id, or an earlier start in the same document. Texts are
judged as UTF-8 bytes; a null is an empty text; a row repeated whole is one occurrence, and each of its copies gets
the same result; texts that share a doc_id are documents of their own, in the order of their hashes; each row of a
null doc_id is a document of its own, later than all others; an empty table gives no rows; other columns are kept by
dedup_text and never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Powers, RangeHash, blocks, bounded_batches, byte_table, column_bytes, fresh, map_rows, mix, narrow, numbered, partitions_for, ship, word_hashes, written

#: Bytes of a window; bytes of the anchor string; bytes on either side of it that its windows reach.
WINDOW, ANCHOR = 100, 48
REACH = WINDOW - ANCHOR
#: Windows that begin up to NEAR bytes before the anchor are dealt by the anchor and what follows it, others by what precedes it.
NEAR = REACH // 2
#: Window starts that are looked at together in one long document; bytes of text that are, of short ones.
SEGMENT = BLOCK = 500_000
#: Buckets of digits for each partition of the documents; a worker sorts one, in some ten times its bytes.
BUCKETS = 3
#: Suffixes that are ordered together (or those of one digit): each is looked at as the NEAR + 1 windows around its digit.
SUFFIXES = 20_000
ANCHOR_TYPE = np.dtype([("h", "<u8"), ("c", "<u8"), ("d", "<i8"), ("p", "<i8")])
SPAN_TYPE = np.dtype([("d", "<i8"), ("a", "<i8"), ("b", "<i8")])


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each `width` neighbours of x, by doubling."""
    n, have = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while have * 2 <= width:
        x, have = f(x[: len(x) - have], x[have:]), have * 2
    return f(x[:n], x[width - have : width - have + n]) if have < width else x[:n]


def anchors(data: np.ndarray, bounds: np.ndarray, hashes: RangeHash, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, digit, hash of the surroundings) of the anchors of all windows that begin in first..last - 1."""
    n = len(data)
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 3
    begin = np.arange(n - ANCHOR + 1)
    digit = hashes(begin, begin + ANCHOR) | np.uint64(1)
    low = _slide(digit, REACH + 1, np.minimum)  # of each window
    valid = np.zeros(len(low) + 1, np.int32)
    has = np.diff(bounds) >= WINDOW
    np.add.at(valid, bounds[:-1][has], 1)
    np.add.at(valid, bounds[1:][has] - WINDOW + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    valid[:first] = False
    valid[len(valid) if last is None else last :] = False
    low[~valid] = 0
    pad = np.zeros(REACH, np.uint64)
    place = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), REACH + 1, np.maximum) == digit)
    doc = np.searchsorted(bounds, place, side="right") - 1
    left, right = np.maximum(bounds[doc], place - REACH), np.minimum(bounds[doc + 1], place + WINDOW)
    with np.errstate(over="ignore"):
        around = mix(hashes(left, right) + (place - left).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (right - place).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return place, digit[place], around


def merged(spans: np.ndarray) -> np.ndarray:
    """SPAN_TYPE spans, put together where they touch or overlap, by document."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["a"], spans["d"]))]
    doc = np.concatenate([[0], np.cumsum(np.diff(spans["d"]) != 0)])
    wide = np.int64(spans["b"].max() + 1)
    reach = np.maximum.accumulate(spans["b"] + doc * wide)
    fresh = np.concatenate([[True], (spans["a"] + doc * wide)[1:] > reach[:-1]])
    at = np.flatnonzero(fresh)
    out = spans[at]
    out["b"] = reach[np.append(at[1:], len(spans)) - 1] - doc[at] * wide
    return out


def split_kinds(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first anchors of each kind, others): found in the order of digit, surroundings, document and place, each once."""
    if not len(found):
        return found, found
    found = found[np.lexsort((found["p"], found["d"], found["c"], found["h"]))]
    same = (found["h"][1:] == found["h"][:-1]) & (found["c"][1:] == found["c"][:-1])
    again = np.concatenate([[False], same & (found["d"][1:] == found["d"][:-1]) & (found["p"][1:] == found["p"][:-1])])
    later = np.concatenate([[False], same]) & ~again
    return found[~later & ~again], found[later]


def _by_bucket(found: np.ndarray, n: int):
    """(bucket, bytes) of anchors, dealt by digit."""
    bucket = (found["h"] >> np.uint64(20)) % np.uint64(n)
    order = np.argsort(bucket, kind="stable")
    found, bucket = found[order], bucket[order]
    edge = np.searchsorted(bucket, np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edge)).tolist():
        own = found[edge[k] : edge[k + 1]]
        yield k, b"".join(own[c].tobytes() for c in ("h", "c", "d", "p"))


def _columns(payload: bytes) -> np.ndarray:
    n = len(payload) // ANCHOR_TYPE.itemsize
    out = np.empty(n, ANCHOR_TYPE)
    for k, c in enumerate(("h", "c", "d", "p")):
        out[c] = np.frombuffer(payload, ANCHOR_TYPE[c], n, k * 8 * n)
    return out


def _first_pass(docs: DataFrame, n: int) -> DataFrame:
    """Rows (kind, bucket, payload): anchors by bucket (kind 0), spans that are covered within a batch (kind 1)."""

    def run(batches):
        powers, table = Powers(), byte_table(1)
        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = column_bytes(batch.column(1))
            parts = []
            for i, j in blocks(offsets, BLOCK):
                lo, hi = int(offsets[i]), int(offsets[j])
                for a in range(0, max(hi - lo, 1), SEGMENT) if hi - lo > 2 * SEGMENT and j == i + 1 else [None]:
                    s, e = (lo, hi) if a is None else (max(lo, lo + a - REACH), min(hi, lo + a + SEGMENT + WINDOW + REACH))
                    own, bounds = data[s:e], offsets[i : j + 1] - s if a is None else np.array([0, e - s])
                    place, digit, around = anchors(own, bounds, RangeHash(own, powers, table), 0 if a is None else lo + a - s, None if a is None else lo + a - s + SEGMENT)
                    x = np.empty(len(place), ANCHOR_TYPE)
                    doc = np.searchsorted(offsets, place + s, side="right") - 1
                    x["h"], x["c"], x["d"], x["p"] = digit, around, doc_ids[doc], place + s - offsets[doc]
                    parts.append(x)
            firsts, later = split_kinds(np.concatenate(parts)) if parts else (np.zeros(0, ANCHOR_TYPE),) * 2
            firsts = firsts[np.lexsort((firsts["p"], firsts["d"]))]
            rows = [(0, k, x) for k, x in _by_bucket(firsts, n)]
            if len(later):
                spans = np.empty(len(later), SPAN_TYPE)
                spans["d"], spans["a"], spans["b"] = later["d"], np.maximum(later["p"] - REACH, 0), later["p"] + WINDOW
                rows.append((1, int(later["h"][0] % np.uint64(n)), merged(spans).tobytes()))
            for k in range(0, max(len(rows), 1), 64):
                kind, bucket, payload = zip(*rows[k : k + 64]) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())], names=["kind", "bucket", "payload"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "kind int, bucket int, payload binary")


def _kinds(dealt: DataFrame, n: int) -> DataFrame:
    """Rows (bucket, covers, asks), by documents: spans covered by whole runs; places whose suffixes go on to the second pass."""

    def run(batches):
        parts, spans = [], []
        for batch in batches:
            for kind, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                (spans if kind else parts).append(np.frombuffer(payload, SPAN_TYPE) if kind else _columns(payload))
        firsts, later = split_kinds(np.concatenate(parts)) if parts else (np.zeros(0, ANCHOR_TYPE),) * 2
        own = np.empty(len(later), SPAN_TYPE)
        own["d"], own["a"], own["b"] = later["d"], np.maximum(later["p"] - REACH, 0), later["p"] + WINDOW
        covers = merged(np.concatenate([own, *spans]))
        same = firsts["h"][1:] == firsts["h"][:-1]
        several = np.zeros(len(firsts), bool)
        several[1:] |= same
        several[:-1] |= same
        asks = np.stack([firsts["d"][several], firsts["p"][several]], 1)
        to = lambda d: (mix(d.astype(np.uint64)) % np.uint64(n)).astype(np.int64)
        cover_bucket, ask_bucket = to(covers["d"]), to(asks[:, 0])
        for k in np.union1d(cover_bucket, ask_bucket).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([covers[cover_bucket == k].tobytes()], pa.binary()), pa.array([asks[ask_bucket == k].tobytes()], pa.binary())], names=["bucket", "covers", "asks"])

    return dealt.mapInArrow(run, "bucket int, covers binary, asks binary")


def _by_document(kinds: DataFrame) -> DataFrame:
    """Rows (doc_id, covers, asks), one for each document, from what the buckets have."""

    def run(batches):
        spans, asks = [np.zeros(0, SPAN_TYPE)], [np.zeros((0, 2), np.int64)]
        for batch in batches:
            spans += [np.frombuffer(x, SPAN_TYPE) for x in batch.column(1).to_pylist()]
            asks += [np.frombuffer(x, np.int64).reshape(-1, 2) for x in batch.column(2).to_pylist()]
        covers, asks = merged(np.concatenate(spans)), np.concatenate(asks)
        asks = asks[np.lexsort((asks[:, 1], asks[:, 0]))]
        ids = np.union1d(covers["d"], asks[:, 0])
        c = np.append(np.searchsorted(covers["d"], ids), len(covers))
        a = np.append(np.searchsorted(asks[:, 0], ids), len(asks))
        for k in range(0, len(ids), 5000):
            m = range(k, min(k + 5000, len(ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[k : k + 5000]), pa.array([np.stack([covers["a"][c[i] : c[i + 1]], covers["b"][c[i] : c[i + 1]]], 1).tobytes() for i in m], pa.binary()), pa.array([asks[a[i] : a[i + 1], 1].tobytes() for i in m], pa.binary())],
                names=["doc_id", "covers", "asks"],
            )

    return kinds.mapInArrow(run, "doc_id long, covers binary, asks binary")


SUFFIX_TYPE = np.dtype([("g", "<u8"), ("g2", "<u8"), ("d", "<i8"), ("p", "<i8"), ("side", "u1"), ("left", "u1"), ("right", "u1"), ("text", "u1", (2 * NEAR,))])
#: For either side of an anchor: where its longer digit begins and ends, and the bytes on either side that windows still need.
SIDES = ((0, WINDOW - NEAR, NEAR), (-(NEAR + 1), ANCHOR, REACH - NEAR - 1))


def _suffixes(data: np.ndarray, hashes: RangeHash, doc_id: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SUFFIX_TYPE rows of the anchors at these places of documents start..end."""
    out = []
    for side, (a, b, need) in enumerate(SIDES):
        lo, hi = place + a, place + b
        ok = (lo >= start) & (hi <= end)
        lo, hi, s, e = lo[ok], hi[ok], start[ok], end[ok]
        x = np.zeros(int(ok.sum()), SUFFIX_TYPE)
        with np.errstate(over="ignore"):
            x["g"] = mix(hashes(lo, hi) + np.uint64(side + 1))
        x["g2"] = word_hashes(data, lo, hi)
        x["d"], x["p"], x["side"] = doc_id[ok], place[ok] - start[ok], side
        x["left"], x["right"] = np.minimum(lo - s, need), np.minimum(e - hi, need)
        for k in range(need):
            for at, column, inside in ((lo - 1 - k, k, x["left"] > k), (hi + k, NEAR + k, x["right"] > k)):
                x["text"][inside, column] = data[at[inside]]
        out.append(x[x["left"].astype(int) + x["right"] >= need])
    return np.concatenate(out)


def _second_pass(asked: DataFrame, n: int) -> DataFrame:
    """Rows (bucket, payload) of SUFFIX_TYPE, from rows (doc_id, text, asks)."""

    def run(batches):
        powers, table = Powers(), byte_table(2)
        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            asks = batch.column(2).to_pylist()
            data, offsets = column_bytes(batch.column(1))
            parts = [np.zeros(0, SUFFIX_TYPE)]
            for i, j in blocks(offsets, BLOCK):
                places = [np.frombuffer(asks[k] or b"", np.int64) for k in range(i, j)]
                count = np.array([len(x) for x in places])
                if count.any():
                    own, base = data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i]
                    each = lambda x: np.repeat(x, count)
                    parts.append(_suffixes(own, RangeHash(own, powers, table), each(doc_ids[i:j]), np.concatenate(places) + each(base), each(base), each(offsets[i + 1 : j + 1] - offsets[i])))
            found = np.concatenate(parts)
            bucket = (found["g"] >> np.uint64(20)) % np.uint64(n)
            order = np.argsort(bucket, kind="stable")
            found, edge = found[order], np.searchsorted(bucket[order], np.arange(n + 1))
            rows = [(k, found[edge[k] : edge[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(edge)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])

    return asked.mapInArrow(run, "bucket int, payload binary")


def _same(own: np.ndarray, row: np.ndarray, k: np.ndarray, other: np.ndarray, need: int) -> np.ndarray:
    """Whether windows agree with others in both hashes of the digit, and byte by byte in the k bytes before it and the rest after it."""
    out = (own["g"][row] == own["g"][other]) & (own["g2"][row] == own["g2"][other])
    text = own["text"]
    for c in range(need):
        out &= (c >= k) | (text[row, c] == text[other, c])
        out &= (c >= need - k) | (text[row, NEAR + c] == text[other, NEAR + c])
    return out


def _by_digit(x: np.ndarray):
    """(side, rows) of SUFFIX_TYPE rows whose digit others have too, about SUFFIXES at a time; a digit's rows stay together."""
    for side in range(len(SIDES)):
        own = np.flatnonzero(x["side"] == side)
        own = own[np.argsort(x["g"][own], kind="stable")]
        g = x["g"][own]
        same = g[1:] == g[:-1]
        several = np.zeros(len(own), bool)
        several[1:] |= same
        several[:-1] |= same
        own, g = own[several], g[several]
        at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(own) else np.zeros(0, np.int64)
        at = at[np.unique(at // SUFFIXES, return_index=True)[1]].tolist()
        for a, b in zip(at, [*at[1:], len(own)]):
            yield side, x[own[a:b]]


def equal_suffixes(x: np.ndarray) -> np.ndarray:
    """SPAN_TYPE spans of all but the first of equal windows, from SUFFIX_TYPE rows."""
    out, table = [np.zeros(0, SPAN_TYPE)], byte_table(5)
    for side, own in _by_digit(x):
        a, _, need = SIDES[side]
        own = own[np.lexsort((own["p"], own["d"]))]
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.full(need + 1, 0x9E3779B97F4A7C15, np.uint64))
            sums = []
            for k in (0, NEAR):
                sums.append(np.zeros((len(own), need + 1), np.uint64))
                np.cumsum(table[own["text"][:, k : k + need]] * up[1:], axis=1, out=sums[-1][:, 1:])
            before = np.arange(need + 1)  # bytes that the window has before the digit; the rest follow it
            whole = mix(mix(sums[0]) + mix(sums[1] ^ np.uint64(0x5851F42D4C957F2D))[:, ::-1] * np.uint64(3) + mix(own["g"])[:, None] + before.astype(np.uint64) * up[0])
        valid = (before[None, :] <= own["left"][:, None]) & (need - before[None, :] <= own["right"][:, None])
        row, k = np.nonzero(valid)
        value = whole[row, k]
        order = np.argsort(value, kind="stable")
        value, row, k = value[order], row[order], k[order]
        fresh = np.concatenate([[True], value[1:] != value[:-1]])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(value)), 0))
        unlike = np.flatnonzero(~_same(own, row, k, row[first], need))
        if len(unlike):  # a group of one hash and several strings: by the strings themselves
            seen: dict[tuple, int] = {}
            for i in np.flatnonzero(np.isin(first, first[unlike])).tolist():
                r, at = own[row[i]], int(k[i])
                first[i] = seen.setdefault((int(r["g"]), int(r["g2"]), at, r["text"][:at].tobytes(), r["text"][NEAR : NEAR + need - at].tobytes()), i)
        later = (own["d"][row] != own["d"][row[first]]) | (own["p"][row] != own["p"][row[first]])
        spans = np.empty(int(later.sum()), SPAN_TYPE)
        spans["d"] = own["d"][row[later]]
        spans["a"] = own["p"][row[later]] + a - k[later]
        spans["b"] = spans["a"] + WINDOW
        out.append(spans)
    return merged(np.concatenate(out))


def _equal(dealt: DataFrame) -> DataFrame:
    def run(batches):
        parts = [np.frombuffer(p, SUFFIX_TYPE) for batch in batches for p in batch.column(1).to_pylist()]
        spans = equal_suffixes(np.concatenate(parts)) if parts else np.zeros(0, SPAN_TYPE)
        ids, at = np.unique(spans["d"], return_index=True)
        at = np.append(at, len(spans))
        for k in range(0, len(ids), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 5000]), pa.array([np.stack([spans["a"][at[i] : at[i + 1]], spans["b"][at[i] : at[i + 1]]], 1).tobytes() for i in range(k, min(k + 5000, len(ids)))], pa.binary())], names=["doc_id", "covers"])

    return dealt.mapInArrow(run, "doc_id long, covers binary")


def covers_of(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs with one more column, its name): binaries of (from, to) pairs of bytes that repeat an earlier window, or null."""
    own, key = numbered(docs) or (docs, "doc_id")
    found, covers, at = _covers(own.select(F.col(key).alias("doc_id"), "text")), fresh(own, "_covers"), fresh(own, "_of")
    found = found.select(F.col("doc_id").alias(at), F.col("covers").alias(covers))
    return own.join(found, F.col(key) == F.col(at), "left"), covers


def _covers(docs: DataFrame) -> DataFrame:
    """doc_id, covers of the documents that have any; of docs (doc_id, text) whose doc_id is never null and has one text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = BUCKETS * partitions_for(docs)
    kinds = written(_by_document(_kinds(_first_pass(docs, n).repartition(n, "bucket"), n).repartition(n, "bucket")))
    asks = kinds.filter(F.length("asks") > 0).select(F.col("doc_id").alias("ask_id"), "asks")
    asked = docs.join(asks, F.col("doc_id") == F.col("ask_id"), "left").select("doc_id", "text", "asks")
    more = _equal(_second_pass(asked, n).repartition(n, "bucket"))
    return kinds.select("doc_id", "covers").filter(F.length("covers") > 0).unionByName(more).groupBy("doc_id").agg(F.collect_list("covers").alias("covers"))


def spans_of(covers: list[bytes] | None, n: int) -> np.ndarray:
    """Maximal (from, to) runs of removed bytes of a text of n bytes."""
    if not covers:
        return np.zeros((0, 2), np.int64)
    pairs = np.frombuffer(b"".join(covers), np.int64).reshape(-1, 2)
    x = np.empty(len(pairs), SPAN_TYPE)
    x["d"], x["a"], x["b"] = 0, np.clip(pairs[:, 0], 0, n), np.clip(pairs[:, 1], 0, n)
    x = merged(x)
    return np.stack([x["a"], x["b"]], 1)


def kept(text: bytes, spans: np.ndarray) -> bytes:
    """The text without these runs."""
    edges = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def whole_characters(text: bytes, spans: np.ndarray) -> np.ndarray:
    """The runs without the bytes of characters that they cover in part."""
    out = []
    for a, b in spans.tolist():
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs of bytes, end exclusive), kept (remaining bytes) of each document."""

    def run(batches):
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            spans = [spans_of(c, len(t)) for c, t in zip(batch.column(2).to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([[{"first": a, "last": b} for a, b in s.tolist()] for s in spans], kind), pa.array([kept(t, s) for t, s in zip(texts, spans)], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    found, covers = covers_of(narrow(docs, "doc_id", "text"))
    return found.select("doc_id", "text", covers).mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<first:long,last:long>>, kept binary")


def dedup_text(docs: DataFrame) -> DataFrame:
    """docs with their columns; texts lose what repeats an earlier window (but no part of a character), and n_chars follows."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            at = {name: k for k, name in enumerate(schema.names)}
            texts, covers, out = batch.column(at["text"]).to_pylist(), batch.column(len(schema)).to_pylist(), []
            for t, c in zip(texts, covers):
                if c:
                    raw = t.encode()
                    t = kept(raw, whole_characters(raw, spans_of(c, len(raw)))).decode()
                out.append(t)
            columns = [batch.column(k) for k in range(len(schema))]
            columns[at["text"]] = pa.array(out, columns[at["text"]].type)
            if "n_chars" in at:
                columns[at["n_chars"]] = pa.array([None if t is None else len(t) for t in out], columns[at["n_chars"]].type)
            yield columns

    found, covers = covers_of(docs)
    return map_rows(found.select(*[F.col(f"`{c}`") for c in schema.names], covers), run, schema.names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ship(__name__)
