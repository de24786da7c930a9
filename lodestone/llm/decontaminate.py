"""Benchmark decontamination with an FM-index per shard of the training text.

The phrases are the windows of 13 words of each benchmark item (or the whole item, if it is shorter). A shard
is a block of documents. Of its words, only runs in which every two neighbours are neighbours in some phrase
can hold an occurrence; the index is built over those runs: suffix array, Burrows-Wheeler transform, wavelet
matrix with ranks, and every eighth suffix position. Backward search of all phrases whose last two words occur as
neighbours, at once, gives ranges of suffixes; occurrences are located by steps to the nearest sampled suffix, and their word spans are merged.

The benchmark is sent to the workers in blocks of at most PHRASE_BYTES of text, each with a pass over the
documents; a benchmark that fits in one block, the usual case, takes one pass and no shuffle. For several blocks the
rows are numbered and written first, and the blocks' results are put together by the rows' numbers.

Null and empty texts have no words, no hits and no items; an item without words has no window; repeated rows
are judged each, as are rows of a null doc_id and texts that share one; an empty benchmark hits nothing; other columns
are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import blocks, bounded_batches, column_bytes, fresh, letter_words, lower_table, narrow, numbered, ship, word_hashes, words_of, written

WINDOW = 13
#: Benchmark text that is held by a worker at a time; sampling of suffix positions.
PHRASE_BYTES, SAMPLE = 16_000_000, 8
SCHEMA = "doc_id long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"


class Words:
    """Hashed words of blocks of texts."""

    def __init__(self):
        self.lower, self.is_word = lower_table(), letter_words()

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, document) of each word."""
        data = self.lower[data]
        starts, ends, doc = words_of(data, bounds, self.is_word)
        return word_hashes(data, starts, ends), doc


class Phrases:
    """Windows of a block of benchmark items as word numbers; 0 and 1 are kept for the index's own marks."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        data, bounds = column_bytes(pa.array([t for _, t in items], pa.large_string()))
        hashes, doc = Words()(data, bounds)
        self.vocabulary = np.unique(hashes)
        ids, at = np.searchsorted(self.vocabulary, hashes) + 2, np.searchsorted(doc, np.arange(len(items) + 1))
        seen: dict[tuple, list[str]] = {}
        for k, (item, _) in enumerate(items):
            own = ids[at[k] : at[k + 1]].tolist()
            for i in range(max(len(own) - window + 1, min(len(own), 1))):
                seen.setdefault(tuple(own[i : i + window]), []).append(str(item))
        self.lengths = np.array([len(p) for p in seen], np.int64)
        self.words = np.zeros((len(seen), window), np.int64)
        for k, p in enumerate(seen):
            self.words[k, : len(p)] = p
        self.items = [sorted(set(v)) for v in seen.values()]
        self.shortest = int(self.lengths.min()) if len(seen) else 0
        v = np.int64(len(self.vocabulary) + 2)
        pair = np.arange(window - 1)[None, :] + 1 < self.lengths[:, None]
        self.pairs = np.unique((self.words[:, :-1] * v + self.words[:, 1:])[pair])
        self.v = v
        at = np.arange(len(seen))
        last = self.words[at, np.maximum(self.lengths - 1, 0)]
        last = np.where(self.lengths > 1, self.words[at, np.maximum(self.lengths - 2, 0)] * v + last, -last)  # the last pair, or the only word
        self.by_last = np.argsort(last, kind="stable")
        self.last = last[self.by_last]

    def ending_in(self, last: np.ndarray) -> np.ndarray:
        """The phrases that end in one of these pairs (or are one of these words, given as negative numbers)."""
        lo, hi = np.searchsorted(self.last, last), np.searchsorted(self.last, last, side="right")
        count = hi - lo
        return self.by_last[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]


class WaveletMatrix:
    """Ranks in a sequence of numbers: for each bit, from the highest, how many zeros lie before a place."""

    def __init__(self, x: np.ndarray, top: int):
        self.levels = []
        for bit in range(max(top, 1).bit_length() - 1, -1, -1):
            one = (x >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - one)])
            self.levels.append((bit, zeros, zeros[-1]))
            x = np.concatenate([x[one == 0], x[one == 1]])
        self.last = x

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c is among the first i numbers."""
        lo = np.zeros_like(i)
        for bit, zeros, total in self.levels:
            one = (c >> bit) & 1 == 1
            lo, i = np.where(one, total + lo - zeros[lo], zeros[lo]), np.where(one, total + i - zeros[i], zeros[i])
        return i - lo

    def at(self, i: np.ndarray) -> np.ndarray:
        for bit, zeros, total in self.levels:
            one = zeros[i + 1] == zeros[i]
            i = np.where(one, total + i - zeros[i], zeros[i])
        return self.last[i]


class FMIndex:
    """FM-index of a sequence of numbers over 1; a 0 is put at its end."""

    def __init__(self, text: np.ndarray, top: int, sample: int = SAMPLE):
        text = np.append(text, 0)
        suffixes = self._suffixes(text)
        self.matrix = WaveletMatrix(text[suffixes - 1], top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        marked = suffixes % sample == 0
        self.marked, self.samples = np.concatenate([[0], np.cumsum(marked)]), suffixes[marked]
        self.n = len(text)

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling."""
        n, k, rank = len(text), 1, np.unique(text, return_inverse=True)[1].astype(np.int64)
        while True:
            key = rank * (n + 1)
            key[: n - k] += rank[k:] + 1
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                return order
            k *= 2
            if k >= n:
                return order

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, from, to): ranges of suffixes that begin with the phrases that occur."""
        alive, lo, hi = np.arange(len(lengths)), np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n)
        for step in range(words.shape[1]):
            now = step < lengths[alive]
            c = words[alive[now], lengths[alive[now]] - 1 - step]
            lo[now], hi[now] = self.before[c] + self.matrix.rank(c, lo[now]), self.before[c] + self.matrix.rank(c, hi[now])
            keep = lo < hi
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
            if not len(alive):
                break
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        out, todo, rows, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            found = self.marked[rows + 1] > self.marked[rows]
            out[todo[found]] = self.samples[self.marked[rows[found]]] + steps
            todo, rows, steps = todo[~found], rows[~found], steps + 1
            c = self.matrix.at(rows)
            rows = self.before[c] + self.matrix.rank(c, rows)
        return out


def occurrences(hashes: np.ndarray, doc: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, phrase) of all occurrences in a shard."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(hashes) or not phrases.shortest:
        return none
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    ids = np.where(phrases.vocabulary[at] == hashes, at + 2, 0)
    tied = np.zeros(len(ids) + 1, bool)  # word i with the word before it
    if len(phrases.pairs):
        maybe = np.flatnonzero((ids[1:] > 0) & (ids[:-1] > 0) & (doc[1:] == doc[:-1]))
        key = ids[maybe] * phrases.v + ids[maybe + 1]
        tied[maybe[phrases.pairs[np.minimum(np.searchsorted(phrases.pairs, key), len(phrases.pairs) - 1)] == key] + 1] = True
    known = ids > 0
    begin = np.flatnonzero(known & ~tied[:-1])
    end = np.flatnonzero(known & ~tied[1:]) + 1
    long = end - begin >= phrases.shortest
    begin, size = begin[long], (end - begin)[long]
    if not len(begin):
        return none
    start = np.cumsum(size + 1) - size - 1  # a 1 after each run
    place = np.repeat(begin - start, size) + (step := np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size))
    text = np.ones(int((size + 1).sum()), np.int64)
    text[step] = ids[place]
    word = np.zeros(len(text) + 1, np.int64)
    word[step] = place
    index = FMIndex(text, int(phrases.v) - 1)
    inside = text[1:] > 1
    maybe = phrases.ending_in(np.unique(np.concatenate([-text[text > 1], (text[:-1] * phrases.v + text[1:])[inside & (text[:-1] > 1)]])))
    which, lo, hi = index.search(phrases.words[maybe], phrases.lengths[maybe])
    which = maybe[which]
    count = hi - lo
    rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    which = np.repeat(which, count)
    return word[index.locate(rows)], phrases.lengths[which], which


def _scan(docs: DataFrame, items: list[tuple], window: int, *more: str) -> DataFrame:
    """SCHEMA and the columns `more` (long) of each row."""
    phrases = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        known, words = Phrases(phrases.value, window), Words()
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            n_words, spans, items = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for i, j in blocks(offsets):
                hashes, doc = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n_words[i:j] = np.bincount(doc, minlength=j - i)
                first, size, which = occurrences(hashes, doc, known)
                if not len(first):
                    continue
                depth = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(depth, first, 1)
                np.add.at(depth, first + size, -1)
                hit = np.concatenate([[False], np.cumsum(depth[:-1]) > 0, [False]])
                edge = np.flatnonzero(hit[1:] != hit[:-1])
                base = np.searchsorted(doc, np.arange(j - i))
                cut = np.intersect1d(base, np.flatnonzero(hit[1:-1] & np.concatenate([[False], hit[1:-2]])))  # a span ends with its document
                begin, end = np.sort(np.concatenate([edge[::2], cut])), np.sort(np.concatenate([edge[1::2], cut]))
                for d, a, b in zip(doc[begin].tolist(), begin.tolist(), end.tolist()):
                    spans[i + d].append({"first": a - int(base[d]), "last": b - int(base[d])})
                for d, p in set(zip(doc[first].tolist(), which.tolist())):
                    items[i + d] += known.items[p]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *batch.columns[2:], pa.array(n_words), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))],
                names=["doc_id", *more, "n_words", "spans", "items"],
            )

    return narrow(docs, "doc_id", "text", *more).mapInArrow(run, SCHEMA.replace(",", "".join(f", {c} long" for c in more) + ",", 1))


def item_blocks(benchmark: DataFrame, most: int = PHRASE_BYTES):
    """The benchmark's (item_id, text), read by and by, in lists of at most `most` bytes of text or one item."""
    block, size = [], 0
    for row in narrow(benchmark, "item_id", "text").toLocalIterator():
        n = len((row[1] or "").encode())
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """A row for each document: doc_id, n_words, spans (words hit, merged, end exclusive), items, n_hit, contaminated."""
    bounded_batches(docs.sparkSession)
    parts = item_blocks(benchmark, phrase_bytes)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        found = _scan(docs, first, window)
    else:  # several blocks: put each row's spans together
        rows, found = written(narrow(docs, "doc_id", "text").withColumn("_row", F.monotonically_increasing_id())), None
        for items in chain([first, second], parts):
            one = _scan(rows, items, window, "_row")
            found = one if found is None else found.unionByName(one)
        merged = F.aggregate(
            F.array_sort(F.flatten(F.collect_list("spans"))),
            F.expr("cast(array() as array<struct<first:long,last:long>>)"),
            lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["last"] >= x["first"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["first"].alias("first"), F.greatest(F.element_at(a, -1)["last"], x["last"]).alias("last"))))).otherwise(F.concat(a, F.array(x))),
        )
        found = found.groupBy("_row", "doc_id", "n_words").agg(merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).drop("_row")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents; all others stay as they are."""
    own, key = numbered(docs) or (docs, "doc_id")
    gone = fresh(own, "_bad")
    bad = find_contamination(own.select(F.col(key).alias("doc_id"), "text"), benchmark).filter("contaminated").select(F.col("doc_id").alias(gone)).distinct()
    return own.join(bad, F.col(key) == F.col(gone), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
p as (select distinct item_id, least(len(w), 13) as k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as p from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
q as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as p from (select doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) as i from d, (select distinct k from p))),
h as (select q.doc_id, q.i, q.k, p.item_id from q join p on q.p = p.p and q.k = p.k),
n as (select doc_id, count(distinct i + j) as n_hit from (select doc_id, i, unnest(range(0, k)) as j from h) group by doc_id),
m as (select doc_id, count(*) as n_items, array_to_string(list(s order by s), ',') as s from (select distinct doc_id, cast(item_id as varchar) as s from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join n on d.doc_id = n.doc_id left join m on d.doc_id = m.doc_id
"""

ship(__name__)
