"""Best-fit packing: bounded-space online best-fit over a stream of tokenized documents.

Each task reads its part of the documents once, tokenizes it and packs it while it reads; no row is
moved between tasks. A fixed number of sequences is open at a time, in a bitset keyed by their free
space: the lowest set bit at or above a piece's length is the best fit, the lowest of all is the
fullest sequence, which closes first. A task's sequences left open at its end are its only loss, so the
loss is a number of sequences per task, and falls with the size of a task's part.

Null and empty texts are one piece of one token (the end mark); repeated rows are packed as often as they
occur; a null doc_id stays null; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import blocks, bounded_batches, column_bytes, lower_table, narrow, ship, space_words, word_hashes

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Tokens of a sequence; id that ends a document; open sequences of a task; distinct words that a task remembers.
CAPACITY, END_ID, OPEN, REMEMBERED = 4096, 1, 1024, 400_000


class Bins:
    """The open sequences of a task: a bit for each free space, and the sequences that have it."""

    def __init__(self, capacity: int, most: int, first: int = 0):
        self.capacity, self.most, self.next = capacity, most, first
        self.bits, self.open, self.by_free = 0, 0, [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        name = own.pop()
        if not own:
            self.bits ^= 1 << free
        self.open -= 1
        return name

    def _put(self, name: int, free: int) -> None:
        if not free:
            return
        if not self.by_free[free]:
            self.bits |= 1 << free
        self.by_free[free].append(name)
        self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of this length."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            name = self._take(free)
        else:
            name, free = self.next, self.capacity
            self.next += 1
        self._put(name, free - length)
        while self.open > self.most:  # the fullest closes first
            self._take((self.bits & -self.bits).bit_length() - 1)
        return name, self.capacity - free


class Merges:
    """Byte-pair merging of many words at once: each round merges every word's pair of the lowest rank.

    A pair that holds a merged symbol has a higher rank than the merge that made the symbol, so all places of
    a word's lowest pair can be merged in one round, from left to right.
    """

    def __init__(self, model: dict):
        vocabulary = model["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.inner = np.array([vocabulary[char[b]] for b in range(256)], np.int64)
        self.final = np.array([vocabulary[char[b] + "</w>"] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocabulary[a] << 17 | vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made, self.none = keys[order], order.astype(np.int64), made[order], len(keys)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 17 | b
        at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def __call__(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of words that are laid end to end in data; none is empty."""
        last = np.cumsum(lengths) - 1
        symbols = self.inner[data]
        symbols[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(lengths)), lengths)
        made_by_rank = np.empty(self.none, np.int64)
        made_by_rank[self.rank] = self.made
        out_ids, out_words = [], []
        ranks = np.full(len(symbols), self.none)  # of the pair that starts here
        pair = np.flatnonzero(word[1:] == word[:-1])
        ranks[pair] = self._ranks(symbols[pair], symbols[pair + 1])
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(ranks, first)
            size = np.diff(np.append(first, len(symbols)))
            each = np.repeat(least, size)
            done = each == self.none
            if done.any():
                out_ids.append(symbols[done])
                out_words.append(word[done])
                keep = ~done
                symbols, word, ranks, each = symbols[keep], word[keep], ranks[keep], each[keep]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == each)
            near = np.concatenate([[False], np.diff(hit) == 1])
            if near.any():  # overlapping places of one pair: every second, from the left
                run = np.arange(len(hit)) - np.maximum.accumulate(np.where(near, 0, np.arange(len(hit))))
                hit = hit[run % 2 == 0]
            symbols[hit] = made_by_rank[each[hit]]
            gone = np.zeros(len(symbols), bool)
            gone[hit + 1] = True
            place = np.cumsum(~gone) - 1
            symbols, word, ranks = symbols[~gone], word[~gone], ranks[~gone]
            changed = np.zeros(len(symbols) + 1, bool)  # the last: what lies before the first symbol
            changed[place[hit]] = changed[place[hit] - 1] = True
            anew = np.flatnonzero(changed[:-1])
            ranks[anew] = self.none
            anew = anew[anew + 1 < len(symbols)]
            anew = anew[word[anew] == word[anew + 1]]
            ranks[anew] = self._ranks(symbols[anew], symbols[anew + 1])
        ids, word = np.concatenate(out_ids), np.concatenate(out_words)
        return ids[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(lengths))


class WordIds:
    """Token ids of texts, by the units that the vocabulary's splitter never joins, each worked out once.

    A chunk between white space falls into runs of letters, single digits and runs of other characters.
    Chunks in which that is not sure (an apostrophe, a control string, characters past ASCII that are no
    letters) go to the tokenizer whole.
    """

    def __init__(self, tokenizer_json: str, remembered: int = REMEMBERED):
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.remembered, self.merges = Tokenizer.from_str(tokenizer_json), remembered, Merges(json.loads(tokenizer_json)["model"])
        self.lower, self.is_word = lower_table(), space_words()
        self.kind = np.full(256, 3, np.uint8)
        self.kind[~self.is_word] = 0
        self.kind[0x61:0x7B] = self.kind[0x80:] = 1
        self.kind[0x30:0x3A] = 2
        self.whole: dict[bytes, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.at, self.lengths, self.unsure = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _learn(self, hashes: np.ndarray, words: list[bytes], high: np.ndarray) -> None:
        import unicodedata

        unsure = np.zeros(len(words), bool)
        for k in np.flatnonzero(high).tolist():
            text = unicodedata.normalize("NFC", words[k].decode("utf-8", "replace"))
            text = "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()
            unsure[k], words[k] = not text.isalpha(), text.encode()
        flat, lengths = self.merges(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))
        slots = np.arange(len(words)) + len(self.at)
        self.at = np.concatenate([self.at, np.cumsum(lengths) - lengths + len(self.flat)])
        self.flat, self.lengths, self.unsure = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths]), np.concatenate([self.unsure, unsure])
        hashes, slots = np.concatenate([self.hashes, hashes]), np.concatenate([self.slots, slots])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.slots = hashes[order], slots[order]

    def _units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, number of its chunk) of the units."""
        kind, fresh = self.kind[data], np.zeros(len(data) + 1, bool)
        fresh[bounds] = True
        cut = fresh[:-1].copy()
        cut[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        chunk = fresh[:-1].copy()
        chunk[1:] |= kind[:-1] == 0
        chunk[0], cut[0] = True, True
        chunk &= kind != 0
        at = np.flatnonzero(cut)
        ends = np.append(at[1:], len(data))
        own = kind[at] != 0
        return at[own], ends[own], (np.cumsum(chunk) - 1)[at[own]]

    def block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of a block of documents, each ended by END_ID."""
        n, data = len(bounds) - 1, self.lower[data]
        starts, ends, chunk = self._units(data, bounds) if len(data) else (np.zeros(0, np.int64),) * 3
        if not len(starts):
            return np.full(n, END_ID, np.uint32), np.arange(n + 1)
        raw = data.tobytes()
        unique, first, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) + len(unique) > self.remembered:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, unique), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[at] != unique) if len(self.hashes) else np.arange(len(unique))
        if len(new):
            sums = np.concatenate([[0], np.cumsum(data >= 0x80)])
            s, e = starts[first[new]], ends[first[new]]
            self._learn(unique[new], [raw[a:b] for a, b in zip(s.tolist(), e.tolist())], sums[e] > sums[s])
        slots = self.slots[np.searchsorted(self.hashes, unique)][inverse]
        lengths, source, flat = self.lengths[slots], self.at[slots], self.flat
        odd = np.flatnonzero((data == 0x27) | np.append((data[:-1] == 0x3C) & (data[1:] == 0x7C), False))
        odd = np.unique(np.concatenate([chunk[self.unsure[slots]], chunk[np.searchsorted(starts, odd, side="right") - 1]]))
        if len(odd):
            lo, hi = np.searchsorted(chunk, odd), np.searchsorted(chunk, odd, side="right")
            found = [self._whole(raw[starts[a] : ends[b - 1]]) for a, b in zip(lo.tolist(), hi.tolist())]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            keep = ~np.isin(chunk, odd)
            keep[lo] = True
            lengths, source = lengths.copy(), source.copy()
            lengths[lo], source[lo] = sizes, len(flat) + np.cumsum(sizes) - sizes
            flat = np.concatenate([flat, *found])
            starts, lengths, source = starts[keep], lengths[keep], source[keep]
        doc = np.searchsorted(bounds, starts, side="right") - 1
        own = np.bincount(doc, weights=lengths, minlength=n).astype(np.int64) + 1
        ends_at = np.cumsum(own)
        before = np.cumsum(lengths) - lengths
        ids = np.full(int(ends_at[-1]), END_ID, np.uint32)
        step = np.arange(int(lengths.sum()))
        ids[np.repeat(doc, lengths) + step] = flat[np.repeat(source - before, lengths) + step]  # an end mark after each earlier document
        return ids, np.concatenate([[0], ends_at])

    def _whole(self, chunk: bytes) -> np.ndarray:
        if chunk not in self.whole:
            if len(self.whole) >= self.remembered // 4:
                self.whole.clear()
            self.whole[chunk] = np.array(self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return self.whole[chunk]


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, open_bins: int = OPEN) -> DataFrame:
    """Rows of SCHEMA: the pieces of docs (doc_id, text) and their places in sequences of at most `capacity` tokens."""
    spark = docs.sparkSession
    bounded_batches(spark)
    vocabulary = spark.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, bins = WordIds(vocabulary.value), Bins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            data, offsets = column_bytes(batch.column(1))
            rows = []
            for i, j in blocks(offsets):
                ids, at = words.block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = at.tolist()
                for k in range(j - i):
                    for piece, s in enumerate(range(at[k], at[k + 1], capacity)):
                        own = ids[s : min(s + capacity, at[k + 1])]
                        rows.append((doc_ids[i + k], piece, s - at[k], len(own), zlib.crc32(own.tobytes()), *bins.place(len(own))))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 5))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return narrow(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def tokenizer_file() -> str:
    """The content of the vocabulary that the contract names: 1.7 MB, a fixed file."""
    import public_tokenizers
    from pathlib import Path

    return Path(public_tokenizers.path("word_bpe_49k.json")).read_text()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())


ship(__name__)
