"""Token counts: linear longest-match automaton over a vocabulary trie.

Words are the runs [^\\x20\\x09-\\x0D]+ of a text with A-Z in lower case, as UTF-8. A word is cut, greedily
from its start, into the longest pieces of the vocabulary; the operator counts the pieces without building
them. The trie's failure link of a node leads to where matching goes on after the longest pieces at its start
are taken off, and `popped` has the number of those pieces, so a word costs one pass over its bytes.
The vocabulary holds every single byte, so that each word can be cut.

Null and empty texts have no words and no tokens; repeated rows are counted each; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import blocks, bounded_batches, column_bytes, lower_table, narrow, ship, space_words, word_hashes, words_of

SCHEMA = "doc_id long, n_words long, n_tokens long, max_word_tokens long"
#: Distinct words whose counts a task remembers.
REMEMBERED = 400_000


def vocabulary_pieces(tokenizer_json: str, end_of_word: str = "</w>") -> list[bytes]:
    """The pieces of a byte-level vocabulary file as bytes, without end-of-word marks, with all single bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    pieces = {bytes([b]) for b in range(256)}
    for piece in json.loads(tokenizer_json)["model"]["vocab"]:
        piece = piece.removesuffix(end_of_word)
        if piece and all(c in to_byte for c in piece):
            pieces.add(bytes(to_byte[c] for c in piece))
    return sorted(pieces)


class Automaton:
    """Trie, failure links and popped counts of a set of pieces that holds all single bytes."""

    def __init__(self, pieces: list[bytes]):
        go: dict[int, int] = {}
        final, parent, symbol, level = [False], [0], [0], [[0]]
        for piece in pieces:
            node = 0
            for depth, c in enumerate(piece, 1):
                nxt = go.get(node << 8 | c)
                if nxt is None:
                    nxt = go[node << 8 | c] = len(final)
                    final.append(False)
                    parent.append(node)
                    symbol.append(c)
                    if depth == len(level):
                        level.append([])
                    level[depth].append(nxt)
                node = nxt
            final[node] = True
        self.go, self.fail, self.popped = go, [-1] * len(final), [0] * len(final)
        for nodes in level[1:]:
            for v in nodes:
                if final[v]:  # the whole string is a piece: it is popped, and matching starts anew
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                c, z, count = symbol[v], self.fail[parent[v]], self.popped[parent[v]]
                while z >= 0 and (z << 8 | c) not in go:
                    count += self.popped[z]
                    z = self.fail[z]
                self.fail[v], self.popped[v] = (go[z << 8 | c], count) if z >= 0 else (-1, 0)

    def count(self, word: bytes) -> int:
        """How many pieces the greedy longest match cuts the word into."""
        go, fail, popped = self.go, self.fail, self.popped
        node = total = 0
        for c in word:
            nxt = go.get(node << 8 | c)
            while nxt is None:
                total += popped[node]
                node = fail[node]
                nxt = go.get(node << 8 | c)
            node = nxt
        while node:
            total += popped[node]
            node = fail[node]
        return total


def count_tokens(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Rows of SCHEMA: words and greedy longest-match tokens of each document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    vocabulary = spark.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        automaton = Automaton(vocabulary_pieces(vocabulary.value))
        lower, is_word = lower_table(), space_words()
        known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            n_words, n_tokens, most = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, j in blocks(offsets):
                own, bounds = lower[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
                starts, ends, doc = words_of(own, bounds, is_word)
                if not len(starts):
                    continue
                unique, first, inverse = np.unique(word_hashes(own, starts, ends), return_index=True, return_inverse=True)
                if len(known) > REMEMBERED:
                    known, counts = known[:0], counts[:0]
                at = np.searchsorted(known, unique)
                new = np.flatnonzero(known[np.minimum(at, len(known) - 1)] != unique) if len(known) else np.arange(len(unique))
                raw = own.tobytes()
                found = np.fromiter((automaton.count(raw[s:e]) for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())), np.int64, len(new))
                known, counts = np.concatenate([known, unique[new]]), np.concatenate([counts, found])
                order = np.argsort(known)
                known, counts = known[order], counts[order]
                each = counts[np.searchsorted(known, unique)][inverse]
                n_words[i:j] = np.bincount(doc, minlength=j - i)
                n_tokens[i:j] = np.bincount(doc, weights=each, minlength=j - i)
                np.maximum.at(most[i:j], doc, each)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n_words), pa.array(n_tokens), pa.array(most)], names=["doc_id", "n_words", "n_tokens", "max_word_tokens"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.packing import tokenizer_file

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())


ship(__name__)
