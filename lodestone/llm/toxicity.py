"""Toxicity by a weighted finite-state pattern grammar over the words of a clause.

Each word is turned into a class (insult with a weight, threat, target, negation, reporting, other), each punctuation
mark into a clause's end or a quotation's opening or closing. Small transducers over these classes each mark insults and threats: the
negation transducer those among the next three words or marks, the reported-speech transducer those after a word of saying, to
the clause's end, or within a quotation (one that nothing closes holds to the clause's end), the target transducer those within
three words after a target, and its mirror, which reads from the right, those before one. `compose` makes one machine of the
first three; all but quotations that are closed start anew with each clause. What is scored is the clause: of each pattern (plain,
targeted, negated, reported; insult or threat) that a clause matches, the heaviest match counts once.

Insults and their weights are learned: words and word beginnings of 4 to 6 letters that labelled toxic texts have far more
often than others. The weights of patterns are a logistic regression. Both are fitted on at most TRAIN_ROWS labelled
documents (a fixed sample by hash of doc_id) of the rows whose crc32(doc_id as text) mod 5 is not 0.

Null and empty texts match nothing and get the score of a text without matches; repeated rows are scored each;
labels without a document, with a null or of documents with several labels count as they come; without labels the score
rests on the seed words alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, map_rows, narrow, ship

#: The classifier is fitted on so many labelled documents at most.
TRAIN_ROWS = 10_000
#: Least share of evidence (in nats) for a learned insult.
EVIDENCE = 15.0
#: Log odds, over the base rate's, from which an insult has the full weight.
CERTAIN = 4.0
THREATS = set("kill kills killed hurt beat destroy murder burn die töten umbringen schlagen vernichten sterben tuer frapper détruire mourir brûler matar golpear destruir morir quemar".split())
TARGETS = set("you your he she they them him her this these people du dich ihr euch sie er diese tu vous toi il elle ils elles ces tú usted ellos ella él estos".split())
NEGATIONS = set("not no never isn't aren't don't without nicht kein keine nie ne pas jamais sans nunca sin jamás ni".split())
REPORTS = set("said says wrote called claims quoted according sagte sagt schrieb laut dit écrit selon dijo dice escribió según".split())
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n\"„“”«»]")
MARK = re.compile("[\"„“”«»]")
KINDS = ("insult", "threat")
PATTERNS = tuple(kind + how for kind in KINDS for how in ("", "_targeted", "_negated", "_reported"))
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def quotations(text: str) -> list[int | None]:
    """For each quotation mark the number of the mark that closes it, its own if it closes one or none, None if nothing closes it."""
    out: list[int | None] = []
    open_marks: list[int] = []
    for k, found in enumerate(MARK.finditer(text)):
        mark, a, b = found[0], found.start(), found.end()
        before, after = text[a - 1 : a].strip(" \t\r\n\u00a0\u202f([{"), text[b : b + 1].strip(" \t\r\n\u00a0\u202f.,;:!?)]}")
        opens = mark == "„" or (mark != "”" and not before and (bool(after) or mark in "“«"))
        either = mark == '"' and bool(before) == bool(after)
        out.append(k)
        if open_marks and not opens:
            out[open_marks.pop()] = k
        elif opens or either:
            open_marks.append(k)
            out[k] = None
    return out


class Transducer:
    """A deterministic transducer: arcs[state, symbol] is (output, next state)."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def outputs(self) -> list[str]:
        return sorted({y for y, _ in self.arcs.values()})

    def __call__(self, symbols):
        state = self.start
        for x in symbols:
            y, state = self.arcs[state, x]
            yield y


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that gives what `second` gives for the outputs of `first`, of the states that can be reached."""
    start, arcs = (first.start, second.start), {}
    todo, seen = [start], {start}
    while todo:
        a, b = todo.pop()
        for (state, x), (y, to) in first.arcs.items():
            if state == a:
                z, over = second.arcs[b, y]
                arcs[(a, b), x] = (z, (to, over))
                if (to, over) not in seen:
                    seen.add((to, over))
                    todo.append((to, over))
    return Transducer(start, arcs)


#: Other words, insults, threats, targets, negations, reporting; a quotation's begin and end, a mark that nothing closes, a clause's end.
ALPHABET = "o i h t n r ( ) ~ .".split()
NEAR = 3


def within(alphabet: list[str], trigger: str, mark: str) -> Transducer:
    """Puts `mark` to insults and threats among the NEAR words or marks after a trigger in the clause. States: how many are left."""
    arcs = {}
    for left in range(NEAR + 1):
        for x in alphabet:
            y = x + mark if x[0] in "ih" and left else x
            arcs[left, x] = (y, 0 if x == "." else NEAR if x == trigger else max(left - 1, 0))
    return Transducer(0, arcs)


def reporting(alphabet: list[str]) -> Transducer:
    """Puts a quotation mark to insults and threats that are reported. States: (since a word of saying in the clause, in a quotation)."""
    arcs = {}
    for said in (False, True):
        for quoted in (False, True):
            for x in alphabet:
                y = x + '"' if x[0] in "ih" and (said or quoted) else x
                arcs[(said, quoted), x] = (y, (x in ("r", "~") or (said and x != "."), x == "(" or (quoted and x != ")")))
    return Transducer((False, False), arcs)


NEGATION = within(ALPHABET, "n", "!")
REPORTED = compose(NEGATION, reporting(NEGATION.outputs()))
FORWARD = compose(REPORTED, within(REPORTED.outputs(), "t", ">"))
BACKWARD = within(FORWARD.outputs(), "t", "<")
#: The pattern of an insult or threat by its marks.
PATTERN_OF = {x: 4 * (x[0] == "h") + (2 if "!" in x else 3 if '"' in x else 1 if ">" in x or "<" in x else 0) for x in BACKWARD.outputs() if x[0] in "ih"}


class Grammar:
    """Word classes, and the weights of the patterns that the composed transducers find."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: list[float], bias: float):
        self.words, self.stems, self.weights, self.bias = words, stems, weights, bias
        self.classes = {w: c for c, own in (("h", THREATS), ("r", REPORTS), ("n", NEGATIONS), ("t", TARGETS)) for w in own}

    def insult(self, word: str) -> float:
        found = self.words.get(word)
        if found is not None:
            return found
        stems = self.stems
        return max(stems.get(word[:4], 0.0), stems.get(word[:5], 0.0), stems.get(word[:6], 0.0)) if stems and len(word) > 4 else 0.0

    def symbols(self, text: str, tokens: list[str], insults: dict[str, float]) -> list[tuple[str, float]]:
        """(class, weight) of each word and mark."""
        closed_by, out, until, mark = quotations(text), [], -1, 0
        for w in tokens:
            if w in insults:
                out.append(("i", insults[w]))
            elif len(w) > 1 or w.isalpha():
                out.append((self.classes.get(w, "o"), 1.0))
            elif w in "\"„“”«»":
                end = closed_by[mark]
                if end is None:
                    out.append(("~", 0.0))
                elif mark <= until:
                    out.append((")" if mark == until else "o", 0.0))
                else:
                    out.append(("(" if end > mark else "o", 0.0))
                    until = max(until, end)
                mark += 1
            else:
                out.append(("o" if w == ":" else ".", 0.0))
        return out

    def matches(self, text: str) -> np.ndarray:
        """For each pattern, the sum over clauses of the heaviest match."""
        out, text = np.zeros(len(PATTERNS)), text.lower()
        tokens = TOKEN.findall(text)
        own = set(tokens)
        insults = {w: x for w in own if (x := self.insult(w))}
        if not insults and own.isdisjoint(THREATS):
            return out
        read = self.symbols(text, tokens, insults)
        forward = list(FORWARD(x for x, _ in read))
        clause: dict[int, float] = {}
        for y, (_, weight) in zip(BACKWARD(reversed(forward)), reversed(read)):
            if y == ".":
                for p, best in clause.items():
                    out[p] += best
                clause = {}
            elif y[0] in "ih":
                p = PATTERN_OF[y]
                clause[p] = max(clause.get(p, 0.0), weight)
        for p, best in clause.items():
            out[p] += best
        return out

    def score(self, text: str | None) -> float:
        x = np.log1p(self.matches(text)) if text else np.zeros(len(PATTERNS))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(x @ self.weights)))))


def learn(texts: list[str], toxic: list[int]) -> Grammar:
    """Fits insults, then pattern weights."""
    n = [toxic.count(0), toxic.count(1)]
    if not n[0] or not n[1]:
        return Grammar({}, {}, [1.0] * len(PATTERNS), -2.0)
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    marked: set[tuple[str, int]] = set()
    families: set[tuple[str, int]] = set()  # near copies, which have one lowest word hash, count once for a word
    for text, y in zip(texts, toxic):
        words = set(TOKEN.findall(text.lower()))
        low = min((zlib.crc32(w.encode()) for w in words), default=0)
        new = {w for w in words if len(w) > 2} | {f"{w[:k]}*" for w in words for k in (4, 5, 6) if len(w) > k}
        if (low, y) in families:
            new = {w for w in new if (w, low) not in marked}
        families.add((low, y))
        marked.update((w, low) for w in new) if y else None
        seen[y].update(new)
    rate = n[1] / (n[0] + n[1])
    found = {}
    for w, a in seen[1].items():
        b = seen[0].get(w, 0)
        if len(w) > 2 and a * (1 - rate) > 3 * b * rate and a >= 4:
            p = a / (a + b)
            if a * math.log(p / rate) + (b * math.log((1 - p) / (1 - rate)) if b else 0) > EVIDENCE and p > 0.9:
                found[w] = math.log((a + 0.5) / (b + 0.5)) - math.log(rate / (1 - rate))
    words = {w: min(v / CERTAIN, 1.0) for w, v in found.items() if w[-1] != "*"}
    stems = {w[:-1]: min(v / CERTAIN, 1.0) for w, v in found.items() if w[-1] == "*"}
    grammar = Grammar(words, stems, [1.0] * len(PATTERNS), -2.0)
    x = np.log1p(np.array([grammar.matches(t) for t in texts]))
    y, w, bias = np.array(toxic, float), np.zeros(len(PATTERNS)), math.log(rate / (1 - rate))
    design, prior = np.hstack([x, np.ones((len(x), 1))]), np.append(np.full(len(PATTERNS), 0.1), 1e-3)
    v = np.append(w, bias)
    for _ in range(40):  # Newton's method on the penalized likelihood
        p = 1 / (1 + np.exp(-np.clip(design @ v, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(prior), design.T @ (y - p) - prior * v)
        v = v + step
        v[:-1] = np.maximum(v[:-1], 0)  # no match of a pattern speaks against toxicity
        if np.abs(step).max() < 1e-6:
            break
    grammar.weights, grammar.bias = v[:-1].tolist(), float(v[-1])
    return grammar


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Grammar:
    rows = narrow(labels, "doc_id", "toxic").filter("toxic is not null").filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = F.broadcast(rows.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")))  # at most `most` rows
    sample = narrow(docs, "doc_id", "text").join(own, F.col("doc_id") == F.col("_id")).filter("text is not null").select("doc_id", "text", "toxic")
    texts, toxic = [], []
    for batch in sample.orderBy("doc_id").toArrow().to_batches():
        texts += batch.column(1).to_pylist()
        toxic += [int(x > 0) for x in batch.column(2).to_pylist()]
    return learn(texts, toxic)


def score_documents(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """SCHEMA for each document."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((grammar.words, grammar.stems, grammar.weights, grammar.bias))

    def run(batches):
        own = Grammar(*sent.value)
        for batch in batches:
            score = np.array([own.score(t) for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return narrow(docs, "doc_id", "text").withColumn("held_out", held_out()).mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are predicted toxic."""
    bounded_batches(docs.sparkSession)
    grammar, schema = train(docs, labels), docs.schema
    sent = docs.sparkSession.sparkContext.broadcast((grammar.words, grammar.stems, grammar.weights, grammar.bias))
    at = schema.names.index("text")

    def run(batches):
        own = Grammar(*sent.value)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_())).columns

    return map_rows(docs, run, schema.names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


ship(__name__)
