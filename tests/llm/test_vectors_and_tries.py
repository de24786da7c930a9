"""Vector codes, conversation trie and top-k search against plain loops, on nulls, ties, repeated rows, odd lengths and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import conversation_trie, topk_search, vector_codes

CLASHES = "block size low bits slices cell number home part x code error kind entry sums place rank score node n1 p1 digest own".split()


def as_query(module, frame):
    """The query's rows over this frame in place of its table."""

    class Reader:
        def parquet(self, _):
            return frame

    class Session:
        read = Reader()

    return module.query(Session(), "")


def vector_rows():
    rnd, out = random.Random(3), []
    for i in range(130):
        out.append((i * 2, [rnd.uniform(-0.5, 0.5) for _ in range(16)], rnd.choice([None, 1, 2])))
    out += [(7, out[10][1], 1), (9, out[10][1], None), (20, out[3][1], 2), (20, out[3][1], 2), (40, [0.25] * 16, 2)]  # copies and repeated ids
    out += [(301, None, 1), (303, [0.1, None] * 8, 1), (305, [0.1, math.nan] * 8, 2), (320, [math.inf] * 16, 2), (None, [0.125] * 16, None), (None, [-0.5] * 16, 1)]
    return out


SCHEMA = "vec_id long, embedding array<double>, label int"


def wide(frame):
    return frame.select("*", *[F.lit("z").alias(c) for c in CLASHES])


def finite(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * c) for c in v], label) for i, v, label in rows if finite(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    size = width // parts
    cut = [[tuple((v + [0] * width)[p * size : (p + 1) * size]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = [defaultdict(list) for _ in range(parts)]
        for c in cut:
            for p in range(parts):
                groups[p][nearest(p, c[p])[1]].append(c[p])
        books = [[tuple(sum(x[d] for x in groups[p][k]) // len(groups[p][k]) for d in range(size)) if groups[p][k] else e for k, e in enumerate(books[p])] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    found, by_label = [], defaultdict(int)
    for (i, _, label), c in zip(kept, cut):
        near = [nearest(p, c[p]) for p in range(parts)]
        found.append((i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), label))
        by_label[label] += found[-1][2]
    return sorted(((i, code, error, by_label[label], sha) for i, code, error, label in found), key=repr)


@pytest.mark.parametrize("rows", [vector_rows(), vector_rows()[:5], [(1, [0.5, -0.25, 1e9], 3), (2, [], 3), (3, [0.5], None)], [(1, None, 1)]], ids=["all", "few", "lengths", "none"])
def test_vector_codes(spark, rows):
    rows = [(i, None if v is None else [c if c is None or c < 1e8 else 100.0 for c in v], label) for i, v, label in rows]
    got = as_query(vector_codes, wide(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(rows)


def test_only_changes_are_shuffled(spark):
    """Parts that stay where they were give no line."""
    x, before = np.arange(24).reshape(3, 4, 2), np.array([[0, 1, 2, 3]] * 3)
    after = before.copy()
    after[1, 2] = 5
    changes = vector_codes.Changes(4, 16, 2)
    changes.add(x, before, after)
    assert list(changes.rows()) == [(2, 2, [-12, -13, -1]), (2, 5, [12, 13, 1])]


def brute_top(rows, most=20, every=20, scale=64):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v, _ in rows if finite(v)]
    out = []
    for k, (q, w) in enumerate(kept):
        if q is not None and q % every == 0:
            best = sorted(((-sum(a * b for a, b in zip(w, v)), i is None, i or 0, i) for j, (i, v) in enumerate(kept) if j != k))[:most]
            out += [(q, n + 1, i, -s) for n, (s, _, _, i) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [vector_rows(), vector_rows()[:12], [(0, [0.5, -0.25, 3.0], 3), (20, [], 3), (3, [0.5], None)], [(20, None, 1)]], ids=["all", "few", "lengths", "none"])
def test_topk_search(spark, rows):
    for block, group in ((16_384, 256), (17, 3)):
        got = topk_search.top_rows(wide(spark.createDataFrame(rows, SCHEMA).repartition(3)), block=block, group=group)
        assert sorted(map(tuple, got.collect()), key=repr) == brute_top(rows)


def test_bitmap_sums_equal_products():
    rng = np.random.default_rng(5)
    for n, width, high in ((1, 1, 3), (64, 5, 40), (200, 9, 1 << 20), (130, 4, 1)):
        v = rng.integers(-high, high + 1, (n, width))
        low, bits, slices = topk_search.sliced(v)
        assert (topk_search.rows_at(slices, np.arange(n)) + low[:, None] == v.T).all()
        block = topk_search.Block(n, low, bits, slices.tobytes())
        weights = rng.integers(-high, high + 1, (7, width))
        for w, (places, scores) in zip(weights, block.search(weights, None, 20)):
            truth = v @ w
            assert (truth[places] == scores).all()
            assert sorted(places.tolist()) == sorted(sorted(range(n), key=lambda k: (-truth[k], k))[:20])


def brute_trie(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = hashlib.md5((str(len(role.encode())) + ":" + role + text).encode()).digest()
            talks[c].append((turn is not None, turn or 0, order, role, text))
    talks = {c: [t[3:] for t in sorted(own)] for c, own in talks.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(talks):
        h = zlib.crc32(str(c).encode()) % 9
        new = tuple(talks.get(c - math.copysign(abs(c) % 5, c), [])[:h] + talks[c][h:])
        for d in range(len(new) + 1):
            members[new[:d]].append(c)
        ends[new].append(c)
    children = defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, own in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(own) - 1) * (len(n[-1][1].encode()) if n else 0)
    return sorted(((own[0], len(n), members[n[:-1]][0] if n else None, len(own), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, own in members.items()), key=repr)


def talk_rows():
    rnd, out = random.Random(11), []
    for c in [*range(-12, 60), 5000, 5003, 123456789012]:
        for turn in range(rnd.randint(1, 14)):
            out.append((c, turn, rnd.choice(["user", "assistant", None, ""]), rnd.choice(["same", None, "", "ünter", "x" * 50, f"own {c}"])))
    for c in range(100, 140):  # copies, and a long one that they share
        out += [(c, turn, "user", f"turn {turn}") for turn in range(30)]
    out += [(c, turn, "user", f"line {turn}") for c in (200, 201) for turn in range(700)]
    out += [(300, None, "user", "first"), (300, 0, "user", "b"), (300, 0, "user", "a"), (300, 0, "user", "a"), (None, 0, "user", "nobody"), (None, None, None, None)]
    return out


@pytest.mark.parametrize("rows", [talk_rows(), [(3, 0, "user", "x")], [(8, 0, None, None)], [(None, 0, "a", "b")]], ids=["all", "one", "null", "none"])
def test_conversation_trie(spark, rows):
    frame = wide(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    assert sorted(map(tuple, conversation_trie.trie(frame).collect()), key=repr) == brute_trie(rows)


def test_trie_rounds_are_logarithmic(spark, monkeypatch):
    calls, plain = [], conversation_trie.written
    monkeypatch.setattr(conversation_trie, "written", lambda df: calls.append(1) or plain(df))
    chain = [(d + 1, 0, d, d - 1 if d else None, 0, 0) for d in range(1000)]
    rows = [(n1, n2, d, None if p is None else p + 1, None if p is None else 0, int(d == 999), 1) for n1, n2, d, p, _, _ in chain]
    got = {r.n1: (r.leaves, r.saved) for r in conversation_trie.rolled_up(spark.createDataFrame(rows, "n1 long, n2 long, depth long, p1 long, p2 long, leaves long, saved long")).collect()}
    assert got == {d + 1: (1, 1000 - d) for d in range(1000)} and len(calls) <= 11


def test_empty_tables(spark):
    assert vector_codes.encode(spark.createDataFrame([], SCHEMA))[0].count() == 0
    assert topk_search.top_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
