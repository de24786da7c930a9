"""Branch comparison against sets of ancestors, on random histories with merges, forks and several roots."""

import random

import pytest

from lodestone.operators import commits


def history(seed, n):
    rnd = random.Random(seed)
    edges = {}
    for k in range(n):
        some = [p for p in rnd.sample(range(k), min(k, rnd.choice([0, 1, 1, 1, 1, 2, 3])))] if k else []
        if some and rnd.random() < 0.8:
            some[0] = k - 1  # mostly in line
        edges[k] = list(dict.fromkeys(some))
    return edges


def ancestors(edges, c):
    seen, todo = set(), [c]
    while todo:
        if (x := todo.pop()) not in seen:
            seen.add(x)
            todo += edges[x]
    return seen


@pytest.mark.parametrize("seed,n", [(1, 22), (3, 1)])
def test_compare(spark, seed, n):
    edges = history(seed, n)
    known = spark.createDataFrame([(k, k) for k in edges], "commit long, time long")
    parents = spark.createDataFrame([(k, i, p) for k, ps in edges.items() for i, p in enumerate(ps)], "commit long, nth int, parent long")
    canonical, own = n // 2, ancestors(edges, n // 2)
    got = {r.branch: tuple(r)[1:] for r in commits.compare(spark.createDataFrame([(f"b{k}", k) for k in edges] + [("gone", 10**6), ("also", n - 1)], "branch string, commit long"), canonical, known, parents).collect()}
    want = {}
    for k in edges:
        mine = ancestors(edges, k)
        ahead, behind, both = len(mine - own), len(own - mine), mine & own
        relation = "same_commit" if k == canonical else "unrelated" if not both else "merged" if not ahead else "ahead" if not behind else "diverged"
        want[f"b{k}"] = (k, relation, ahead, behind, max(both, default=None), not ahead)
    assert got == {**want, "also": want[f"b{n - 1}"]}


def test_rounds_follow_nesting_not_length(spark, monkeypatch):
    calls, plain = [], commits.cut
    monkeypatch.setattr(commits, "cut", lambda df: calls.append(1) or plain(df))
    n = 400
    known = spark.createDataFrame([(k, k) for k in range(n)], "commit long, time long")
    parents = spark.createDataFrame([(k, 0, k - 1) for k in range(1, n)], "commit long, nth int, parent long")
    row = commits.compare(spark.createDataFrame([("b", n - 1)], "branch string, commit long"), 100, known, parents).first()
    assert tuple(row) == ("b", n - 1, "ahead", n - 101, 0, 100, False) and len(calls) < 25


def test_empty(spark):
    none = spark.createDataFrame([], "commit long, time long")
    parents = spark.createDataFrame([], "commit long, nth int, parent long")
    assert commits.compare(spark.createDataFrame([], "branch string, commit long"), None, none, parents).count() == 0
