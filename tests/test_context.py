"""Context expansion against plain loops."""

import random
import re

import pytest

from lodestone.operators import context

P = context.Policy()
SEEDS = [
    (1, "s1", "lib/mesh.cpp", "MeshBuilder", "uses MeshBuilderFactory and GhostCellExchange", 1, 9), (2, "s2", "lib/grid.hpp", "Grid", "x", 10, 20), (3, "s3", "lib/grid.hpp", "Grid2", "y", 40, 50),
    (4, "s4", "cfg/run/a.json", "a", "z", 1, 2), (5, "s5", "cfg/run/deep/b.yaml", "b", "z", 1, 2), (6, "s6", "cfg/c.toml", "c", "notlongEnough", 1, 2), (7, "s7", "lib/mesh.hpp", "M", "w", 5, 6),
]
SCHEMA = "rank int, chunk_id string, path string, title string, text string, line_start int, line_end int"


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame(SEEDS, SCHEMA)


def test_policy_and_slots():
    assert context.slots(10, 2) == {"candidates": 100, "per_path": 10, "context": 2, "seeds": 8}
    assert context.slots(1, 30) == {"candidates": 50, "per_path": 30, "context": 0, "seeds": 1}
    with pytest.raises(ValueError):
        context.Policy(results=11)


def test_hints(seeds):
    assert {tuple(r) for r in context.path_hints(seeds).collect()} == {
        ("lib/grid.hpp", "same_document", 2, 6), ("lib/grid.cpp", "paired_source", 2, 5), ("lib/grid.cc", "paired_source", 2, 5), ("lib/grid.cxx", "paired_source", 2, 5),
        ("lib/mesh.h", "paired_source", 1, 5), ("lib/mesh.cc", "paired_source", 7, 5), ("lib/mesh.cxx", "paired_source", 7, 5),
    }
    assert [tuple(r) for r in context.directory_hints(seeds).collect()] == [("cfg/run", 4, 7)]
    assert [tuple(r) for r in context.symbol_hints(seeds).collect()] == [("MeshBuilderFactory", 1), ("GhostCellExchange", 1), ("MeshBuilder", 1)]
    assert context.path_hints(seeds.limit(0)).count() == context.directory_hints(seeds.limit(0)).count() == context.symbol_hints(seeds.limit(0)).count() == 0


def test_complements_and_their_places(spark, seeds):
    rnd = random.Random(5)
    chunks = [("s2", "lib/grid.hpp", "public", "t", "x", "h0", 10, 20, 0.9)]
    for k in range(200):
        path = rnd.choice(["lib/grid.hpp", "lib/grid.cpp", "lib/mesh.h", "cfg/run/x.json", "cfg/runner.json", "doc/a.md", "doc/b.md", "cfg/run/deep/y.md"])
        chunks.append((f"c{k:03}", path, rnd.choice(["public", "lab", "pending", "project"]), rnd.choice(["t", "on meshbuilderfactory", "GHOSTCELLEXCHANGE"]), "text", f"h{rnd.randint(0, 60)}", (at := rnd.randint(1, 90)), at + 5, rnd.randint(0, 100) / 100))
    frame = spark.createDataFrame(chunks, "chunk_id string, path string, access_class string, title string, text string, chunk_hash string, line_start int, line_end int, score double")
    paths = {r.path: (r.reason, r.rank, r.strength) for r in context.path_hints(seeds).collect()}
    symbols = {r.symbol.lower(): r.rank for r in context.symbol_hints(seeds).collect()}
    want = []
    for i, path, access, title, text, h, a, b, score in chunks:
        if access not in ("public", "lab") or i == "s2":
            continue
        distance = context.FAR
        if path in paths:
            (reason, rank, strength), group = paths[path], path
            if reason == "same_document":
                distance = min(max(0, s[5] - b, a - s[6]) for s in SEEDS if s[2] == path)
        elif path.startswith("cfg/run/"):
            reason, rank, strength, group = "directory_bundle", 4, 7, "cfg/run"
        elif met := sorted((r, s) for s, r in symbols.items() if s in f"{title}\n{text}".lower()):
            reason, strength, (rank, group) = "symbol_reference", 4, met[0]
        else:
            continue
        want.append((-strength, rank, distance, -score, i, path, h, reason, f"{reason}:{group}"))
    found = context.complements(frame, seeds)
    assert sorted((-r.strength, r.source_rank, r.distance, -r.score, r.chunk_id, r.path, r.chunk_hash, r.reason, r.group) for r in found.collect()) == sorted(want)
    kept = []
    for x in sorted(want)[: P.candidates]:
        if len(kept) < 5 and not any(x[8] == y[8] or x[5] == y[5] or x[6] == y[6] for y in kept):
            kept.append(x)
    wide = context.Policy(results=5)
    chosen = context.select_complements(found, wide)
    assert [(r.chunk_id, r.source_rank) for r in chosen.orderBy("context_rank").collect()] == [(x[4], x[1]) for x in kept]
    baseline = spark.createDataFrame([(s[0], s[1], s[2], f"g{s[0] % 6}", 1 / (60 + s[0])) for s in SEEDS], "rank int, chunk_id string, path string, chunk_hash string, score double")
    out, after = [], {}
    for x in kept:
        after.setdefault(x[1], []).append(x)
    for s in SEEDS:
        for step, (i, path, h) in enumerate([(s[1], s[2], f"g{s[0] % 6}"), *((x[4], x[5], x[6]) for x in after.get(s[0], []))]):
            if len(out) < 9 and sum(o[1] == path for o in out) < 2 and all(o[2] != h for o in out):
                out.append((i, path, h, 1 / (60 + s[0]) - step * 1e-6))
    got = context.interleave(baseline, chosen, 9, 2).orderBy("pos").collect()
    assert [(r.chunk_id, r.path) for r in got] == [o[:2] for o in out]
    assert all(abs(r.score - o[3]) < 1e-12 for r, o in zip(got, out))
    assert re.match("s1", got[0].chunk_id)
