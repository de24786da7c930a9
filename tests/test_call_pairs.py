"""call_candidates on names with many calls and symbols: dealt out in cells, and never shuffled as pairs."""

import random

from lodestone.operators import code


def ladder(call, symbols):
    """What a call (target, leaf) may mean, by a plain loop."""
    target, leaf = call
    found = [s for s in symbols if s[1].split("::")[-1].lower() == leaf]
    exact = [s for s in found if "::" in target and s[1].lower().endswith(target.lower())]
    words = lambda x: {w for w in x.lower().replace("->", " ").replace("::", " ").split() if len(w) > 1}
    share = lambda s: len(words(target[: -len(leaf)]) & words(s[1][: -len(leaf)])) / max(1, len(words(s[1][: -len(leaf)])))
    most = max(map(share, found), default=0)
    if exact:
        return [(*s, "exact_qualified") for s in exact]
    if len(found) == 1:
        return [(*s, "unique_name") for s in found]
    return [(*s, "receiver_hint") for s in found if share(s) == most] if most else [(*s, "branch_unique") for s in found]


def test_frequent_names_in_cells(spark, monkeypatch):
    monkeypatch.setattr(code, "CELL", 3)
    rnd = random.Random(7)
    symbols = [(d, rnd.choice(["the", "mesh::the", "grid::the", "Mesh::grid::the", "only", "mesh::of"])) for d in range(40)] + [(99, "rare")]
    calls = [(d, line, t, t.replace("->", "::").split("::")[-1].lower()) for d in range(30) for line, t in enumerate(rnd.sample(["the", "mesh->the", "obj->the", "grid::the", "of", "rare", "no", "THE"], 4))]
    rows = code.call_candidates(spark.createDataFrame(calls, "doc_id long, line int, target string, leaf string"), spark.createDataFrame(symbols, "doc_id long, qualified_name string"))
    want = sorted((d, line, t, leaf, *m) for d, line, t, leaf in calls for m in ladder((t, leaf), symbols))
    assert sorted(tuple(r) for r in rows.collect()) == want
    assert {r[-1] for r in want} == {"exact_qualified", "unique_name", "receiver_hint", "branch_unique"}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan.split("Join")[0] for x in ("Window", "Repartition", "Aggregate"))  # pairs go straight out
