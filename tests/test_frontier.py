"""Frontier selection and its expansion against loops over each case."""

import random
import re
from collections import defaultdict

from lodestone.operators import frontier

WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "omega", "runFast"]


def terms_of(text):
    parted = re.sub("([a-z0-9])([A-Z])", r"\1 \2", text or "")
    return {w for w in re.findall("[a-z0-9]+", parted.lower()) if len(w) >= 3 and w not in frontier.IDLE}


def family(path):
    return re.sub(r"(?<=[^/])\.[^./]+$", "", path)


def spread(n, most):
    k = min(n, most)
    return {round(i * (n - 1) / max(k - 1, 1)) for i in range(k)}


def loop_select(results, terms, limit):
    scored = [(4 * len(terms & terms_of(f"{r['path']} {r['title']}")) + len(terms & terms_of(r["text"])), k, r) for k, r in enumerate(results)]
    if any(s for s, _, _ in scored):
        order = sorted(scored, key=lambda x: (-x[0], x[1]))
    else:
        at = spread(len(results), limit)
        order = [x for x in scored if x[1] in at] + [x for x in scored if x[1] not in at]
    ordered, ids = [], set()
    for s, _, r in order:
        if r["chunk_id"] not in ids:
            ids.add(r["chunk_id"])
            ordered.append((s, r))
    chosen, families = [], set()

    def take(r):
        if len(chosen) < limit and all(r["chunk_id"] != c["chunk_id"] for c in chosen):
            chosen.append(r)
            families.add(family(r["path"]))

    if ordered:
        take(ordered[0][1])
    for role in ("callers", "callees"):
        own = [r for _, r in ordered if role in r["source_kind"]]
        if own:
            take(next((r for r in own if family(r["path"]) not in families), own[0]))
    relevant = [r for s, r in ordered if s > 0]
    for r in relevant or [r for _, r in ordered]:
        if family(r["path"]) in families:
            continue
        take(r)
        if len(chosen) >= min(limit, max(3, limit - 2)):
            break
    for r in relevant + [r for _, r in ordered]:
        take(r)
    return chosen


def loop_next(chosen, done, limit):
    near, calls = [], []
    for r in chosen:
        i = r["chunk_id"]
        if ("open_neighborhood", i) not in done and i not in near:
            near.append(i)
        if r["source_kind"] in frontier.FOLLOWED and ("find_callees", i) not in done and i not in calls:
            calls.append(i)

    def sample(x, n):
        at = spread(len(x), n) if n > 0 and x else set()
        return [v for k, v in enumerate(x) if k in at]

    out = [("open_neighborhood", i) for i in sample(near, max(1, (limit + 1) // 2))]
    return (out + [("find_callees", i) for i in sample(calls, limit - len(out))])[:limit]


def loop_expand(results, terms, chunks, calls):
    by_doc, known, done, out = defaultdict(list), [dict(r) for r in results], set(), []
    for c in chunks.values():
        by_doc[c["doc_id"]].append(c)
    for turn in range(1, 4):
        actions = loop_next(loop_select(known, terms, 8), done, 8)
        found = []
        for n, (tool, i) in enumerate(actions, 1):
            done.add((tool, i))
            at = chunks[i]
            if tool == "open_neighborhood":
                got = sorted(sorted(by_doc[at["doc_id"]], key=lambda c: (abs(c["line"] - at["line"]), c["line"]))[:11], key=lambda c: c["line"])
            else:
                got = sorted((chunks[t] for t in set(calls[i])), key=lambda c: (c["path"], c["line"], c["chunk_id"]))[:12]
            out += [(turn, n, tool, i, p, c["chunk_id"]) for p, c in enumerate(got, 1)] or [(turn, n, tool, i, None, None)]
            found += [(c, tool) for c in got]
        if not found:
            break
        for c, tool in found:
            if len(known) < 96 and all(c["chunk_id"] != k["chunk_id"] for k in known):
                known.append({**c, "source_kind": "agent_terminal_callees_evidence" if tool == "find_callees" else "agent_terminal_neighborhood_evidence"})
    return out


def world(seed):
    rnd = random.Random(seed)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    chunks = {}
    for doc in range(14):
        for line in range(1, rnd.randint(2, 16)):
            i = f"{doc}:{line}"
            chunks[i] = {"chunk_id": i, "doc_id": doc, "line": line, "path": f"d{doc % 3}/f{doc % 7}.{'ch'[doc % 2]}pp", "title": say(1), "text": rnd.choice([say(4), None, ""])}
    ids, calls = sorted(chunks), defaultdict(list)
    for _ in range(70):
        calls[rnd.choice(ids)].append(rnd.choice(ids))
    kinds = ["agent_callers_evidence", "agent_callees_evidence", "lexical", "related"]
    cases = {}
    for case in range(8):
        some = [rnd.choice(ids) for _ in range(rnd.choice([1, 2, 5, 20, 40]))]
        cases[case] = ([{**chunks[i], "pos": p, "source_kind": rnd.choice(kinds)} for p, i in enumerate(some)], set(rnd.sample(["alpha", "beta", "omega", "fast"], 2)) if case % 3 else {"nothing"})
    return chunks, calls, cases


def frames(spark, chunks, calls, cases):
    results = [(case, r["pos"], r["chunk_id"], r["path"], r["title"], r["text"], r["source_kind"]) for case, (rs, _) in cases.items() for r in rs]
    return (
        spark.createDataFrame(results, "case_id long, pos int, chunk_id string, path string, title string, text string, source_kind string"),
        spark.createDataFrame([(case, sorted(t)) for case, (_, t) in cases.items()], "case_id long, terms array<string>"),
        spark.createDataFrame([tuple(c[k] for k in ("chunk_id", "doc_id", "line", "path", "title", "text")) for c in chunks.values()], "chunk_id string, doc_id long, line int, path string, title string, text string"),
        spark.createDataFrame([(i, t) for i, ts in calls.items() for t in ts], "chunk_id string, target string"),
    )


def test_selection(spark):
    chunks, calls, cases = world(4)
    results, terms, _, _ = frames(spark, chunks, calls, cases)
    for limit in (1, 2, 3, 4, 8, 30):
        got = defaultdict(list)
        for r in frontier.select_frontier(results, terms, limit).orderBy("case_id", "place").collect():
            got[r.case_id].append(r.chunk_id)
        assert got == {case: [r["chunk_id"] for r in loop_select(rs, t, limit)] for case, (rs, t) in cases.items()}, limit


def test_expansion(spark):
    chunks, calls, cases = world(9)
    results, terms, seen, edges = frames(spark, chunks, calls, cases)
    got = defaultdict(list)
    for r in frontier.expand(results, terms, seen, edges).collect():
        got[r.case_id].append(tuple(r)[1:])
    # of copies, the first is what an expansion begins from
    first = {case: [r for k, r in enumerate(rs) if all(r["chunk_id"] != p["chunk_id"] for p in rs[:k])] for case, (rs, _) in cases.items()}
    for case, (_, t) in cases.items():
        assert sorted(got[case], key=repr) == sorted(loop_expand(first[case], t, chunks, calls), key=repr), case


def test_nothing_to_expand(spark):
    results, terms, seen, edges = frames(spark, {}, {}, {})
    assert frontier.expand(results, terms, seen, edges).count() == 0
    assert frontier.select_frontier(results, terms, 3).count() == 0
