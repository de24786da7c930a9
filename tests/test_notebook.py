"""Ranking and grouping of the evidence notebook against loops."""

import random
import re

from lodestone.operators import notebook

SCHEMA = "case_id long, pos int, source_id string, chunk_id string, path string, title string, source_kind string, format string"


def terms(text):
    words = {w for w in re.findall(r"[^\W_]+", (text or "").lower()) if len(w) >= 3}
    return words | {w[:6] for w in words if len(w) >= 6}


def loop_rank(aspect, question, sources):
    own = {s[2]: terms(" ".join(x or "" for x in s[4:])) for s in sources}
    count = {}
    for t in own.values():
        for w in t:
            count[w] = count.get(w, 0) + 1
    common = {w for w, n in count.items() if n >= max(2, (len(own) * 3 + 4) // 5)}
    asked = terms(aspect)
    out = []
    for s in sources:
        mine = own[s[2]] - common
        a, b, c = len((asked - common) & mine), len((asked - common - set(notebook.GENERIC)) & mine), len((terms(question) - set(notebook.GENERIC)) & own[s[2]])
        score = c if not a else 0 if not b and not c else 8 * a + 4 * b + 2 * c
        if score and asked & set(notebook.CONNECTING) and re.search(notebook.CONNECTED, s[6] or ""):
            score += 10
        out.append((-score, s[1], s[2]))
    return [(i, -n) for n, _, i in sorted(out)]


def loop_sections(facets, question, sources):
    at = {}
    for s in sorted(sources, key=lambda s: (s[1], s[2])):
        at.setdefault(s[3], s[2])
    made, gaps = [], []
    for nth, aspect, status, chunks in facets:
        anchors = list(dict.fromkeys(at[c] for c in chunks or [] if c in at))
        most = min(4, max(3 if terms(aspect) & set(notebook.CONNECTING) else 2, len(anchors)))
        ids = list(anchors)
        for i, score in loop_rank(aspect, question, sources):
            if score < 1 or len(ids) >= most:
                break
            if i not in ids:
                ids.append(i)
        ids = ids[:4]
        if status not in ("covered", "partial") or not ids:
            gaps.append(nth)
            continue
        overlap = [len(set(m["anchors"]) & set(anchors)) for m in made]
        best = made[overlap.index(max(overlap))] if any(overlap) else None

        def extend(section, key, more, size):
            for i in more:
                if i not in section[key] and len(section[key]) < size:
                    section[key].append(i)

        if best and set(anchors) <= set(best["anchors"]):
            best["aspects"].append(nth)
            extend(best, "sources", ids, 4)
        elif anchors and set(anchors) <= {i for m in made for i in m["anchors"]}:
            for m in made:
                if set(m["anchors"]) & set(anchors):
                    m["aspects"].append(nth)
        elif len(made) < 4:
            made.append({"anchors": anchors, "sources": ids, "aspects": [nth]})
        elif best:
            best["aspects"].append(nth)
            extend(best, "sources", ids, 4)
            extend(best, "anchors", anchors, 99)
        else:
            gaps.append(nth)
    return [(k + 1, m["aspects"], m["sources"]) for k, m in enumerate(made)] + ([(0, gaps, [])] if gaps else [])


def test_notebook(spark):
    rnd = random.Random(8)
    words = ["particle", "domain", "solver", "configure", "advance", "flow", "mesh", "step", "integration", "of"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    facets, sources, questions = [], [], []
    for case in range(40):
        questions.append((case, rnd.choice([say(4), None, ""])))
        for p in range(rnd.randint(0, 9)):
            sources.append((case, rnd.randint(0, 6), f"S{p}", f"c{rnd.randint(0, 7)}", f"src/{rnd.choice(words)}_{rnd.choice(words)}.cpp", rnd.choice([say(2), None]), rnd.choice(["agent_callers_evidence", "lexical", None]), "cpp"))
        for n in range(rnd.randint(1, 9)):
            facets.append((case, n, rnd.choice([say(3), None]), rnd.choice(["covered", "partial", "covered", "gap", None]), rnd.choice([None, [], *[[f"c{rnd.randint(0, 8)}" for _ in range(rnd.randint(1, 4))] for _ in range(5)]])))
    f = spark.createDataFrame(facets, "case_id long, nth int, aspect string, status string, chunk_ids array<string>")
    s, q = spark.createDataFrame(sources, SCHEMA), spark.createDataFrame(questions, "case_id long, question string")
    got = {}
    for r in notebook.rank_sources(f, s, q).orderBy("rank").collect():
        got.setdefault((r.case_id, r.nth), []).append((r.source_id, r.score))
    of = lambda rows, case: [r for r in rows if r[0] == case]
    assert got == {(c, n): loop_rank(a, dict(questions)[c], of(sources, c)) for c, n, a, _, _ in facets if of(sources, c)}
    found = {}
    for r in notebook.sections(notebook.facet_sources(f, s, q)).collect():
        found.setdefault(r.case_id, []).append((r.section, list(r.aspects), list(r.source_ids)))
    for case in range(40):
        want = loop_sections([x[1:] for x in of(facets, case)], dict(questions)[case], of(sources, case))
        assert sorted(found.get(case, [])) == sorted(want), case
    assert notebook.sections(notebook.facet_sources(f.limit(0), s, q)).count() == 0
