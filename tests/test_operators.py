"""Operators that SQL does not express, against plain loops."""

import pytest

import random

from lodestone.operators import answers, chunking, search


def windows(lines, most, overlap):
    out, cur = [], 0
    while cur < len(lines):
        total, end = 0, cur
        while end < len(lines) and (end == cur or total + len(lines[end]) + 1 <= most):
            total += len(lines[end]) + 1
            end += 1
        if end < len(lines):
            blank = [k for k in range(cur, end) if not lines[k].strip()]
            end = blank[-1] + 1 if blank else end
        out.append((cur + 1, end))
        if end >= len(lines):
            break
        cur = max(cur + 1, end - overlap)
    return out


def test_chunk_windows(spark):
    rnd = random.Random(5)
    texts = ["\n".join("x" * rnd.choice([0, 5, 20, 90]) for _ in range(rnd.randint(1, 40))) for _ in range(60)] + ["a", "x" * 500 + "\nb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunking.chunk_windows(docs, 200, 5).collect():
        got.setdefault(r.doc_id, []).append((r.line_start, r.line_end))
    for i, t in enumerate(texts):
        lines = t.split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        want = [(a, b) for a, b in windows(lines, 200, 5) if "\n".join(lines[a - 1 : b]).strip()]
        assert sorted(got.get(i, [])) == want, (i, t)


def test_diversify_greedy(spark):
    rnd = random.Random(2)
    rows = [(k, f"p{rnd.randint(0, 8)}", f"h{rnd.randint(0, 20)}", f"c{k}") for k in range(200)]
    got = [r.chunk_id for r in search.diversify_greedy(spark.createDataFrame(rows, "rank int, path string, chunk_hash string, chunk_id string"), 20, 2).orderBy("pos").collect()]
    kept, paths, seen = [], {}, set()
    for _, p, h, c in rows:
        if len(kept) < 20 and paths.get(p, 0) < 2 and h not in seen:
            kept.append(c)
            seen.add(h)
            paths[p] = paths.get(p, 0) + 1
    assert got == kept


def test_pack(spark):
    sizes = [50, 900, 10, 400, 300]
    got = [r.given for r in answers.pack(spark.createDataFrame([(k, f"c{k}", n) for k, n in enumerate(sizes)], "pos int, chunk_id string, n_chars long"), 600, 40).orderBy("pos").collect()]
    left, want = 600, []
    for n in sizes:
        if left <= 0:
            break
        given = min(n, max(40, -(-left // (len(sizes) - len(want)))))
        want.append(given)
        left -= given
    assert got == want


def test_heading_sections(spark):
    docs = spark.createDataFrame([(1, "pre\n# A\nx\n### C\n## B\ny\n# D"), (2, "none"), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.line_start, r.line_end, r.title) for r in chunking.heading_sections(docs).collect())
    assert got == [(1, 1, 1, ""), (1, 2, 3, "A"), (1, 4, 4, "A / C"), (1, 5, 6, "A / B"), (1, 7, 7, "D"), (2, 1, 1, "")]


def test_normalized():
    assert answers.normalized("Où est l'Écran?") == "ou est l ecran"


def test_incremental_equals_batch(spark, tmp_path):
    from lodestone.streaming.incremental import current, index_available, merge

    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    kind = "id long, v string, ts long"
    one = spark.createDataFrame([(1, "a", 1), (2, "b", 1), *[(k, "old", 1) for k in range(10, 40)], *[(k, "new", 2) for k in range(10, 40)], (4, "none", None)], kind)
    one.coalesce(1).write.parquet(source)
    index_available(spark, source, one.schema, folder, "id", "ts")
    spark.createDataFrame([(2, "c", 2), (3, "d", 1), (10, "older", 1), (4, "some", 0)], kind).coalesce(1).write.mode("append").parquet(source)
    index_available(spark, source, one.schema, folder, "id", "ts")
    index_available(spark, source, one.schema, folder, "id", "ts")
    got = sorted((r.id, r.v) for r in current(spark, folder).collect())
    assert got == [(1, "a"), (2, "c"), (3, "d"), (4, "some"), *[(k, "new") for k in range(10, 40)]]
    with pytest.raises(ValueError):
        merge(spark, folder, one, "id", "no such column", 99)


def test_files(spark, tmp_path):
    from lodestone.sources import files

    root = tmp_path / "tree.d"
    (root / "a").mkdir(parents=True)
    (root / "a/x.txt").write_bytes("é".encode())
    (root / "y.bin").write_bytes(b"\xff\xfe")
    tree = files.file_tree(spark, f"file://{root}")
    found = {r.path: r for r in files.decoded(tree).collect()}
    assert sorted(found) == ["a/x.txt", "y.bin"] and found["a/x.txt"].text == "é"
    assert (found["a/x.txt"].encoding, found["y.bin"].encoding) == ("utf-8", "utf-8-replace")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    files.write_json_lines(rows, f"{tmp_path}/j")
    assert sorted(map(tuple, files.read_json_lines(spark, f"{tmp_path}/j", rows.schema).collect())) == [(1, "a"), (2, None)]
    (tmp_path / "bad.json").write_text('{"id": "x"}\n')
    with pytest.raises(Exception):
        files.read_json_lines(spark, f"{tmp_path}/bad.json", rows.schema).collect()


@pytest.mark.parametrize("name", ["knn_cosine", "rrf_hybrid", "callers", "callees", "related_chunks", "symbol_search", "chunk_neighborhood", "lexical_search", "full_text_search", "search_by_ids", "relation_search", "scope_filter"])
def test_no_query_returns_what_is_not_allowed(spark, name):
    from lodestone.plans.registry import QUERIES
    from lodestone.sources import corpus

    sf = "/root/testdata/sf0.01"
    classes = {r.doc_id: r.access_class for r in corpus.documents(spark, sf).select("doc_id", "access_class").collect()}
    for r in QUERIES[name](spark, sf).collect():
        ids = [r[c] for c in ("doc_id", "target_doc", "other") if c in r and r[c] not in (None, -1)] + [int(str(r["chunk_id"]).split(":")[0]) for _ in range("chunk_id" in r)]
        assert {classes[i] for i in ids} <= {"public", "lab"}


def test_investigation(spark):
    from lodestone.operators import investigation as i

    aspects = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 0, 3, "x"), (1, 1, 1, "b"), (1, 1, 2, "c"), (2, 0, 1, "x")], "case_id int, aspect int, pos int, chunk_id string")
    kept = spark.createDataFrame([(1, 1, "d"), (1, 2, "c"), (1, 3, "b"), (1, 4, "a"), (1, 5, "d"), (2, 1, "e")], "case_id int, pos int, chunk_id string")
    assert [tuple(r) for r in i.kept_priority(kept, aspects).orderBy("case_id", "place").collect()] == [(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "d", 4), (2, "e", 1)]
    steps = spark.createDataFrame([("find_callers", "o", "r"), ("open_related", "o", "o"), ("search_text", "o", "r"), ("find_callees", "", "r"), ("open_related", "o", None)], "tool string, origin string, result string")
    (edge,) = i.traversal_edges(steps).collect()
    assert (edge.source, edge.target, edge.kind, edge.directed, len(edge.edge_id)) == ("chunk:r", "chunk:o", "calls", True, 25)
    results = spark.createDataFrame([("A", None), ("A", "main"), ("B", None), ("B", "dev"), (None, "dev")], "project string, branch string")
    scopes = spark.createDataFrame([("A", None), ("A", "main"), ("B", "dev")], "project string, branch string")
    assert sorted(map(str, i.in_scope(results, scopes).collect())) == sorted(map(str, results.filter("project = 'A' or branch = 'dev' and project = 'B'").collect()))
    rows = spark.createDataFrame([("A", "supported"), ("A", "supported"), ("B", None), ("C", "uncertain")], "who string, verdict string")
    assert {r.who: r.passed for r in i.verdict_counts(rows, "who").collect()} == {"A": True, "B": False, "C": False}
    (batch,) = i.claim_batches(spark.createDataFrame([(1, 4, "x", "S1"), (1, 2, "x", "S1")], "answer_id int, p int, claim string, cited string")).collect()
    assert tuple(batch) == (1, 2, 2, 0)
    loaded = i.load_rows(spark.createDataFrame([(1, "p", None, "", "k"), (None, "p", "md", "t", None)], "doc_id int, path string, format string, title string, kind string")).collect()
    assert [tuple(r) for r in loaded] == [(1, "p", "unknown", "arquivo", "k", True), (None, "p", "md", "t", "text", False)]


def test_bounded_text_and_graph(spark):
    from pyspark.sql import functions as F

    from lodestone.functions.text import bounded
    from lodestone.operators.investigation import bounded_graph

    texts = ["", "short", "a" * 50, "ab\n" * 30, "x" * 16 + "\n" + "y" * 60 + "\n" + "z" * 3, "\n" + "q" * 70, None]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(bounded(F.col("t"), 40, "<>")).collect()]
    for t, out in zip(texts, got):
        if t is None or len(t) <= 40:
            assert out == t
            continue
        head, tail = t[:22], t[-16:]
        if "\n" in head and head.rindex("\n") >= 11:
            head = head[: head.rindex("\n")]
        if "\n" in tail and tail.index("\n") <= 8:
            tail = tail[tail.index("\n") + 1 :]
        assert out == head + "<>" + tail
    results = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "d")], "case_id int, chunk_id string")
    sources = spark.createDataFrame([(1, 1, "b")], "case_id int, pos int, chunk_id string")
    edges = spark.createDataFrame([(1, 1, "e1", "a", "b"), (1, 2, "e2", "b", "c"), (1, 2, "e1", "a", "b"), (1, 3, "e3", "c", "gone"), (1, 4, "e4", "c", "d")], "case_id int, pos int, edge_id string, source string, target string")
    nodes, kept = bounded_graph(results, sources, edges, 3, 2)
    assert [r.chunk_id for r in nodes.orderBy("place").collect()] == ["b", "a", "c"]
    assert sorted(r.edge_id for r in kept.collect()) == ["e1", "e2"]
    assert sorted(r.edge_id for r in bounded_graph(results, sources, edges, 2, 9)[1].collect()) == ["e1"]
