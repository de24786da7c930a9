"""Cover density against a loop over all runs of words, and which files of the index a query reads."""

import random
import re

import pytest

from lodestone.operators import fulltext

WORDS = ["ab", "cd", "ef", "gh", "x"]
QUERIES = ["ab", "ab cd", "AB ab", '"ab cd"', '"ab cd" ef', "ab or cd ef", '"cd ef" or -x gh', "ab -x", "ab -\"cd ef\"", '"ab ab" cd', "zz or ab", "zz", "-ab", "", 'or "" ab', "ab cd ef gh x"]


def chunks():
    rnd = random.Random(5)
    out = [("c0", None, None), ("c1", "", ""), ("c2", "Ab", None), ("c3", None, "Ab, CD! ef"), ("c4", "ab cd", "ab cd")]
    return out + [(f"r{k}", " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 3))), "; ".join(rnd.choice([*WORDS, "other", "new"]) for _ in range(rnd.randint(0, 25)))) for k in range(120)]


def satisfied(words, alternatives, banned_in):
    def has(item, w):
        return any(w[i : i + len(item)] == item for i in range(len(w) - len(item) + 1))

    return any(all(has(i, words) for i in need) and not any(has(i, banned_in) for i in ban) for need, ban in alternatives)


def brute(title, text, query):
    alternatives = fulltext.parse(query)
    t, x = (re.findall(r"\w+", (s or "").lower()) for s in (title, text))
    words, asked = t + x, set(fulltext._terms(alternatives))
    at = [k for k, w in enumerate(words) if w in asked]
    rank, begin, found = 0.0, 0, False
    while True:
        # the shortest end from here on, then the latest start for it
        end = next((e for e in at if e >= begin and satisfied(words[begin : e + 1], alternatives, words)), None)
        if end is None:
            return rank / (rank + 1) if found else None
        start = max(s for s in at if s <= end and satisfied(words[s : end + 1], alternatives, words))
        own = [k for k in at if start <= k <= end]
        rank += len(own) / sum(1 / (1.0 if k < len(t) else 0.4) for k in own) / (1 + (end - start) - (len(own) - 1))
        begin, found = start + 1, True


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("fts") / "index")
    fulltext.build_index(spark.createDataFrame(chunks(), "chunk_id string, title string, text string").repartition(3), folder)
    return fulltext.open_index(spark, folder)


@pytest.mark.parametrize("query", QUERIES)
def test_cover_density(index, query):
    got = {r.chunk_id: r["rank"] for r in fulltext.cover_density(index, query).collect()}
    want = {i: r for i, title, text in chunks() if fulltext.parse(query) and (r := brute(title, text, query)) is not None}
    assert set(got) == set(want)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_a_query_reads_its_buckets_only(index):
    rows = fulltext.lookup(index, ["ab", "x"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and re.search(r"PushedFilters: \[[^]]*In\(term", plan)
    assert {r.term for r in rows.collect()} == {"ab", "x"}


def test_empty_index(spark, tmp_path):
    fulltext.build_index(spark.createDataFrame([], "chunk_id string, title string, text string"), str(tmp_path / "i"))
    assert fulltext.cover_density(fulltext.open_index(spark, str(tmp_path / "i")), "ab").count() == 0
