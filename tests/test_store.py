"""Loads into a store: one commit for all tables, runs that change nothing, scopes, lost and late writers."""

import pytest

from lodestone.operators import loading
from lodestone.sources.store import Store

DOCS = [(1, "r1", "a"), (2, "r1", None), (3, "r2", "c")]
LINES = [(1, 1, "r1"), (1, 2, "r1"), (3, 1, "r2")]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def tables(spark, docs=DOCS, lines=LINES):
    return {"documents": (spark.createDataFrame(docs, "id long, repository_id string, text string"), ["id"]), "lines": (spark.createDataFrame(lines, "id long, line long, repository_id string"), ["id", "line"])}


def counts(result):
    return sorted(map(tuple, result.select("scope", "name", "reused", "inserted", "updated", "unchanged", "deleted").collect()))


def rows(store, name, version=None):
    return sorted((tuple(r) for r in store.read(name, version).select("id", "first_run", "updated_run").collect()))


def test_loads(spark, store):
    assert store.version() == 0 and store.read("documents") is None
    first = counts(loading.load(store, 1, tables(spark)))
    assert first == [("r1", "documents", False, 2, 0, 0, 0), ("r1", "lines", False, 2, 0, 0, 0), ("r2", "documents", False, 1, 0, 0, 0), ("r2", "lines", False, 1, 0, 0, 0)]
    again = counts(loading.load(store, 2, tables(spark, DOCS[::-1], LINES[::-1])))
    assert again == [("r1", "documents", True, 0, 0, 2, 0), ("r1", "lines", True, 0, 0, 2, 0), ("r2", "documents", True, 0, 0, 1, 0), ("r2", "lines", True, 0, 0, 1, 0)]
    assert store.version() == 1  # nothing to commit
    third = counts(loading.load(store, 3, tables(spark, [(1, "r1", "new"), (5, "r1", "e")], [(1, 1, "r1")])))
    assert third == [("r1", "documents", False, 1, 1, 0, 1), ("r1", "lines", False, 0, 0, 1, 1)]
    assert rows(store, "documents") == [(1, 1, 3), (3, 1, 1), (5, 3, 3)]
    assert rows(store, "lines") == [(1, 1, 1), (3, 1, 1)]
    assert rows(store, "documents", 1) == [(1, 1, 1), (2, 1, 1), (3, 1, 1)]
    assert store.vacuum(2) == 0 and store.vacuum(1) == 0  # r2's rows are still in the first folders
    loading.load(store, 4, tables(spark, [(9, "r2", "z")], [(9, 1, "r2")]))
    assert store.vacuum(1) == 2 and rows(store, "documents") == [(1, 1, 3), (5, 3, 3), (9, 4, 4)]


def test_a_table_that_is_empty_now(spark, store):
    loading.load(store, 1, tables(spark))
    assert counts(loading.load(store, 2, tables(spark, DOCS[:2], [])))[1] == ("r1", "lines", False, 0, 0, 0, 2)
    assert rows(store, "lines") == [(3, 1, 1)]
    assert loading.load(store, 3, tables(spark, [], [])).count() == 0


def test_lost_and_late_writers(spark, store, monkeypatch):
    loading.load(store, 1, tables(spark))
    with monkeypatch.context() as m:
        m.setattr(Store, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            loading.load(store, 2, tables(spark, [(1, "r1", "half")], []))
    assert rows(store, "documents") == [(1, 1, 1), (2, 1, 1), (3, 1, 1)] and store.version() == 1
    live = store.live()
    assert store.commit(live, 1) == 2
    with pytest.raises(FileExistsError):
        store.commit(live, 1)
    assert store.version() == 2 and store.vacuum(2) == 2  # what the lost writer left


@pytest.mark.parametrize("docs", [[(1, "r1", "a"), (1, "r1", "b")], [(None, "r1", "a")], [(1, None, "a")]])
def test_bad_keys(spark, store, docs):
    with pytest.raises(ValueError):
        loading.load(store, 1, tables(spark, docs))
    assert store.version() == 0


def test_expected_numbers(spark, store):
    with pytest.raises(ValueError):
        loading.load(store, 1, tables(spark), expected={"documents": 4})
    loading.load(store, 1, tables(spark), expected={"documents": 3, "lines": 3})
    assert store.version() == 1


def test_digest_is_of_the_rows_whatever_their_order(spark):
    d = lambda rows: loading.digests(spark.createDataFrame(rows, "s string, a string, b string").repartition(3), "s", ["a", "b"]).first().digest
    assert d([("x", "1", "2"), ("x", None, "")]) == d([("x", None, ""), ("x", "1", "2")])
    assert len({d([("x", "1", "2")]), d([("x", "12", "")]), d([("x", "12", None)]), d([("x", None, "12")]), d([("x", "1", "2")] * 2)}) == 5
