"""Appends whose arrivals could meet: no document is lost or doubled by any compaction, and small appends do merge."""

import pytest

from lodestone.llm import sharding

KINDS = "doc_id long, text string"


@pytest.fixture
def store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "UNIT_BYTES", 100)
    return sharding.ShardStore(spark, f"file://{tmp_path}/store", per_arrival=1, target_bytes=1500)


def append(spark, store, rows):
    store.append(spark.createDataFrame(rows, KINDS).repartition(2))


def contents(store):
    return sorted(((r.doc.doc_id, r.doc.text) for r in store.read().collect()), key=repr)


def whole_through_compactions(spark, store, appends):
    rows = []
    for own in appends:
        append(spark, store, own)
        rows += own
        for _ in range(3):
            assert contents(store) == sorted(rows, key=repr)
            store.compact()
    assert contents(store) == sorted(rows, key=repr)


def test_first_arrival_is_zero(spark, store):
    whole_through_compactions(spark, store, [[(0, "x" * 50)], [(k, c * n) for k, (c, n) in enumerate([("a", 2000), ("b", 50), ("c", 50), ("d", 50), ("e", 2000), ("f", 2000), ("g", 2000)])]])


def test_null_and_negative_ids(spark, store):
    whole_through_compactions(spark, store, [[(None, "same" * 20)], [(None, "same" * 20), (None, None)], [(-3, "n" * 60), (None, "same" * 20), (5, "p" * 60)], [(-70000, "m" * 60), (None, "")]])


def test_small_appends_merge(spark, store):
    for k in range(5):
        append(spark, store, [(0, f"{k}" * 50)])
    before = store.manifest.latest()["version"]
    store.compact()
    assert store.manifest.latest()["version"] == before + 1
    assert len({r.shard for r in store.read().collect()}) == 2 and len(contents(store)) == 5
    assert store.vacuum() == 4 and len(contents(store)) == 5  # the fifth is unread and stays
    assert store.vacuum() == 0


def test_numbers_go_on_across_chunks(spark, store, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 4)
    whole_through_compactions(spark, store, [[(k, f"{k}" * 40) for k in range(6)], [(k, f"{k}" * 40) for k in range(3, 9)], [(2, "z" * 40)]])
