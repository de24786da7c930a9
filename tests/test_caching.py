"""Parses and vectors that are made once: what is reused, what a broken run leaves, what repeats."""

import os

import numpy as np
import pytest

from lodestone.operators import caching
from lodestone.sources.store import Store

DOCS = [("sha256:aa1", "md", "# T\n\ntwo words\n"), ("sha256:aa1", "md", "# T\n\ntwo words\n"), ("sha256:aa1", "txt", "# T\n\ntwo words\n"), ("sha256:bb2", None, None), (None, "md", "lost")]
SCHEMA = "content_hash string, format string, text string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_parse_cache(spark, store):
    calls = []

    def parse(docs):
        calls.append(sorted(tuple(r) for r in docs.select("content_hash", "format").collect()))
        return caching.parse_outline(docs)

    rows, counts = caching.parsed(store, spark.createDataFrame(DOCS[:2], SCHEMA), "1", 1, parse)
    assert tuple(counts.first()) == (1, 1, 1, 0)
    rows, counts = caching.parsed(store, spark.createDataFrame(DOCS, SCHEMA).repartition(3), "1", 2, parse)
    assert tuple(counts.first()) == (2, 3, 2, 1)
    assert calls == [[("sha256:aa1", "md")], [("sha256:aa1", "txt"), ("sha256:bb2", "unknown")]]
    assert sorted(map(tuple, rows.collect())) == [("sha256:aa1", "md", 4, 4, 1), ("sha256:aa1", "txt", 4, 4, 1), ("sha256:bb2", "unknown", 1, 0, 0)]
    assert tuple(caching.parsed(store, spark.createDataFrame(DOCS, SCHEMA), "1", 3, parse)[1].first()) == (3, 3, 0, 3)
    assert tuple(caching.parsed(store, spark.createDataFrame(DOCS, SCHEMA), "2", 4, parse)[1].first()) == (4, 3, 3, 0)  # another parser
    assert tuple(caching.parsed(store, spark.createDataFrame([], SCHEMA), "1", 5)[1].first()) == (5, 0, 0, 0)


def chunks(spark, n=40):
    import hashlib

    texts = [f"text {k} of words" for k in range(n)] + ["text 1 of words", "", None]
    return spark.createDataFrame([(hashlib.sha256((t or "").encode()).hexdigest(), t) for t in texts] + [(None, "no hash")], "chunk_hash string, text string")


def test_checkpoints_survive_a_broken_run(spark, store, tmp_path):
    seen = str(tmp_path / "seen")
    os.mkdir(seen)

    def counting(texts):
        for t in texts:
            import uuid

            open(f"{seen}/{uuid.uuid4().hex}", "w").write(t or "")
        return caching.hashed_words(texts)

    def failing(texts):
        if "text 7 of words" in texts:
            raise RuntimeError("out of memory")
        return counting(texts)

    n = chunks(spark).filter("chunk_hash is not null").select("chunk_hash").distinct().count()
    with pytest.raises(Exception, match="out of memory"):
        caching.embed(store, chunks(spark), "w", 1, checkpoint=6, encoder=failing)
    kept = store.version()  # each commit is a part's vectors
    had = store.read("vectors w").count() if kept else 0
    for f in os.listdir(seen):
        os.remove(f"{seen}/{f}")
    assert caching.embed(store, chunks(spark), "w", 2, checkpoint=6, encoder=counting)[0] == n - had == len(os.listdir(seen))
    assert caching.embed(store, chunks(spark), "w", 3, encoder=failing) == (0, 0)
    rows = store.read("vectors w").collect()
    assert len(rows) == len({r.chunk_hash for r in rows}) == n
    norms = sorted({round(float(np.linalg.norm(r.embedding)), 5) for r in rows})
    assert norms == [0.0, 1.0]  # the empty text has no words


def test_same_words_same_vector():
    a, b, c = caching.hashed_words(["One two", "two ONE!", "three"])
    assert (a == b).all() and not (a == c).all()
