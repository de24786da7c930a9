"""Rows that pairs of sets with many common shingles may cost."""

import numpy as np

from lodestone.llm import ngram_join


def test_pairs_that_share_many_shingles_are_made_about_once(spark):
    """100 families of six sets, each of 180 of a family's 220 shingles: any two share many of their cheapest ones."""
    rnd = np.random.default_rng(3)
    own = []
    for _ in range(100):
        common = rnd.integers(0, 2**62, 220)
        own += [np.sort(np.concatenate([rnd.choice(common, 180, False), rnd.integers(0, 2**62, 20)])).astype(np.uint64) for _ in range(6)]
    names, bits = [f"b{k}" for k in range(ngram_join.BITS)], ngram_join.bitmaps(own)
    sets = spark.createDataFrame([(k, x.tolist(), []) for k, x in enumerate(own)], "node long, shingles array<long>, wide array<long>")
    members = spark.createDataFrame([(k, k, len(x), tuple(b.tolist())) for k, (x, b) in enumerate(zip(own, bits))], f"node long, comp long, n long, bits struct<{','.join(f'{b}:long' for b in names)}>")
    pairs = [tuple(sorted(r)) for r in ngram_join.rare_pairs(members, sets, 50, 4).collect()]
    assert {(a, b) for f in range(100) for a in range(6 * f, 6 * f + 6) for b in range(a + 1, 6 * f + 6)} <= set(pairs)
    assert len(pairs) < 2 * len(set(pairs))
