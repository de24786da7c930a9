"""Memory of a worker that orders suffixes."""

import tracemalloc

import numpy as np

from lodestone.llm import suffix_dedup
from lodestone.llm.suffix_dedup import NEAR, SIDES, SUFFIX_TYPE


def suffixes(rnd, n, digits):
    x = np.zeros(n, SUFFIX_TYPE)
    x["g"] = x["g2"] = rnd.integers(0, digits, n)
    x["d"], x["p"], x["side"] = rnd.integers(0, 50, n), rnd.integers(100, 5000, n), rnd.integers(0, 2, n)
    x["left"] = x["right"] = np.array([need for _, _, need in SIDES])[x["side"]]
    x["text"] = 97
    x["text"][:, NEAR - 3 : NEAR + 3] = rnd.integers(97, 99, (n, 6))
    return x


def test_suffixes_are_ordered_in_bounded_memory(monkeypatch):
    rnd = np.random.default_rng(1)
    x, found = suffixes(rnd, 3000, 40), set()
    for most in (1, 7, 100, 10**9):
        monkeypatch.setattr(suffix_dedup, "SUFFIXES", most)
        found.add(suffix_dedup.equal_suffixes(x).tobytes())
    assert len(found) == 1 and len(found.pop()) > 1000
    monkeypatch.undo()
    x = suffixes(rnd, 120_000, 60_000)
    tracemalloc.start()
    suffix_dedup.equal_suffixes(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6, peak
