"""Vectors of an Arrow list column as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm.common import ship

#: Integers beyond this, up or down, count as it: sums of products of 512 of them, or of squares of their differences, fit 64 bits.
MOST = 1 << 26


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that hold a vector of finite components only, floor(scale * x) of these, with zeros after a shorter vector's end).

    A null vector, and one that holds a null or a number that is not finite, is left out; an empty vector stays.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)  # nulls are no numbers then
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    finite = np.isfinite(x)
    with np.errstate(over="ignore"):
        out[row, np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.clip(np.floor(np.where(finite, x, 0) * scale), -MOST, MOST).astype(np.int64)
    good = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool) & (np.bincount(row[~finite], minlength=len(sizes)) == 0)
    places = np.flatnonzero(good)
    return places, out[places]


def widened(x: np.ndarray, width: int) -> np.ndarray:
    """x with columns of zeros up to this width."""
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


ship(__name__)
