"""Lists of floating-point components as integer vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Components of this size and more would lose their last digits as doubles, or overflow squares.
LARGEST = float(1 << 52)


def quantised(column: pa.Array, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, floor(scale * x) of its components) of rows whose list is not null and holds finite components alone."""
    offsets = column.offsets.to_numpy()
    flat = column.values
    bad = np.zeros(len(flat), bool) if not flat.null_count else flat.is_null().to_numpy(zero_copy_only=False)
    x = flat.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    bad = bad | ~np.isfinite(x)
    n_bad = np.concatenate(([0], np.cumsum(bad)))
    keep = column.is_valid().to_numpy(zero_copy_only=False) & (n_bad[offsets[1:]] == n_bad[offsets[:-1]])
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(scale * np.where(bad, 0.0, x))
    for i in np.flatnonzero(keep).tolist():
        v = whole[offsets[i] : offsets[i + 1]]
        if len(v) and np.abs(v).max() >= LARGEST:
            raise ValueError("a component is too large for exact integers")
        yield i, v.astype(np.int64)
