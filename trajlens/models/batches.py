"""Arrow batches of window matrices as numpy arrays, inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _common_length(lists: pa.ListArray, what: str) -> int:
    """The length that all lists share; a null or a different length is an error."""
    if lists.null_count:
        raise ValueError(f"a window table holds a null {what}")
    lengths = np.diff(lists.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError(f"a {what} has {lengths.min()} entries, another {lengths.max()}: windows of unequal shape in one table")
    return int(lengths[0]) if len(lengths) else 0


def window_batch(batch: pa.RecordBatch, column: str = "X") -> np.ndarray:
    """The window column as float64 ``[n, size, features]``; no Python lists on the way.

    All windows have equally many steps and all steps equally many values; otherwise it is an error.
    """
    windows = batch.column(column)
    if len(windows) == 0:
        return np.empty((0, 0, 0))
    size = _common_length(windows, "window")
    steps = windows.flatten()
    width = _common_length(steps, "step")
    cells = steps.flatten()
    if cells.null_count:
        raise ValueError("a window table holds a null value")
    return cells.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(windows), size, width)
