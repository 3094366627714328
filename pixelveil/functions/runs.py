"""Runs of equal keys in sorted Arrow batches: many small runs come together, a long one is put together over batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The columns of whole runs, and where each begins; a run has equal values in the first ``keys`` columns."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        x = [y.to_numpy(zero_copy_only=False) for y in b.columns]
        if not len(x[0]):
            continue
        change = np.flatnonzero(np.logical_or.reduce([np.diff(x[i]) != 0 for i in range(keys)])) + 1
        if held and any(held[-1][i][-1] != x[i][0] for i in range(keys)):
            change = np.append(0, change)
        if not len(change):
            held.append(x)
            continue
        n, end = sum(len(h[0]) for h in held), int(change[-1])
        whole = [np.concatenate([*(h[i] for h in held), x[i][:end]]) for i in range(len(x))]
        held = [[y[end:] for y in x]]
        yield whole, np.unique(np.append(0, change[:-1] + n))
    if held:
        yield [np.concatenate([h[i] for h in held]) for i in range(len(held[0]))], np.zeros(1, np.int64)
