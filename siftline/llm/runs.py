"""Runs of equal keys in a stream of Arrow batches whose rows are sorted by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """Column arrays of complete runs of equal first column, as many at a time as a batch completes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if held and held[0][0][0] != cols[0][0]:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        if cut:
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols], strict=True)]
            held = [[c[cut:] for c in cols]]
        else:
            held.append(cols)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def run_edges(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, int)
