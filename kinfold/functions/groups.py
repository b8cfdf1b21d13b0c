"""Groups of rows in a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(frames: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Groups of a partition that is sorted by its first ``keys`` columns (longs),
    one at a time; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for f in frames:
        if not f.num_rows:
            continue
        columns = [f.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(f.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(change).tolist(), f.num_rows]
        if held and any(held[-1].column(i)[-1].as_py() != c[0] for i, c in enumerate(columns)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(at, at[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(f.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
