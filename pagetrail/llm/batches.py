"""Arrow batches in portions of bounded text, so that long texts don't add up in a worker's memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a portion; a longer text is a portion of its own.
MOST = 1 << 24


def portions(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices whose ``columns`` hold about MOST bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        total = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + MOST, "right")))
            yield batch.slice(start, end - start)
            start = end
