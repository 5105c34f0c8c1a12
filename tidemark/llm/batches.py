"""Arrow batches of a bounded amount of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into Python objects at once; a single longer text is taken alone.
MOST_BYTES = 16_000_000


def by_size(batches: Iterator[pa.RecordBatch], column: int, most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, in slices whose texts (in ``column``) have at most ``most`` bytes or that are one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        begin, held = 0, 0
        for k, size in enumerate(sizes):
            if held + size > most and k > begin:
                yield batch.slice(begin, k - begin)
                begin, held = k, 0
            held += size
        if len(sizes) > begin:
            yield batch.slice(begin)
