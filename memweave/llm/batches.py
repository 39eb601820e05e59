"""Arrow batches in small parts, so that a worker holds little beside a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 1000


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.slice(k, rows)
