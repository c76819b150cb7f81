"""Rows of Arrow batches in Python, a few at a time: texts as Python's strings and dictionaries are many times their size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Fixed value: bytes of a batch that are Python rows at once, or one row.
HELD = 1 << 20


def rows_of(batch: pa.RecordBatch, most: int | None = None) -> Iterator[dict]:
    step = max(1, (most or HELD) * batch.num_rows // max(1, batch.nbytes))
    for lo in range(0, batch.num_rows, step):
        yield from batch.slice(lo, step).to_pylist()


def batches_of(rows: Iterable[dict], schema: pa.Schema, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows with a text ``item`` as batches that end when their items have ``most`` characters."""
    own, held = [], 0
    for row in rows:
        own.append(row)
        held += 64 + len(row["item"] or "")
        if held >= (most or HELD):
            yield pa.RecordBatch.from_pylist(own, schema=schema)
            own, held = [], 0
    if own:
        yield pa.RecordBatch.from_pylist(own, schema=schema)
