"""What steps in Python over Arrow batches share: files one at a time, and memory given back."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa


def release() -> None:
    """Gives memory that a worker no longer uses back to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


def rows_of(batches: Iterable[pa.RecordBatch], size: int = 1000) -> Iterator[dict]:
    """Rows as dicts, made so many at a time; for rows without large cells."""
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            yield from batch.slice(k, size).to_pylist()


def files_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, content), of which one at a time is taken out of its batch."""
    for batch in batches:
        file, content = batch["file"], batch["content"]
        for k in range(batch.num_rows):
            yield file[k].as_py(), content[k].as_py()
            release()
    release()
