"""Arrow arrays in pieces, so that what Python holds does not depend on how many long rows a batch has."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text of a piece.
MOST = 1 << 20


def pieces(array: pa.Array, most: int = MOST) -> Iterator[pa.Array]:
    """Runs of rows whose texts (or lists of texts) hold about ``most`` bytes, at least one row each; then freed memory goes back to the system, as workers are reused."""
    offsets = np.frombuffer(array.buffers()[1], np.int32 if array.type not in (pa.large_string(), pa.large_binary()) and not pa.types.is_large_list(array.type) else np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    if pa.types.is_list(array.type) or pa.types.is_large_list(array.type):
        inner = array.values
        sizes = np.frombuffer(inner.buffers()[1], np.int64 if inner.type == pa.large_string() else np.int32)[inner.offset : inner.offset + len(inner) + 1] if len(inner) else np.zeros(1, np.int64)
        offsets = sizes[offsets]
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + most, "right")) - 1)
        yield array.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
