"""Arrow string arrays as one flat array of Unicode code points, and back; no work per string."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once: arrays by code point take some fifty times as much memory.
AT_ONCE = 1 << 22


def to_codepoints(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points uint32 of all strings, n + 1 offsets); NULL counts as empty."""
    strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else b""
    raw = bytes(raw)
    if not raw:
        return np.zeros(0, np.uint32), np.zeros(len(strings) + 1, np.int64)
    cps = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return cps, starts[offsets - offsets[0]]


def to_strings(cps: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    raw = np.ascontiguousarray(cps, np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    width = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
    width[(cps >= 0xD800) & (cps <= 0xDFFF)] = 1
    ends = np.concatenate([[0], np.cumsum(width)])[offsets]
    mask = None
    if valid is not None and not valid.all():
        mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [mask, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.string())


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of each code point."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def keep(cps: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the code points under mask, with their new offsets."""
    return cps[mask], np.concatenate([[0], np.cumsum(mask)])[offsets]


def pieces(batches: Iterable[pa.RecordBatch], at: int, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches cut, without copying, so that column at holds at most so many bytes in each; a longer text is alone."""
    for b in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(at)), 0), np.int64))
        start = 0
        while start < b.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield b.slice(start, end - start)
            start = end
