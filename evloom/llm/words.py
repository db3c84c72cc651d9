"""Words of whole Arrow batches as 64-bit hashes, by array operations.

A word is a run of letters, digits and marks, lower-cased, in one form of characters (unify); a comma between digits is
dropped. Chinese, Japanese and Thai characters, written without blanks, are words of their own. Hashes come from prefix sums of a polynomial,
so a word's hash needs two look-ups whatever its length.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

from .codepoints import keep, to_codepoints
from .unify import SIZE, unify_array

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(SIZE, dtype=np.uint32)
    part = np.zeros(SIZE, np.uint8)  # 1 within a word, 2 a word of its own
    part[0x3400:0x323B0] = 2
    for c in [*range(0x3400), *range(0xA000, 0xD7B0), *range(0xF900, 0x10000), *range(0x10000, 0x11000), *range(0x1D400, 0x1D800)]:
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LNM":
            part[c] = 2 if 0x3040 <= c < 0x3400 or 0xF900 <= c < 0xFB00 or 0x0E00 <= c < 0x0E80 else 1
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    part[0xA000:0xAC00] = np.where(part[0xA000:0xAC00] == 2, 1, part[0xA000:0xAC00])
    part[0xAC00:0xD7B0] = 1
    part[0xD7B0:0xF900] = 0
    part[0xFB00:0x20000] = np.where(part[0xFB00:0x20000] == 2, 0, part[0xFB00:0x20000])
    return lower, part


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE))])
        down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, INVERSE))])
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(10, int(n).bit_length()))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span values[start:end], which depends on the values and their order only."""
    up, down = powers(len(values))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(values.astype(np.uint64) + np.uint64(0x9E37)) * up[: len(values)])])
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(strings: pa.Array, unified: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, n + 1 offsets by text)."""
    if not unified:
        strings, _ = unify_array(strings)
    lower, part = _tables()
    cps, offsets = to_codepoints(strings)
    if not len(cps):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    comma = np.flatnonzero(cps == 0x2C)
    comma = comma[(comma > 0) & (comma < len(cps) - 1)]
    digit = lambda c: (c >= 48) & (c < 58)
    comma = comma[digit(cps[comma - 1]) & digit(cps[comma + 1])]
    if len(comma):
        mask = np.ones(len(cps), bool)
        mask[comma] = False
        cps, offsets = keep(cps, offsets, mask)
    kind = part[cps]
    new_row = np.zeros(len(cps) + 1, bool)
    new_row[offsets] = True
    inside = kind > 0
    before = np.concatenate([[0], kind[:-1]])
    begin = inside & ((before != 1) | (kind != 1) | new_row[:-1])
    after = np.concatenate([kind[1:], [0]])
    end = inside & ((after != 1) | (kind != 1) | new_row[1:])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    hashes = span_hashes(lower[cps], starts, ends)
    return hashes, np.searchsorted(starts, offsets)


def text_keys(hashes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """128 bits for the sequence of words of each text, as binary."""
    a = span_hashes(hashes, offsets[:-1], offsets[1:])
    b = span_hashes(mixed(hashes ^ np.uint64(0xD1B54A32D192ED03)), offsets[:-1], offsets[1:])
    raw = np.stack([a, b], 1).tobytes()
    n = len(offsets) - 1
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 16).astype(np.int32).tobytes()), pa.py_buffer(raw)])


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of k words, n + 1 offsets by text); texts of fewer words have none."""
    count = np.maximum(np.diff(offsets) - k + 1, 0)
    ends = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(ends[-1]) - np.repeat(ends[:-1], count) + np.repeat(offsets[:-1], count)
    return span_hashes(hashes, start, start + k) if len(start) else np.zeros(0, np.uint64), ends


def minhash_bands(sh: np.ndarray, offsets: np.ndarray, bands: int = 8, rows: int = 3) -> np.ndarray:
    """n x bands keys; texts without shingles have keys of no meaning."""
    n = len(offsets) - 1
    out = np.zeros((n, bands), np.uint64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    random = np.random.default_rng(20240229)
    starts = offsets[:-1][full]
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(full), np.uint64(b + 1))
            for _ in range(rows):
                odd = np.uint64(random.integers(1, 1 << 63)) * np.uint64(2) + np.uint64(1)
                low = np.minimum.reduceat(((sh * odd) >> np.uint64(32)).astype(np.uint32), starts)
                key = mixed(key * BASE + low)
            out[full, b] = key
    return out
