"""Vectorised word and shingle hashing over Arrow string batches.

Everything works on the UTF-8 buffer of a whole batch, so the cost per document is a few
NumPy calls rather than a Python loop over its words. Hashes are 64-bit and depend only on
the bytes, never on the process, so every task and every retry computes the same values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Space and the controls from tab to carriage return separate words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240501)
#: A random value for each byte; upper-case ASCII letters share their lower-case letter's.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK_BITS = 17
_BLOCK = 1 << _BLOCK_BITS
#: Spans of more bytes than this are hashed by a digest.
LONG_SPAN = 256
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, U64), np.cumprod(np.full(n, base, U64), dtype=U64)])


_POW = _powers(_BASE, _BLOCK)
_INV = _powers(pow(_BASE, -1, 1 << 64), _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (one more than rows, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text adds up to about `most` bytes, so that scratch arrays stay small."""
    _, at = buffers(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = _SPACE[raw]
    fresh = np.empty(len(raw), bool)
    fresh[0], fresh[1:] = True, space[:-1]
    fresh[at[:-1][at[:-1] < len(raw)]] = True
    starts = np.flatnonzero(fresh & ~space)
    last = np.empty(len(raw), bool)
    last[-1], last[:-1] = True, fresh[1:]
    last[:-1] |= space[1:]
    ends = np.flatnonzero(last & ~space) + 1
    return starts, ends, np.searchsorted(at[1:], starts, "right")


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of the spans start:end, from prefix sums block by block; starts and ends must ascend."""
    table = _BYTE_LOWER if lower else _BYTE
    out_s, out_e, back = np.empty(len(starts), U64), np.empty(len(starts), U64), np.empty(len(starts), U64)
    carry, scale, unscale = 0, 1, 1
    step, unstep = int(_POW[_BLOCK]), int(_INV[_BLOCK])
    s_at = np.searchsorted(starts, np.arange(0, len(raw) + _BLOCK, _BLOCK))
    e_at = np.searchsorted(ends, np.arange(0, len(raw) + _BLOCK, _BLOCK))
    for k in range(len(s_at) - 1):
        p = k * _BLOCK
        part = raw[p : p + _BLOCK]
        sums = np.empty(len(part) + 1, U64)
        sums[0] = 0
        np.cumsum(table[part] * _POW[: len(part)], out=sums[1:])
        i, j = s_at[k], s_at[k + 1]
        here = starts[i:j] - p
        out_s[i:j] = sums[here] * U64(scale) + U64(carry)
        back[i:j] = _INV[here] * U64(unscale)
        i, j = e_at[k], e_at[k + 1]
        out_e[i:j] = sums[ends[i:j] - p] * U64(scale) + U64(carry)
        carry, scale, unscale = (carry + int(sums[-1]) * scale) & _MASK, scale * step & _MASK, unscale * unstep & _MASK
    if len(starts):
        i = e_at[-1]
        out_e[i:] = U64(carry)
    out = mix((out_e - out_s) * back + (ends - starts).astype(U64))
    # Sums modulo 2^64 have known collisions among long texts of two symbols, so long spans get a digest.
    for i in np.flatnonzero(ends - starts > LONG_SPAN):
        data = raw[starts[i] : ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(data.lower() if lower else data, digest_size=8).digest(), "little")
    return out


class prefix_sums:
    """Prefix sums of a buffer, case kept, from which any substring's hash follows."""

    def __init__(self, raw: np.ndarray):
        sums, carry, scale = np.empty(len(raw) + 1, U64), 0, 1
        sums[0] = 0
        for p in range(0, len(raw), _BLOCK):
            part = raw[p : p + _BLOCK]
            here = np.cumsum(_BYTE[part] * _POW[: len(part)], dtype=U64) * U64(scale) + U64(carry)
            sums[p + 1 : p + 1 + len(part)] = here
            carry, scale = int(here[-1]), scale * int(_POW[_BLOCK]) & _MASK
        self.sums = sums
        self.blocks = _powers(int(_INV[_BLOCK]), -(-len(raw) // _BLOCK) + 1)

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.sums[places]

    def unscale(self, places: np.ndarray) -> np.ndarray:
        return _INV[places & (_BLOCK - 1)] * self.blocks[places >> _BLOCK_BITS]


def shingles(raw: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each row, repeats included, with row bounds, and each row's word count.

    A row with some words but fewer than n has one hash, of its whole sequence.
    """
    rows = len(at) - 1
    starts, ends, row = word_bounds(raw, at)
    words = span_hashes(raw, starts, ends)
    count = np.bincount(row, minlength=rows).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    if len(words) >= n:
        h = words[: len(words) - n + 1].copy()
        for j in range(1, n):
            h *= U64(0xD6E8FEB86659FD93)
            h ^= words[j : len(words) - n + 1 + j]
        h = mix(h)
    else:
        h = np.zeros(0, U64)
    short = np.flatnonzero((count > 0) & (count < n))
    size = np.where(count >= n, count - n + 1, 0)
    size[short] = 1
    bounds = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(bounds[-1], U64)
    whole = count >= n
    take = np.repeat(first[:-1][whole] - bounds[:-1][whole], size[whole])
    put = np.ones(bounds[-1], bool)
    put[bounds[:-1][short]] = False
    at_out = np.flatnonzero(put)
    out[at_out] = h[at_out + take]
    for r in short:
        v = int(count[r])
        for w in words[first[r] : first[r + 1]]:
            v = (v * 0xD6E8FEB86659FD93 ^ int(w)) & _MASK
        out[bounds[r]] = mix(np.array([v], U64))[0]
    return out, bounds, count
