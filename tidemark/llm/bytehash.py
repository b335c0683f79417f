"""Vectorised Rabin-Karp hashing of byte and word sequences inside Arrow tasks.

Everything here works on one slice of an Arrow batch (a few whole texts laid end to end) and keeps no state between
slices, so a lost task can simply be run again.  Hashes are polynomials modulo 2**64 over random 64-bit token codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = [_RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64) for _ in range(2)]
_BASES = [int(x) | 5 for x in _RNG.integers(2**62, 2**63, 2, dtype=np.uint64)]


def _is_word_byte() -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


WORD_BYTE = _is_word_byte()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mix_int(x: int) -> int:
    """`mix` of one Python integer."""
    return int(mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = (
                np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, dtype=np.uint64))))
                for x in (self.base, self.inverse)
            )


POWERS = [Powers(b) for b in _BASES]


class Rolling:
    """Prefix hashes of a token sequence: any span's hash is then two look-ups and a product."""

    def __init__(self, codes: np.ndarray, lane: int) -> None:
        powers = POWERS[lane]
        powers.grow(len(codes) + 1)
        self.down = powers.down
        self.prefix = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * powers.up[: len(codes)], out=self.prefix[1:])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.prefix[stop] - self.prefix[start]) * self.down[start]

    def every(self, length: int) -> np.ndarray:
        """Hashes of all spans of this length, by start."""
        n = len(self.prefix) - length
        return (self.prefix[length:] - self.prefix[:n]) * self.down[:n]


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column to (first row, end row, bytes, offsets): whole texts, about `limit` bytes together.

    Nulls count as empty.  A text longer than `limit` is a slice of its own and is never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes, never across texts, and each text's first word number."""
    inside = table[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] |= inside[first]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] |= inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """One 64-bit code a word."""
    return mix(Rolling(BYTE_CODES[0][data], 0).spans(starts, stops))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, in log2(width) passes."""
    done, out = 1, values
    while 2 * done <= width:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
