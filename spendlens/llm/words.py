"""Words of many texts at once: byte classes, starts and 64-bit hashes by numpy.

Texts are taken from Arrow batches in blocks of bounded bytes; a single longer
text makes a block of its own, so no text is ever cut. Hashes depend on the
bytes alone and are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_table(separators: list[tuple[int, int]], lower: bool = True):
    """(is a word's byte, value of a byte) for words of all bytes outside ``separators``."""
    word = np.ones(256, dtype=bool)
    for lo, hi in separators:
        word[lo : hi + 1] = False
    code = np.arange(256, dtype=U)
    if lower:
        code[65:91] += U(32)
    return word, mix(code + _ODD)


#: Words of digits, letters and everything beyond ASCII, A-Z in lower case.
ALNUM = byte_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Words between white space, A-Z in lower case.
SPACED = byte_table([(0x20, 0x20), (0x09, 0x0D)])

_POWERS = [np.ones(1, dtype=U), np.ones(1, dtype=U)]
_BASE = U(0xD6E8FEB86659FD93)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, dtype=U)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def hashed(data: np.ndarray, bounds: np.ndarray, table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end: row, start byte, end byte, hash (never 0).

    ``bounds`` are the texts' offsets in ``data``, one more than texts.
    """
    word, value = table
    n = len(data)
    if n == 0:
        e = np.empty(0, dtype=np.int64)
        return e, e, e, np.empty(0, dtype=U)
    mask = word[data]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    edges = bounds[(bounds > 0) & (bounds < n)]
    begins[edges] = mask[edges]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    ends[edges - 1] = mask[edges - 1]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(n + 1)
    sums = np.empty(n + 1, dtype=U)
    sums[0] = 0
    np.cumsum(value[data] * up[:n], out=sums[1:])
    h = mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(U))
    h[h == 0] = 1
    return np.searchsorted(bounds, lo, side="right") - 1, lo, hi, h


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = BLOCK_BYTES, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Cuts and joins batches to about ``most`` bytes of text and ``rows`` rows; a row stays whole."""
    waiting, held, count = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(name))
        _, bounds = texts(column)
        at = 0
        while at < batch.num_rows:
            room = int(np.searchsorted(bounds, bounds[at] + most - held, side="right")) - 1
            to = min(max(room, at + (not waiting)), at + rows - count, batch.num_rows)
            if to > at:
                waiting.append(batch.slice(at, to - at))
                held += int(bounds[to] - bounds[at])
                count += to - at
                at = to
            if at < batch.num_rows or held >= most or count >= rows:
                yield _joined(waiting)
                waiting, held, count = [], 0, 0
    if waiting:
        yield _joined(waiting)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    whole = pa.Table.from_batches(parts).combine_chunks()
    return whole.to_batches()[0]


def grams(row: np.ndarray, h: np.ndarray, n: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row, ``step`` apart, with the row each belongs to."""
    span = (n - 1) * step
    if len(h) <= span:
        return row[:0], h[:0]
    out = h[: len(h) - span]
    for k in range(1, n):
        out = mix(out * _ODD + h[k * step : len(h) - span + k * step])
    same = row[: len(row) - span] == row[span:]
    return row[: len(row) - span][same], out[same]
