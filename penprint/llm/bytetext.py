"""Words and their hashes straight from Arrow's UTF-8 buffers, as numpy vectors.

Words are cut and lower-cased by byte, which is exact for the word classes used here:
both end at ASCII bytes only, and only A-Z change case. No Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 500_000

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_WORD = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; equal inputs only give equal outputs."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX2
    return h ^ (h >> np.uint64(31))


def _word_bytes(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high] = True
    return table


# Module values rather than cached calls: functions travel to workers with what they use.
_BLANK_SEPARATED = _word_bytes((0, 9), (14, 32), (33, 256))
_LETTERS_AND_DIGITS = _word_bytes((48, 58), (65, 91), (97, 123), (128, 256))
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_BYTE_VALUES[65:91] = _BYTE_VALUES[97:123]


def blank_separated() -> np.ndarray:
    """Word bytes: everything but the blank and 09-0D."""
    return _BLANK_SEPARATED


def letters_and_digits() -> np.ndarray:
    """Word bytes: ASCII digits and letters, and every byte beyond ASCII."""
    return _LETTERS_AND_DIGITS


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, made as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def __reduce__(self):
        return _Powers, ()  # made anew in each worker, never sent

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * SLICE_BYTES)
            self.up, self.down = (_chain(b, size) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


def _chain(base: int, size: int) -> np.ndarray:
    row = np.full(size, base, dtype=np.uint64)
    row[0] = 1
    return np.multiply.accumulate(row)


_POWERS = _Powers()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches so that each part holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        data, offsets = buffers(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows, start + 8192)
            low, high = offsets[start], offsets[end]
            yield (
                batch.slice(start, end - start),
                data[low:high],
                offsets[start : end + 1] - low,
            )
            start = end


def words(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word number of every row.

    ``offsets`` cut words; the result has one more bound than there are rows.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    fresh[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased."""
    up, down = _POWERS.upto(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * _WORD))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words; the whole sequence if it is shorter."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    h = hashes[:n].copy()
    for k in range(1, size):
        h = mix(h * _WORD + hashes[k : k + n])
    return h


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Regroup batches sorted by an integer ``key`` so that no group is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(values, values[-1]))
        if held and (cut or held[0].column(key)[0].as_py() != values[-1]):
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)
