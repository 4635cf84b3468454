"""Words of many texts at once, as numpy arrays over the bytes of an Arrow batch.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Texts are UTF-8, so cutting at these
bytes is cutting at these characters.  Words, lines and windows are compared by 64-bit hashes; equal
ones always have equal hashes, and different ones agree with a chance of about 2**-56.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text handled at once; a longer text is handled alone.
PIECE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_OTHER = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


class Kept(dict):
    """A memory that does not travel: what the driver has computed stays out of the tasks' functions."""

    def __reduce__(self):
        return Kept, ()


_powers: dict[int, np.ndarray] = Kept()


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i < n`` at least."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        full = np.full(max(n, 2 * PIECE_BYTES), base & (2**64 - 1), np.uint64)
        full[0] = 1
        known = _powers[base] = np.cumprod(full)
    return known


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per span ``[start, end)`` of ``values``, by its sequence of values alone.

    Time and room grow with the lengths of all spans.
    """
    size = ends - starts
    edges = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(edges[-1]) - np.repeat(edges[:-1], size)
    terms = mix(values[np.repeat(starts, size) + place] + place.astype(np.uint64) * _STEP)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return mix(sums[edges[1:]] - sums[edges[:-1]] + size.astype(np.uint64))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` consecutive values, by its sequence of values alone.

    Runs are put together from runs of 1, 2, 4, ... values.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, run, size = None, 0, values, 1
    while True:
        if width & size:
            part = run[have : have + n]
            out = part if out is None else mix(out * _FACTOR + part)
            have += size
        if have == width:
            return mix(out + np.uint64(width))
        run = mix(run[:-size] * _STEP + run[size:])
        size *= 2


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of every text; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """Words of a batch of texts.

    ``start`` and ``end`` are byte positions, ``doc`` the text of each word, and the words of text
    ``d`` are those from ``first[d]`` to ``first[d + 1]``.  With ``bare`` set, all ASCII characters other
    than letters and digits separate words.
    """

    def __init__(self, column: pa.Array, lower: bool = False, bare: bool = False):
        self.data, self.offsets = text_bytes(column)
        if lower:
            self.data = _LOWER[self.data]
        n = len(self.data)
        inside = ~(_OTHER if bare else _SPACE)[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        begins, stops = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | cut[1:n]
            stops[:-1] &= ~inside[1:] | cut[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return span_hashes(_BYTE[self.data], self.start, self.end)

    def windows(self, width: int) -> np.ndarray:
        """First words of all windows of ``width`` words that lie in one text."""
        if len(self.doc) < width:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self.doc) - width + 1] == self.doc[width - 1 :])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans of the lines, cut at newlines and at the ends of texts."""
        breaks = np.flatnonzero(self.data == 10)
        filled = self.offsets[:-1][np.diff(self.offsets) > 0]
        starts = np.union1d(filled, breaks + 1)
        starts = starts[starts < len(self.data)]
        stops = self.offsets[np.searchsorted(self.offsets, starts, "right")]
        following = np.append(breaks, len(self.data))[np.searchsorted(breaks, starts)]
        return starts, np.minimum(stops, following)

    def byte_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hashes(_BYTE[self.data], starts, ends)


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch at rows, so that a piece has few texts or one long one."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = text_bytes(column)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1
        stop = min(max(stop, at + 1), batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def map_texts(
    df: DataFrame, text: str, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Apply ``function`` to bounded pieces of the rows, in Arrow batches inside the tasks."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text):
                made = function(piece)
                if made is not None and made.num_rows:
                    yield made

    return df.mapInArrow(run, schema)
