"""Whole Arrow columns of text as byte arrays: words, their places and 64-bit hashes.

A null text is an empty one. Every word class used here contains all bytes from
0x80 on, so words can be cut on the bytes of UTF-8. Work goes through slices of
rows, so that the arrays stay at a few times CHUNK however long a batch is; one
very long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once.
CHUNK = 1 << 20

M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
WHITE = [0x20, *range(0x09, 0x0E)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, stream: int = 0) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(stream * 0x632BE59BD9B4E019 & M64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = seeds(256, 1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i < n, modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, CHUNK + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def slices(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows that hold about `size` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_table(gaps: list[int]) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[gaps] = False
    return table


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end and hash of each word, A-Z lower-cased, and the index of each text's first word.

    The hash is a polynomial over fixed random numbers of the bytes, so equal
    words have equal hashes; two different ones share it with odds of 2 ** -64.
    """
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1 : n + 1] = table[data]
    # A text boundary also ends a word: where both sides are word bytes, cut there.
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    if len(cuts):
        edge = np.sort(np.concatenate([edge, cuts, cuts]))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LETTER[_LOWER[data]] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the bytes of each stretch, capitals kept apart; equal bytes have equal hashes."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])
