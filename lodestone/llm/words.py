"""Vectorised word hashing over Arrow string columns.

A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Each word gets a 64-bit polynomial hash taken from one running
sum over the bytes, so cost is a few numpy passes over the text and no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes hashed at once; larger texts go through in pieces cut between words.
PIECE = 1 << 19
#: Bytes of text handed out at once by :func:`slices`.
SLICE = 4 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything of ASCII but letters and digits.
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, PIECE + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=_U)
    return _powers["up"], _powers["down"]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows in them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive runs of rows of about ``most`` bytes (one row at least), with the number of the first row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, at = raw(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield first, column.slice(first, last - first)
        first = last


def words(column: pa.Array, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, byte starts and ends of the words, and offsets of the rows in them.

    With ``plain``, words are runs of letters, digits and non-ASCII characters instead.
    """
    data, at = raw(column)
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~(_MARKS if plain else _SPACE)[data]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    edges = at[at < n]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    out = np.empty(len(starts), dtype=_U)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + PIECE, side="right")))
        high = int(ends[last - 1])
        up, down = _power(high - low + 1)
        sums = np.zeros(high - low + 1, dtype=_U)
        np.cumsum(_VALUE[data[low:high]] * up[: high - low], out=sums[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (sums[b] - sums[a]) * down[a]
        first = last
    return mix(out), starts, ends, np.searchsorted(starts, at).astype(np.int64)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the ``k``-word shingles of one text, sorted; a shorter text counts as one shingle."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    return np.unique(grams(hashes, k))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words, by place."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.full(n, k, dtype=_U)
    for i in range(k):
        total = total * _U(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mix(total)


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character inputs of words: hashes of byte trigrams (with a mark before the word) and of prefixes of 4 to 6 bytes.

    Returns the hashes, grouped by word, and the offset of each word's group; the prefixes come last in a group.
    """
    length = ends - starts
    prefixes = np.clip(length - 3, 0, 3)
    many = length - 1 + prefixes
    at = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(int(at[-1]), dtype=_U)
    if not len(out):
        return out, at
    owner = np.repeat(np.arange(len(starts)), many)
    turn = np.arange(len(out)) - at[owner]
    is_prefix = turn >= (length - 1)[owner]
    first = starts[owner] + turn - 1
    tri = np.flatnonzero(~is_prefix)
    value = lambda i: _VALUE[data[np.clip(i, 0, len(data) - 1)]]
    head = np.where(turn[tri] == 0, _U(0x1234567), value(first[tri]))
    out[tri] = mix(head * _U(0x9E3779B97F4A7C15) + value(first[tri] + 1) * _U(0xC2B2AE3D27D4EB4F) + value(first[tri] + 2) * _U(0x165667B19E3779F9) + _U(3))
    pre = np.flatnonzero(is_prefix)
    if len(pre):
        size = 4 + turn[pre] - (length - 1)[owner[pre]]
        total = np.zeros(len(pre), dtype=_U)
        for i in range(6):
            more = total * _U(0x9E3779B97F4A7C15) + value(starts[owner[pre]] + i)
            total = np.where(i < size, more, total)
        out[pre] = mix(total + size.astype(_U) * _U(0xD6E8FEB86659FD93))
    return out, at
