"""Words of many texts at once, in numpy.

A word is a run of other than \\x20 and \\x09-\\x0D.  Its 64-bit hash is a
polynomial over its bytes' gears, so one running sum over the bytes of a
batch gives the hashes of all its words; no word becomes a Python object.
Two different words collide at odds of about 2 ** -60.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text worked on at a time; a longer text is a part of its own.
PART_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_EXACT = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=64) for b in range(256)], np.uint64)
#: Gears for comparison without regard to the case of A-Z.
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_BASE = 0x9E3779B97F4A7C17
_BACK = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64, by doubling."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


_tables: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for parts of the usual size."""
    if n > 2 * PART_BYTES:
        return _powers(_BASE, n), _powers(_BACK, n)
    if not _tables or len(_tables[0]) < n:
        size = max(n, PART_BYTES + 1)
        _tables[:] = [_powers(_BASE, size), _powers(_BACK, size)]
    return _tables[0], _tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Words:
    """Words of a part: places in `raw`, and how many each text has."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    def hashes(self, fold: bool) -> np.ndarray:
        """64-bit hash of each word; with `fold`, A-Z count as a-z."""
        n = len(self.raw)
        power, back = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _EXACT)[self.raw] * power[:n], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def bounds(self) -> np.ndarray:
        """Where each text's words begin, and the end."""
        return np.append(0, np.cumsum(self.counts))


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of texts that lie in `raw` at `offsets` (one more than texts, the first being 0)."""
    n = len(raw)
    if not n:
        none = np.empty(0, np.int64)
        return Words(raw, none, none, np.zeros(len(offsets) - 1, np.int64))
    black = ~_WHITE[raw]
    cut = np.zeros(n + 1, bool)  # a text begins here: no word goes across
    cut[offsets] = True
    first = black.copy()
    first[1:] &= ~black[:-1] | cut[1:n]
    last = black.copy()
    last[:-1] &= ~black[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(raw, starts, ends, np.diff(np.searchsorted(starts, offsets)))


def parts(column: pa.BinaryArray, part_bytes: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, raw, offsets): texts of a column without nulls, some megabytes at a time."""
    n = len(column)
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + part_bytes, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
