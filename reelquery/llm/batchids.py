"""Token ids of many texts at once: the ids of a batch's distinct chunks, gathered.

White space never lies inside a token, so a text's ids are the ids of its
white-space-delimited chunks.  A part of a batch is split and hashed in numpy
(`words`); only its distinct chunks are looked up, and those that the table
of earlier chunks lacks have their merge rules applied to all of them at a
time: in each round, every piece merges its pair of lowest rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import words
from .bpe import TABLE_ENTRIES, Vocabulary, default_vocabulary

#: Bytes of text whose distinct chunks are taken together.
PART_BYTES = 1 << 22
#: Pieces that are merged together.
MERGE_PIECES = 1 << 16
_NONE = np.int32(np.iinfo(np.int32).max)
_LONG = 64


class Merger:
    """The merge rules of a vocabulary, applied to many pieces at once."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self._inner = np.array(vocabulary.inner, np.int32)
        self._final = np.array(vocabulary.final, np.int32)
        keys = np.fromiter(vocabulary.rank_of.keys(), np.int64, len(vocabulary.rank_of))
        ranks = np.fromiter(vocabulary.rank_of.values(), np.int32, len(keys))
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], ranks[order]
        # Candidates of a pair are those of its left id: few, and found without a search through all keys.
        self._merged = np.array([m for _, _, m in vocabulary.rules], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 16 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], _NONE)

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers; pieces are not empty."""
        out: list[bytes] = []
        for first in range(0, len(pieces), MERGE_PIECES):
            out += self._merge(pieces[first : first + MERGE_PIECES])
        return out

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self._inner[raw]
        ids[ends - 1] = self._final[raw[ends - 1]]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (pieces, lengths, ids)
        owner = np.arange(len(pieces))
        rank = np.full(len(ids), _NONE, np.int32)
        if len(ids) > 1:
            rank[:-1] = self._rank(ids[:-1], ids[1:])
        rank[ends - 1] = _NONE  # no pair goes across pieces
        while len(owner):
            starts = np.append(0, np.cumsum(lengths)[:-1])
            least = np.minimum.reduceat(rank, starts)
            busy = least != _NONE
            if not busy.all():
                mine = np.repeat(busy, lengths)
                done.append((owner[~busy], lengths[~busy], ids[~mine]))
                owner, lengths, least, ids, rank = owner[busy], lengths[busy], least[busy], ids[mine], rank[mine]
                if not len(owner):
                    break
                starts = np.append(0, np.cumsum(lengths)[:-1])
            # The leftmost pair of the lowest rank of each piece.
            hits = np.flatnonzero(rank == np.repeat(least, lengths))
            of = np.searchsorted(starts, hits, side="right") - 1
            at = hits[np.append(True, of[1:] != of[:-1])]
            ids[at] = self._merged[least]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            rank = rank[keep]
            at -= np.arange(len(at))
            lengths = lengths - 1
            starts = np.append(0, np.cumsum(lengths)[:-1])
            ends = starts + lengths - 1
            # Pairs on both sides of the merged symbols are new.
            rank[at] = _NONE
            right = at[at < ends]
            rank[right] = self._rank(ids[right], ids[right + 1])
            left = at[at > starts]
            rank[left - 1] = self._rank(ids[left - 1], ids[left])
        found: list[bytes] = [b""] * len(pieces)
        for own, n, flat in done:
            blob, to = flat.astype("<u4").tobytes(), 0
            for piece, size in zip(own.tolist(), (n * 4).tolist(), strict=True):
                found[piece] = blob[to : to + size]
                to += size
        return found


class BatchIds:
    """Ids of whole texts by a vocabulary file, as the tokenizers library gives them."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES) -> None:
        self.vocabulary = Vocabulary(path)
        self._merge = Merger(self.vocabulary)
        self._entries = entries
        #: chunk -> ids; of chunks of at most _LONG bytes
        self._table: dict[bytes, bytes] = {}

    def _new(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that the table lacks."""
        found: dict[bytes, bytes] = {}
        plain, mixed = [], []
        for c in chunks:
            if len(c) > _LONG or b"<" in c:  # long ones by the queue, piece by piece; special tokens begin with <
                found[c] = self.vocabulary.text_ids(c.decode("utf-8", "replace"))
            elif c.isalpha():
                plain.append(c)  # ASCII letters: one piece
            else:
                mixed.append(c)
        folded = [c.lower() for c in plain]
        pieces = self.vocabulary.pieces_of(mixed)
        distinct = dict.fromkeys([*folded, *(p for many in pieces for p in many)])
        ids = dict(zip(distinct, self._merge(list(distinct)), strict=True))
        found.update(zip(plain, map(ids.__getitem__, folded), strict=True))
        found.update((c, b"".join(map(ids.__getitem__, many))) for c, many in zip(mixed, pieces, strict=True))
        return found

    def chunk_ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each of some distinct chunks."""
        table = self._table
        new = [c for c in chunks if c not in table]
        if not new:
            return list(map(table.__getitem__, chunks))
        own = self._new(new)
        # What is asked for is gathered before the table takes more, so a full table costs nothing but time.
        out = [own[c] if c in own else table[c] for c in chunks]
        if len(table) + len(own) > self._entries:
            table.clear()
        if len(own) <= self._entries:
            table.update((c, i) for c, i in own.items() if len(c) <= _LONG)
        return out

    def texts(self, column: pa.BinaryArray) -> Iterator[np.ndarray]:
        """Ids of each text of a column without nulls."""
        for _, _, raw, offsets in words.parts(column, PART_BYTES):
            yield from self._part(raw, offsets)

    def _part(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        w = words.words_of(raw, offsets)
        if not len(w.starts):
            yield from (np.empty(0, "<u4") for _ in range(len(offsets) - 1))
            return
        _, first, which = np.unique(w.hashes(False), return_index=True, return_inverse=True)
        text = raw.tobytes()
        if not _same(w, first, which):  # two chunks of one hash: no more than a thought, but ids must be exact
            distinct: dict[bytes, int] = {}
            which = np.array(
                [distinct.setdefault(text[a:b], len(distinct)) for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
            )
            chunks = list(distinct)
        else:
            chunks = [text[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)]
        found = self.chunk_ids(chunks)
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(sizes) - sizes
        counts = sizes[which]
        before = np.append(0, np.cumsum(counts))
        ids = pool[np.repeat(begins[which] - before[:-1], counts) + np.arange(before[-1])]
        at = before[w.bounds()].tolist()
        for a, b in zip(at, at[1:], strict=False):
            yield ids[a:b]


def _same(w: words.Words, first: np.ndarray, which: np.ndarray) -> bool:
    """Whether every word has the bytes of the first word of its hash."""
    sizes = w.ends - w.starts
    model = first[which]
    if (sizes[model] != sizes).any():
        return False
    step = 1 << 18  # words compared at a time
    for a in range(0, len(sizes), step):
        n = sizes[a : a + step]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        here = w.raw[np.repeat(w.starts[a : a + step], n) + inside]
        if (here != w.raw[np.repeat(w.starts[model[a : a + step]], n) + inside]).any():
            return False
    return True


_kept: dict[str, BatchIds] = {}


def batch_ids(path: str | None = None) -> BatchIds:
    """One per Python worker and file."""
    path = path or default_vocabulary()
    if path not in _kept:
        _kept[path] = BatchIds(path)
    return _kept[path]
