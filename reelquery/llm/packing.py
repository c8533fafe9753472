"""Hierarchical multi-length packing.

A document is its ids followed by one end id.  Whole long windows of a
document become sequences of their own; its remainder is routed to the
smallest context tier that holds it, and waits in that tier's room.  When
enough tokens wait, the tiers are packed from the longest down: a sequence is
opened for the longest piece of the tier's room, and its gap is filled with
the best-fitting pieces, of the tier itself where one fits and of shorter
tiers otherwise.  A gap that no piece fits is closed by cutting the shortest
piece that waits.  Only the end of a task has nothing left to cut: its last
tokens become sequences of the shortest tier whose lengths are powers of two,
so no sequence is padded.

Step groups hold sequences of one tier and STEP_TOKENS tokens each.  The last
two groups of a tier are held back until the task ends and share what is left
evenly, so a group is never a mere rest unless the task has less than a group
of that tier.

All state is a bounded waiting room per task; there is no shuffle, and a
rerun of a task gives the same rows, since sequence ids are built from the
task's partition number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .batchids import batch_ids
from .common import docs_bytes

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens that may wait in a task before the tiers are packed.
WAITING_TOKENS = 1 << 18
#: Tokens of one step group.
STEP_TOKENS = 1 << 16

PACKED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier long, step_group long"
)

#: (length, doc, start, ids, doc_tokens)
Piece = tuple[int, int | None, int, np.ndarray, int]


class StepGroups:
    """Deals a tier's sequences to groups of equally many tokens; the last two share the rest."""

    def __init__(self, step_tokens: int) -> None:
        self.step_tokens = step_tokens
        self.held: list[tuple[int, list[tuple]]] = []  # (tokens, rows) of sequences that have no group yet
        self.tokens = 0

    def _take(self, tokens: int) -> list[tuple]:
        """Rows of the first sequences, up to so many tokens, at least one sequence."""
        rows, taken, n = [], 0, 0
        for size, own in self.held:
            if n and taken + size > tokens:
                break
            rows += own
            taken += size
            n += 1
        del self.held[:n]
        self.tokens -= taken
        return rows

    def add(self, tokens: int, rows: list[tuple]) -> Iterator[list[tuple]]:
        """Takes a sequence; gives the rows of a group once two more groups are held."""
        self.held.append((tokens, rows))
        self.tokens += tokens
        if self.tokens >= 2 * self.step_tokens:
            yield self._take(self.step_tokens)

    def rest(self) -> Iterator[list[tuple]]:
        """What is held, as one group or as two even ones."""
        if self.tokens > self.step_tokens:
            yield self._take(self.tokens + 1 >> 1)
        while self.held:
            yield self._take(self.step_tokens)


class Packer:
    """Packs pieces of one task; `rows` gathers the columns of PACKED."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> None:
        self.tiers = tuple(sorted(tiers))
        self.longest = self.tiers[-1]
        self.base, self.sequences, self.steps = task << 33, 0, 0
        #: Waiting pieces of each tier, ascending by length, and their lengths.
        self.rooms: dict[int, list[Piece]] = {t: [] for t in self.tiers}
        self.lengths: dict[int, list[int]] = {t: [] for t in self.tiers}
        self.groups = {t: StepGroups(step_tokens) for t in self.tiers}
        self.held = 0
        self.rows: list[tuple] = []

    def _grouped(self, groups: Iterator[list[tuple]], tier: int) -> None:
        for rows in groups:
            group = self.base + self.steps
            self.steps += 1
            self.rows += [(*r, tier, group) for r in rows]

    def _close(self, pieces: list[Piece], tier: int) -> None:
        sequence, offset, rows = self.base + self.sequences, 0, []
        self.sequences += 1
        for n, doc, start, ids, total in pieces:
            rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset))
            offset += n
        self._grouped(self.groups[tier].add(offset, rows), tier)

    def _tier(self, n: int) -> int:
        return self.tiers[bisect_left(self.tiers, n)]

    def _wait(self, piece: Piece) -> None:
        tier = self._tier(piece[0])
        at = bisect_right(self.lengths[tier], piece[0])
        self.lengths[tier].insert(at, piece[0])
        self.rooms[tier].insert(at, piece)
        self.held += piece[0]

    def _take(self, tier: int, at: int) -> Piece:
        piece = self.rooms[tier].pop(at)
        del self.lengths[tier][at]
        self.held -= piece[0]
        return piece

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.longest
        for at in range(0, whole, self.longest):
            self._close([(self.longest, doc, at, ids[at : at + self.longest], total)], self.longest)
        if whole < total:
            self._wait((total - whole, doc, whole, ids[whole:].copy(), total))
        if self.held >= WAITING_TOKENS:
            self.flush()

    def _fit(self, gap: int, tier: int) -> Piece:
        """The longest piece of the tier that fits the gap, else of shorter tiers, else a cut of the shortest piece."""
        for t in reversed(self.tiers[: self.tiers.index(tier) + 1]):
            at = bisect_right(self.lengths[t], gap) - 1
            if at >= 0:
                return self._take(t, at)
        n, doc, start, ids, total = self._take(next(t for t in self.tiers if self.rooms[t]), 0)
        self._wait((n - gap, doc, start + gap, ids[gap:], total))
        return gap, doc, start, ids[:gap], total

    def flush(self, last: bool = False) -> None:
        """Pack the tiers, the longest first; less than a longest window waits on unless it is the last."""
        while self.held >= self.longest or last and self.held:
            tier = size = next(t for t in reversed(self.tiers) if self.rooms[t])
            while size > self.held:  # only at the end: the largest power of two that can be filled
                size = 1 << self.held.bit_length() - 1
                tier = self._tier(size)
            pieces, gap = [], size
            while gap:
                pieces.append(self._fit(gap, tier))
                gap -= pieces[-1][0]
            self._close(pieces, tier)
        if last:
            for tier in self.tiers:
                self._grouped(self.groups[tier].rest(), tier)

    def drain(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in PACKED.split(", ")]
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack_documents(
    docs: DataFrame, vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    `tiers` are powers of two; no sequence is longer than the largest.  Each
    id of each document lies in exactly one piece.  Null or empty text is the
    end id alone; null doc_id stays null; repeated rows are packed each; extra
    columns are not read; an empty table gives no rows.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_ids(vocabulary)
        packer = Packer(TaskContext.get().partitionId(), tiers)
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), encoder.texts(b.column(1)), strict=True):
                packer.add(doc, np.concatenate([ids, end]))
                if len(packer.rows) > 10_000:
                    yield packer.drain()
        packer.flush(last=True)
        yield packer.drain()

    return docs_bytes(docs).mapInArrow(run, PACKED)
