"""LM scoring by masked pseudo-likelihood.

Every word of a text is hidden in turn and predicted from its neighbours on
both sides by a small network; the sum of the conditional log-probabilities
scores the document.

The vocabulary is counted over all documents.  Frequent words have an id of
their own; every other word falls, by hash, into one of the unknown ids, and
its probability is that of the unknown id times its share of the words
counted there.  All words count, so a rare word never scores as a frequent
one.  The counts stay a table; what goes to the driver is those of the most
frequent words, KNOWN_WORDS at most.  The others are joined where they occur.

Each place of the window has embeddings of its own, whose sum passes through
tanh and predicts in three steps: the id's branch, the twig in the branch,
and the id in the twig, each a softmax over B outputs.  So B ** 3 ids, about
the square root of the number of distinct words, cost 3 * B outputs a word,
and the probabilities over all ids sum to one.

Training is synchronous over the whole corpus: a round goes through it in
turns.  Texts are dealt by hash to shares of about SHARE_WORDS words, in an
order of their own, so shares do not depend on how the table is split.  In
each turn every share runs minibatch steps from the common parameters and
returns what its parameters moved, weighted by its words; the moves are whole
numbers, so their sum does not depend on its order either.  Turns and shares
in a turn both grow as the square root of the corpus: a larger corpus is
trained in more steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import docs_bytes, materialise

#: Outputs of each of the three steps in the smallest model.
BRANCHES = 10
WIDTH = 16
#: Neighbours on each side.
SIDE = 2
PLACES = 2 * SIDE
ROUNDS = 2
RATE = 1.5
#: Rates of the parameters that few words move, as multiples.
FASTER = {"embed": 20.0, "twig": 3.0, "leaf": 6.0}
#: Words of one minibatch step; more where the model has many twigs.
STEP_WORDS = 8192
#: Words of one share of the training, about; a share is never larger than twice that and a text.
SHARE_WORDS = 1 << 20
#: Words whose counts are broadcast, at most.
KNOWN_WORDS = 1 << 20
#: Words that are counted at a time.
COUNT_WORDS = 1 << 21
#: A parameter's move is summed in units of this size.
UNIT = 2.0**-24


# Vocabulary ----------------------------------------------------------------------


class Places:
    """Finds hashes in a sorted array by way of their first bits."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.shift = np.uint64(64 - max(8, len(hashes).bit_length() + 2))
        slots = np.searchsorted(hashes >> self.shift, np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.uint64))
        self.first = slots[:-1].astype(np.int32)
        self.most = int(np.diff(slots).max(initial=0))
        self._padded = np.append(hashes, np.zeros(self.most + 1, np.uint64))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is not there."""
        at = self.first[(h >> self.shift).astype(np.int64)]
        found = np.full(len(h), -1, np.int32)
        if not len(self.hashes):
            return found
        for step in range(self.most):
            hit = self._padded[at + step] == h
            found[hit] = (at + step)[hit]
        found[found >= len(self.hashes)] = -1
        return found


@dataclass(frozen=True)
class Vocabulary:
    """Ids of words: own ids by falling count from 0, then the unknown ids."""

    branches: int
    #: Hashes of the words with an own id, ascending, and their ids.
    hashes: np.ndarray
    own: np.ndarray
    #: Words counted in each id; from `first_unknown` on, ids are unknown ones.
    totals: np.ndarray
    first_unknown: int
    #: Hashes of further frequent words, ascending, and their counts.
    known: np.ndarray
    counts: np.ndarray
    #: Other words were counted less often than this, if at all.
    below: int
    _own: Places = field(init=False)
    _known: Places = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "_own", Places(self.hashes))
        object.__setattr__(self, "_known", Places(self.known))

    def ids(self, h: np.ndarray) -> np.ndarray:
        at = self._own.find(h)
        unknown = (h % np.uint64(len(self.totals) - self.first_unknown)).astype(np.int64) + self.first_unknown
        return np.where(at >= 0, self.own[at], unknown) if len(self.own) else unknown

    def shares(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log of each word's share of its id, places of words whose count must be looked up: theirs counts one)."""
        out = np.zeros(len(h))
        rare = np.flatnonzero(ids >= self.first_unknown)
        at = self._known.find(h[rare])
        n = np.where(at >= 0, self.counts[at], 1) if len(self.counts) else np.ones(len(rare))
        out[rare] = np.log(n) - np.log(np.maximum(self.totals[ids[rare]], 1))
        return out, rare[at < 0]


@dataclass(frozen=True)
class Model:
    flat: np.ndarray
    vocabulary: Vocabulary
    #: (h, n): the words counted twice or more that the vocabulary does not hold.
    counts: DataFrame


def branches_for(distinct: int) -> int:
    """B ** 3 ids, about the square root of the number of distinct words."""
    return max(BRANCHES, math.ceil(distinct ** (1 / 6)))


def turns_for(shares: int) -> int:
    """Turns of a round: half the square root of the number of shares."""
    return max(1, math.ceil(math.sqrt(shares) / 2))


def hashes_of(text: str) -> np.ndarray:
    """Hashes of the words of a text, which A-Z or a-z does not change."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return W.words_of(raw, np.array([0, len(raw)])).hashes(True)


def _parts(column: pa.BinaryArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, hashes, bounds of the texts) of the parts of a column."""
    for first, end, raw, offsets in W.parts(column):
        w = W.words_of(raw, offsets)
        yield first, end, w.hashes(True), w.bounds()


def count_words(docs: DataFrame) -> DataFrame:
    """(h, n): every distinct word and how often it occurs; texts count whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for b in batches:
            for _, _, h, _ in _parts(b.column(1)):
                held.append(h)
                waiting += len(h)
                if waiting >= COUNT_WORDS:
                    yield counted()
                    waiting = 0
        if held:
            yield counted()

    counts = docs_bytes(docs).mapInArrow(run, "h long, n long")
    return materialise(counts.groupBy("h").agg(F.sum("n").alias("n")), "counts")


def _least_known(counts: DataFrame) -> int:
    """The smallest count that KNOWN_WORDS words or fewer have reached, above 1: counts over 1024 go by powers."""
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log(F.col("n").cast("double")) * 64) + 1024)
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("c"), F.min("n").alias("n"))
    found, held = None, 0
    for r in sorted(levels.collect(), key=lambda r: -r["level"]):  # some thousands of levels at most
        held += r["c"]
        if held > KNOWN_WORDS:
            break
        found = r["n"]
    return max(2, found if found is not None else 1 << 62)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """A quarter of the ids are unknown ones; the rest go to the most frequent words that occur more than once."""
    below = _least_known(counts)
    branches = branches_for(counts.count())
    size = branches**3
    unknown = size // 4
    first = size - unknown
    top = counts.where(F.col("n") >= below).toArrow()
    h, n = np.array(top.column("h"), np.int64).view(np.uint64), np.array(top.column("n"), np.int64)
    order = np.lexsort((h, -n))
    h, n = h[order], n[order]
    # Unsigned remainder of the hash, in two halves that stay in the range of a long.
    high, low = F.shiftrightunsigned("h", 32), F.col("h").bitwiseAND(0xFFFFFFFF)
    remainder = (high % unknown * ((1 << 32) % unknown) + low) % unknown
    found = counts.groupBy(remainder.cast("int").alias("id")).agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(size, np.int64)
    totals[first + np.array(found.column("id"), np.int64)] = np.array(found.column("n"), np.int64)
    own, rest = h[:first], h[first:]
    np.subtract.at(totals, first + (own % np.uint64(unknown)).astype(np.int64), n[:first])
    totals[: len(own)] = n[:first]
    by_own, by_rest = np.argsort(own), np.argsort(rest)
    return Vocabulary(branches, own[by_own], by_own, totals, first, rest[by_rest], n[first:][by_rest], below)


# The network ---------------------------------------------------------------------


def shapes(branches: int) -> dict[str, tuple[int, ...]]:
    """Embeddings per place of the window, the last row of each standing outside a text; outputs with their biases."""
    return {
        "embed": (PLACES, branches**3 + 1, WIDTH),
        "hidden": (WIDTH,),
        "branch": (WIDTH + 1, branches),
        "twig": (branches, WIDTH + 1, branches),
        "leaf": (branches * branches, WIDTH + 1, branches),
    }


def split(flat: np.ndarray, branches: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(branches).items():
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(known: Vocabulary, seed: int = 1) -> np.ndarray:
    """Parameters that predict every id as often as it was counted."""
    rng, b = np.random.default_rng(seed), known.branches
    flat = rng.normal(0, 0.25, sum(math.prod(s) for s in shapes(b).values())).astype(np.float32)
    p = split(flat, b)
    p["hidden"][...] = 0
    n = np.maximum(known.totals, 0.5).reshape(b, b, b)
    twigs, all_ = n.sum(2), n.sum()
    # At first the neighbours have no say.
    for name, share in (("branch", twigs.sum(1) / all_), ("twig", twigs / twigs.sum(1, keepdims=True)), ("leaf", n / twigs[..., None])):
        p[name][...] = 0
        p[name][..., WIDTH, :] = np.log(share).reshape(p[name][..., WIDTH, :].shape)
    return flat


def windows(ids: np.ndarray, bounds: np.ndarray, outside: int) -> np.ndarray:
    """Ids of the neighbours of each word; beyond the ends of its text stands `outside`."""
    n = len(ids)
    near = np.empty((PLACES, n), np.int64)
    sizes = np.diff(bounds)
    at = np.arange(n)
    left, right = at - np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes) - at
    for place, k in enumerate(k for k in range(-SIDE, SIDE + 1) if k):
        inside = left + k >= 0 if k < 0 else right - k > 0
        near[place] = np.where(inside, ids[np.clip(at + k, 0, max(n - 1, 0))], outside) if n else 0
    return near


def _hidden(p: dict[str, np.ndarray], near: np.ndarray) -> np.ndarray:
    """Hidden values, and a last column of ones for the biases."""
    h = np.ones((near.shape[1], WIDTH + 1), np.float32)
    total = p["hidden"] + p["embed"][0][near[0]]
    for place in range(1, PLACES):
        total += p["embed"][place][near[place]]
    np.tanh(total, out=h[:, :WIDTH])
    return h


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place; rows of one step differ by far less than the range of a float."""
    if len(z):
        z -= z.max()
        np.exp(z, out=z)
        z += np.float32(1e-30)
        z *= (1 / (z @ np.ones(z.shape[1], np.float32)))[:, None]
    return z


def _order(ids: np.ndarray, size: int) -> np.ndarray:
    """Stable order of small numbers: by radix where they have two bytes."""
    return np.argsort(ids.astype(np.uint16) if size <= 1 << 16 else ids, kind="stable")


def _groups(sorted_ids: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(group, first, end) of the groups that occur."""
    at = np.searchsorted(sorted_ids, np.arange(n + 1)).tolist()
    return [(g, a, b) for g, (a, b) in enumerate(zip(at, at[1:], strict=False)) if a < b]


def _forward(p: dict[str, np.ndarray], h: np.ndarray, leaf: np.ndarray, b: int) -> tuple:
    """Probabilities of all three steps; words are sorted by twig (leaf // b)."""
    twig = leaf // b
    branches, twigs = _groups(twig // b, b), _groups(twig, b * b)
    first = _softmax(h @ p["branch"])
    second, third = np.empty((len(h), b), np.float32), np.empty((len(h), b), np.float32)
    for g, i, j in branches:
        np.matmul(h[i:j], p["twig"][g], out=second[i:j])
    for g, i, j in twigs:
        np.matmul(h[i:j], p["leaf"][g], out=third[i:j])
    return first, _softmax(second), _softmax(third), branches, twigs


def step_words(branches: int) -> int:
    return max(STEP_WORDS, 32 * branches * branches)


def log_probabilities(flat: np.ndarray, branches: int, near: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """log P(id | its neighbours on both sides), in the order of the words."""
    p, out, b = split(flat, branches), np.empty(len(centre)), branches
    size = step_words(b)
    for a in range(0, len(centre), size):
        own = centre[a : a + size]
        order = _order(own // b, b * b)
        leaf = own[order]
        first, second, third, _, _ = _forward(p, _hidden(p, near[:, a : a + size][:, order]), leaf, b)
        at = np.arange(len(leaf))
        found = np.log(first[at, leaf // (b * b)] + 1e-12) + np.log(second[at, leaf // b % b] + 1e-12)
        out[a + order] = found + np.log(third[at, leaf % b] + 1e-12)
    return out


def step(flat: np.ndarray, branches: int, near: np.ndarray, centre: np.ndarray, rate: float) -> None:
    """One step along the gradient of the mean log-probability, in place; some parameters go FASTER."""
    p, b, n = split(flat, branches), branches, len(centre)
    order = _order(centre // b, b * b)
    near, leaf = near[:, order], centre[order]
    h = _hidden(p, near)
    first, second, third, branch_groups, twig_groups = _forward(p, h, leaf, b)
    at, r = np.arange(n), np.float32(rate / n)
    first[at, leaf // (b * b)] -= 1
    second[at, leaf // b % b] -= 1
    third[at, leaf % b] -= 1
    back = first @ p["branch"].T
    p["branch"] -= r * (h.T @ first)
    for name, error, groups in (("twig", second, branch_groups), ("leaf", third, twig_groups)):
        w = p[name]
        for g, i, j in groups:
            back[i:j] += error[i:j] @ w[g].T
            w[g] -= r * np.float32(FASTER[name]) * (h[i:j].T @ error[i:j])
    h *= h
    np.subtract(1, h, out=h)
    back *= h
    back = np.ascontiguousarray(back[:, :WIDTH]) * r
    p["hidden"] -= np.ones(n, np.float32) @ back
    back *= np.float32(FASTER["embed"])
    for place in range(PLACES):
        # Sorted sums instead of a scatter per word.
        by = _order(near[place], b**3 + 1)
        ids = near[place][by]
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        p["embed"][place][ids[starts]] -= np.add.reduceat(back[by], starts, axis=0)


# Training ------------------------------------------------------------------------


def shares_of(docs: DataFrame, known: Vocabulary, words: int) -> tuple[DataFrame, int]:
    """(ids, sizes, turn): one row per share, and the number of turns; texts go to shares by their hash."""
    shares = max(1, math.ceil(words / SHARE_WORDS))
    turns = turns_for(shares)
    narrow = known.branches**3 < 1 << 16
    kind = "<u2" if narrow else "<u4"
    # Rows that are equal in both columns count as often as they occur, and their order does not matter.
    keyed = docs_bytes(docs).withColumn("k", F.xxhash64("doc_id", "text")).select("k", "text")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, h, bounds in _parts(b.column(1)):
                flat = known.ids(h).astype(kind).tobytes()
                at = (bounds * (2 if narrow else 4)).tolist()
                texts = pa.array([flat[i:j] for i, j in zip(at, at[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), texts], ["k", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, held, size = None, [], 0

        def row() -> pa.RecordBatch:
            sizes = np.array([len(x) // (2 if narrow else 4) for x in held], "<i8").tobytes()
            columns = [pa.array([b"".join(held)], pa.binary()), pa.array([sizes], pa.binary()), pa.array([share % turns], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["ids", "sizes", "turn"])

        for b in batches:
            for s, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if held and (s != share or size >= 2 * SHARE_WORDS):
                    yield row()
                    held, size = [], 0
                share = s
                held.append(text.as_py())
                size += len(held[-1]) // (2 if narrow else 4)
        if held:
            yield row()

    dealt = keyed.mapInArrow(ids, "k long, ids binary").withColumn("share", F.pmod("k", F.lit(shares)))
    dealt = dealt.repartition("share").sortWithinPartitions("share", "k", "ids").select("share", "ids")
    return materialise(dealt.mapInArrow(joined, "ids binary, sizes binary, turn int"), "shares", "turn"), turns


def moved(begin: np.ndarray, branches: int, ids: np.ndarray, sizes: np.ndarray, rate: float, size: int) -> np.ndarray:
    """What the parameters move by in minibatch steps of `size` words through one share, times its words, in UNITs."""
    mine = begin.copy()
    bounds = np.append(0, np.cumsum(sizes))
    near = windows(ids, bounds, branches**3)
    for a in range(0, len(ids), size):
        part = ids[a : a + size]
        step(mine, branches, near[:, a : a + size], part, rate * len(part) / size)
    return np.rint((mine - begin).astype(np.float64) * (len(ids) / UNIT)).astype(np.int64)


CHUNK = 1 << 12


def _moves(shares: DataFrame, begin: np.ndarray, branches: int, rate: float, step_size: int) -> tuple[np.ndarray, int]:
    """(what the parameters moved, times words, in UNITs; words) over the shares of a turn."""
    narrow = branches**3 < 1 << 16
    size = len(begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(size, np.int64), 0
        for b in batches:
            for raw, sizes in zip(b.column(0), b.column(1), strict=True):
                ids = np.frombuffer(raw.as_py(), "<u2" if narrow else "<u4").astype(np.int64)
                total += moved(begin, branches, ids, np.frombuffer(sizes.as_py(), "<i8"), rate, step_size)
                words += len(ids)
        at = np.arange(0, size, CHUNK)
        blobs = [total[a : a + CHUNK].astype("<i8").tobytes() for a in at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(blobs, pa.binary()), pa.array(np.full(len(at), words))], ["at", "move", "words"]
        )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for at, blob, words in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                have = held.setdefault(at, [0, 0])
                have[0] = have[0] + np.frombuffer(blob.as_py(), "<i8")
                have[1] += words
        columns = [list(held), [m.astype("<i8").tobytes() for m, _ in held.values()], [w for _, w in held.values()]]
        kinds = (pa.int64(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["at", "move", "words"])

    kind = "at long, move binary, words long"
    found = shares.select("ids", "sizes").mapInArrow(run, kind).repartition("at").mapInArrow(summed, kind).collect()
    total, words = np.zeros(size, np.int64), 0
    for r in found:  # one row per CHUNK parameters
        total[r["at"] : r["at"] + CHUNK] = np.frombuffer(r["move"], "<i8")
        words = r["words"]
    return total, words


def train(docs: DataFrame, rounds: int = ROUNDS, seed: int = 1, rate: float = RATE, step_size: int | None = None) -> Model:
    """A model fitted to all texts; the same for the same rows, however they are split."""
    counts = count_words(docs)
    known = vocabulary(counts)
    shares, turns = shares_of(docs, known, int(known.totals.sum()))
    flat, size = start(known, seed), step_size or step_words(known.branches)
    for epoch in range(rounds):
        for turn in range(turns):
            total, words = _moves(shares.where(F.col("turn") == turn), flat, known.branches, rate / (1 + epoch), size)
            if words:
                flat = flat + (total * (UNIT / words)).astype(np.float32)
    rare = counts.where((F.col("n") > 1) & (F.col("n") < known.below))
    return Model(flat, known, rare)


# Scoring -------------------------------------------------------------------------


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_likelihood, per_word: one row per input row.

    A word that the model never met counts as one it met once.  Null, empty
    or blank text has no words, a log-likelihood of 0 and a null per_word;
    null doc_id stays null; repeated rows repeat; very long texts are scored
    whole; extra columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.flat, model.vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, known = shared.value
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for first, end, h, bounds in _parts(b.column(1)):
                ids = known.ids(h)
                found, unsure = known.shares(h, ids)
                found += log_probabilities(flat, known.branches, windows(ids, bounds, known.branches**3), ids)
                n = np.diff(bounds)
                total = np.zeros(len(n))
                if len(found):
                    some = np.flatnonzero(n)
                    total[some] = np.add.reduceat(found, bounds[some])
                rare = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(unsure, bounds).astype(np.int32)), pa.array(h[unsure].view(np.int64))
                )
                columns = [
                    pa.array(np.arange(row, row + len(n))), b.column(0).slice(first, end - first), pa.array(n), pa.array(total), rare,
                ]
                row += len(n)
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "total", "rare"])

    scores = docs_bytes(docs).mapInArrow(run, "row long, doc_id long, n_words long, total double, rare array<long>")
    scores = materialise(scores, "scores")
    met = scores.select("row", F.explode("rare").alias("h")).join(model.counts, "h")
    more = met.groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    scores = scores.drop("rare").join(more, "row", "left")
    scores = scores.withColumn("log_likelihood", F.col("total") + F.coalesce("more", F.lit(0.0)))
    per = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return scores.select("doc_id", "n_words", "log_likelihood", per.alias("per_word"))


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Train on the documents and score them; the cases are those of `score`."""
    return score(docs, train(docs, rounds))
