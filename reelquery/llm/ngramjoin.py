"""N-gram Jaccard join: documents whose sets of word n-grams overlap enough, as components.

The join is a sparse matrix product of the document by n-gram incidence with
its transpose, in blocks, keeping only entries that can reach the threshold.

1. Each text becomes a sorted array of 64-bit n-gram hashes; equal sets are
   one row of the matrix (its smallest doc_id).
2. Sizes bound in how many n-grams two linked sets can differ.  The range of
   the hashes is cut into more segments than that, by a number that depends on
   the size class of the smaller set, so linked sets agree in whole segments:
   in as many as a link takes at least.  A row's segments become signatures,
   several n-grams each, so chance and shared passages seldom meet in one.
   Only signatures are shuffled; a row with too few that others have is
   discarded.
3. The remaining rows meet in blocks.  A block is what shares a signature
   whose most widely sharing row, the pivot, is the same.  Most rows of a
   large block share a passage and no more.  So signatures meet first, which
   are few: a row goes on only with rows that it shares as many with as a
   link takes, and the components of these are the blocks of the next step.
4. In a block the product with the pivot comes first; rows that it links need
   not be held against each other, since only components are asked for.
   Every other row is multiplied with the whole block.  Overlaps accumulate
   over the block's postings, and pairs below the bounds of their sizes are
   discarded.
5. Blocks of more than BLOCK_ROWS rows are split; rows left open by their own
   part meet the other parts, piece by piece.  No task holds more than two
   parts, and no pair is a row of a table: tasks return spanning links.

Signatures and pivots that very many rows have are joined by a broadcast of
at most HOT_KEYS rows, all others by a shuffle, so no key gathers in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import P, bit_filter, bit_set, bit_table, discard, docs_bytes, hot_keys, join_spread, materialise, with_bit
from .components import connected

#: Rows and n-grams of one part of a block, about, and open rows that meet a part at a time.
BLOCK_ROWS = 256
BLOCK_GRAMS = 1 << 22
OPEN_ROWS = 256
#: Rows of one part of a block, about, while signatures meet.
SIGNED_ROWS = 1024
#: Bits of the filters that spare what has no partner from being shuffled: fixed sizes, 8 MB and 1 MB.
SIGNATURE_BITS = 1 << 26
FILTER_BITS = 1 << 23
#: Sizes of a class differ by this factor at most.
CLASS_RATIO = 1.5

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


# N-gram sets ---------------------------------------------------------------------


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for each i."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _hash_runs(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k word hashes from each place on."""
    out = h[at] * _M1
    for i in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * _M2 + h[at + i] * _M3
    return W.mix(out ^ np.uint64(k))


def sets_of_texts(column: pa.BinaryArray, words: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct hashes of each text's word n-grams, a part of the column at a time.

    A text of fewer words has one n-gram, all of it; one without words none.
    """
    for _, _, raw, offsets in W.parts(column):
        w = W.words_of(raw, offsets)
        h, n, at = w.hashes(True), w.counts, w.bounds()
        windows = np.maximum(n - words + 1, 0)
        grams = _hash_runs(h, _runs(at[:-1], windows), words)
        ends = np.cumsum(windows)
        found = [grams[b - m : b] for b, m in zip(ends.tolist(), windows.tolist(), strict=True)]
        for i in np.flatnonzero((n > 0) & (n < words)).tolist():
            found[i] = _hash_runs(h, at[i : i + 1], int(n[i]))
        yield [_distinct(x) for x in found]


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    again = x[1:] == x[:-1]
    return x[np.append(True, ~again)] if again.any() else x


def shingles(text: bytes, words: int) -> np.ndarray:
    """The set of one text."""
    return next(sets_of_texts(pa.array([text], pa.binary()), words))[0]


# Signatures ----------------------------------------------------------------------


@lru_cache(maxsize=65536)
def class_of(n: int) -> tuple[int, int]:
    """Smallest and largest size of the size class of n."""
    low = 1
    while True:
        high = max(low, math.ceil(low * CLASS_RATIO) - 1)
        if n <= high:
            return low, high
        low = high + 1


@lru_cache(maxsize=4096)
def segments(low: int, high: int, num: int, den: int) -> tuple[int, int, int]:
    """(segments, empty ones allowed, signatures shared at least) of the pairs whose smaller set is in a class.

    Linked sets a <= b have b <= a * den / num and differ in (a + b) * (den -
    num) / (den + num) n-grams at most.  Each of these spoils one segment, so
    at least `segments` less that many agree; of these, so many may be empty
    as the emptier of the two rows has.  No segments: only equal sets link.
    """
    differ = (high + high * den // num) * (den - num) // (den + num)
    if not differ:
        return 0, 0, 0
    least = 1 + min(3, low // 50)
    empty = 1 + math.ceil(1.5 * (differ + least) * math.exp(-low / (differ + least)))
    return differ + least + empty, empty, least


@lru_cache(maxsize=65536)
def classes(n: int, num: int, den: int) -> tuple[tuple[int, int, int, int], ...]:
    """(class's low, segments, empty allowed, shared least) of all pairs that a set of n can be in, as smaller or larger one."""
    out, size = [], -(-n * num // den)
    while size <= n:
        low, high = class_of(size)
        found = segments(low, high, num, den)
        if found[0]:
            out.append((low, *found))
        size = high + 1
    return tuple(out)


def signatures(sets: list[np.ndarray], num: int, den: int) -> tuple[list[np.ndarray], list[bool]]:
    """Hashes of each set's segments; equal segments of one class have equal ones, and empty segments have none.
    And whether a set is bare: has more empty segments than allowed.

    A bare row has its first n-grams as signatures too: as many as linked sets need to share some of them.  A
    pair that may agree in empty segments alone has two such rows.
    """
    asked = [classes(len(s), num, den) for s in sets]
    out: list[list[np.ndarray]] = [[] for _ in sets]
    bare = [False] * len(sets)
    for turn in range(max(map(len, asked), default=0)):
        mine = [i for i, a in enumerate(asked) if len(a) > turn]
        sizes = np.array([len(sets[i]) for i in mine], np.int64)
        k = np.repeat(np.array([asked[i][turn][1] for i in mine], np.uint64), sizes)
        low = np.array([asked[i][turn][0] for i in mine], np.uint64)
        grams = np.concatenate([sets[i] for i in mine])
        segment = (grams >> np.uint64(32)) * k >> np.uint64(32)
        first = np.zeros(len(grams), bool)
        first[1:] = segment[1:] != segment[:-1]
        first[np.cumsum(sizes) - sizes] = True
        at = np.flatnonzero(first)
        owner = np.repeat(np.arange(len(mine)), sizes)[at]
        signed = np.add.reduceat(W.mix(grams * _M3), at)
        signed = W.mix(signed + segment[at] * _M1 + (low * _M2)[owner])
        ends = np.searchsorted(owner, np.arange(len(mine) + 1)).tolist()
        for j, i in enumerate(mine):
            own = signed[ends[j] : ends[j + 1]]
            out[i].append(own)
            low_, k_, empty, least = asked[i][turn]
            if len(own) < k_ - empty:
                n, bare[i] = len(sets[i]), True
                prefix = sets[i][: n - -(-n * num // den) + least]
                out[i].append(W.mix(prefix ^ W.mix(np.array([low_], np.uint64))))
    return [np.unique(np.concatenate(x)) if x else np.empty(0, np.uint64) for x in out], bare


INCIDENCE = "doc_id long, set_id binary, n long, least int, bare int, signatures array<long>"


def incidence(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """One row per document: digest of its set, the set's size, signatures a link takes at least, 1 if bare, and its signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = 0
            for sets in sets_of_texts(b.column(1), words):
                signed, bare = signatures(sets, num, den)
                least = [min((c[3] for c in classes(len(s), num, den)), default=0) for s in sets]
                offsets = np.append(0, np.cumsum([len(x) for x in signed])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(first, len(sets)),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(least, pa.int32()),
                        pa.array([int(x) for x in bare], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(signed).view(np.int64))),
                    ],
                    ["doc_id", "set_id", "n", "least", "bare", "signatures"],
                )
                first += len(sets)

    return docs_bytes(docs).mapInArrow(run, INCIDENCE)


# Blocks --------------------------------------------------------------------------


def one_per_set(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """The row of each set whose doc_id is its smallest; only rows that may have equals are shuffled."""
    again = firsts.where("c > 1")
    marks = bit_table(again.select(F.xxhash64("set_id").alias("x")), "x", FILTER_BITS)
    marked = bit_set(rows, F.xxhash64("set_id"), marks, FILTER_BITS, P + "again")
    first = firsts.select(F.col("node").alias("doc_id"), "set_id")
    met = marked.where(P + "again").join(first, ["doc_id", "set_id"], "left_semi").dropDuplicates(["doc_id", "set_id"])
    return marked.where(~F.col(P + "again")).unionByName(met).drop(P + "again")


def sharing_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, node, n, least, bare, wide): signatures of rows that may have a link, where other rows have them too; and the hot ones.

    `wide` is the share, in thousandths, of a row's signatures that others have.
    """
    exploded = rows.select(F.explode("signatures").alias("gram"))
    common = materialise(exploded.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1"), "common")
    hot = materialise(hot_keys(common, "gram"), "hot")
    bits = bit_filter(common, "gram", SIGNATURE_BITS)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(4).flatten().to_numpy(zero_copy_only=False)
            sizes = np.array(pc.list_value_length(b.column(4)), np.int64)
            bit = np.mod(flat, SIGNATURE_BITS)
            at = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes)[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[at]), *(c.take(owner) for c in b.columns[:4]), pa.array(sizes.astype(np.int32)).take(owner)],
                ["gram", "node", "n", "least", "bare", "p"],
            )

    postings = rows.select(F.col("doc_id").alias("node"), "n", "least", "bare", "signatures").mapInArrow(
        kept, "gram long, node long, n long, least int, bare int, p int"
    )
    shared = materialise(join_spread(postings, common.select("gram"), "gram", hot), "shared")
    share = (F.count("*") * 1000 / F.max("p")).cast("int")
    able = shared.groupBy("node").agg(F.count("*").alias("c"), F.min("least").alias("l"), share.alias("wide"))
    able = able.where("c >= l").select("node", "wide")
    sharing = materialise(shared.drop("p").join(able, "node"), "sharing")
    discard(common, shared)
    return sharing, hot


def blocks(sharing: DataFrame, hot: DataFrame) -> DataFrame:
    """(pivot, node, n) distinct: rows that share a signature, under the widest sharing row of that signature.

    A pivot that shares with a wider pivot as much as a link takes hands its
    block over, so the rows of a group of copies stand in one block rather than
    in several; one that shares less keeps its own.
    """
    best = F.max(F.struct("wide", (-F.col("node")).alias("minus")))
    pivots = sharing.groupBy("gram").agg(best.alias("m"), F.count("*").alias("c")).where("c > 1")
    pivots = pivots.select("gram", (-F.col("m.minus")).alias("pivot"), F.col("m.wide").alias("head_wide"))
    met = join_spread(sharing.drop("wide", "bare"), pivots, "gram", hot)
    members = materialise(met.groupBy("pivot", "head_wide", "node", "n", "least").agg(F.count("*").alias("c")), "members")
    rank = F.struct("head_wide", (-F.col("pivot")).alias("minus"))
    near = members.where((F.col("c") >= F.col("least")) | (F.col("node") == F.col("pivot")))
    heads = near.join(members.select(F.col("pivot").alias("head")).distinct(), F.col("node") == F.col("head"), "left_semi")
    up = materialise(heads.groupBy("node").agg(F.max(rank).alias("m")).select("node", (-F.col("m.minus")).alias("up")), "up")
    higher = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
    up = up.join(higher, "up").select(F.col("node").alias("pivot"), "top")
    hot = hot_keys(members.groupBy("pivot").agg(F.count("*").alias("c")), "pivot")
    moved = join_spread(members.select("pivot", "node", "n"), up, "pivot", materialise(hot, "hot"))
    return moved.select(F.col("top").alias("pivot"), "node", "n").distinct()


class Signed:
    """Rows (node, size, bare, signatures) of one part of a block, while signatures meet."""

    def __init__(self, rows: list[tuple], num: int, den: int) -> None:
        self.nodes, self.sizes, self.bare = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.sets, self.num, self.den = [r[3] for r in rows], num, den
        self.part = Incidence(self.sets)
        found = np.array([segments(*class_of(int(n)), num, den) for n in self.sizes], np.int64)
        self.segments, self.empty, self.least = found.T

    def partners(self, i: int) -> np.ndarray:
        """Positions of the other rows that may link with row i, by their sizes and the number of signatures shared.

        `segments` with the two sizes themselves in place of their class's
        largest: all but a few segments agree, unless both rows are bare.
        """
        n, m, mine = self.sizes[i], self.sizes, self.sizes[i] <= self.sizes
        of = lambda x: np.where(mine, x[i], x)
        differ = (n + m) * (self.den - self.num) // (self.den + self.num)
        least = np.where(self.bare[i] & self.bare, of(self.least), of(self.segments) - differ - of(self.empty))
        found = self.part.product(self.sets[i]) >= np.maximum(least, 1)
        found &= np.minimum(n, m) * self.den >= np.maximum(n, m) * self.num
        found[i] = False
        return np.flatnonzero(found)


def narrow(pivot: int, rows: list[tuple], num: int, den: int, whole: bool) -> list[tuple[int, int, int]]:
    """(pivot, node, n) of rows that have partners.

    With the `whole` block at hand, rows go by the components of partners:
    the pivot's keeps it, every other takes its row with most partners found.
    """
    part = Signed(rows, num, den)
    nodes, sizes, links = part.nodes, part.sizes, Links(part.nodes)
    degree = np.zeros(len(rows), np.int64)
    hub = next((i for i, x in enumerate(nodes.tolist()) if x == pivot), None)
    for i in ([] if hub is None else [hub]) + [i for i in range(len(rows)) if i != hub]:
        if hub is not None and i != hub and links.root(i) == links.root(hub):
            continue
        if degree[i] and not whole:
            continue
        met = part.partners(i)
        degree[i] = max(degree[i], len(met))
        degree[met] = np.maximum(degree[met], 1)
        for j in met.tolist():
            links.add(i, j)
    kept = np.flatnonzero(degree).tolist()
    if not whole:
        return [(pivot, int(nodes[i]), int(sizes[i])) for i in kept]
    heads: dict[int, int] = {}
    for i in kept:
        root = links.root(i)
        at = heads.setdefault(root, i)
        if at != hub and (i == hub or (degree[i], -nodes[i]) > (degree[at], -nodes[at])):
            heads[root] = i
    return [(int(nodes[heads[links.root(i)]]), int(nodes[i]), int(sizes[i])) for i in kept]


def narrowed(blocks: DataFrame, sharing: DataFrame, num: int, den: int) -> DataFrame:
    """(pivot, node, n) distinct: `blocks` without rows that can link with none of their block.

    Every two parts of a block meet, by the signatures that others have too;
    the pivot is with all of them.
    """
    counts = blocks.groupBy("pivot").agg(F.count("*").alias("c"))
    hot = materialise(hot_keys(counts, "pivot"), "hot")
    parts = counts.select("pivot", F.ceil(F.col("c") / SIGNED_ROWS).cast("int").alias("parts"))
    placed = join_spread(blocks, parts, "pivot", hot)
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int")
    placed = placed.withColumn("own", F.explode(F.when(F.col("node") == F.col("pivot"), others).otherwise(F.array(own))))
    placed = placed.withColumn("other", F.explode(others))
    first, last = F.least("own", "other").alias("first"), F.greatest("own", "other").alias("last")
    placed = placed.select("pivot", first, last, "parts", "node", "n").distinct()
    signed = sharing.groupBy("node", "n").agg(F.max("bare").alias("bare"), F.collect_list("gram").alias("grams"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pivot, _, _, parts), held in _groups(batches, 4, 0):
            found = list(zip(*narrow(pivot, held, num, den, parts == 1), strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["pivot", "node", "n"])

    met = placed.join(signed, ["node", "n"]).select("pivot", "first", "last", "parts", "node", "n", "bare", "grams")
    met = met.repartition("pivot", "first", "last").sortWithinPartitions("pivot", "first", "last", "node")
    return met.mapInArrow(meet, "pivot long, node long, n long").distinct()


def with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` with the text of their node: texts are shuffled, which are smaller than sets and compress."""
    marks = bit_table(rows.select(F.xxhash64("node").alias("x")), "x", FILTER_BITS)
    texts = docs_bytes(docs).where("doc_id is not null")
    texts = with_bit(texts, F.xxhash64("doc_id"), marks, FILTER_BITS)
    return texts.select(F.col("doc_id").alias("node"), "text").join(rows, "node")


class Links:
    """Spanning links among rows of a block, by node id."""

    def __init__(self, nodes: np.ndarray) -> None:
        self.nodes, self.up = nodes, list(range(len(nodes)))
        self.found: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def add(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.found.append((int(self.nodes[i]), int(self.nodes[j])))


class Incidence:
    """Rows of one part, with postings per n-gram."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int64), self.sizes)
        grams = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.owner, grams = owner[order], grams[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
        self.grams, self.first = grams[first], np.append(first, len(grams))

    def product(self, row: np.ndarray) -> np.ndarray:
        """Overlap of one row with each row of the part: its n-grams' postings, accumulated."""
        if not len(self.grams):
            return np.zeros(len(self.sizes), np.int64)
        at = np.searchsorted(self.grams, row)
        at[at == len(self.grams)] = 0
        at = at[self.grams[at] == row]
        start, count = self.first[at], self.first[at + 1] - self.first[at]
        total = int(count.sum())
        if not total:
            return np.zeros(len(self.sizes), np.int64)
        inside = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        return np.bincount(self.owner[np.repeat(start, count) + inside], minlength=len(self.sizes))

    def linked(self, row: np.ndarray, num: int, den: int) -> np.ndarray:
        """Positions of the rows that the given row is linked with."""
        n, m = len(row), self.sizes
        if not (np.minimum(n, m) * den >= np.maximum(n, m) * num).any():
            return np.empty(0, np.int64)
        overlap = self.product(row)
        return np.flatnonzero((den * overlap >= num * (n + m - overlap)) & (overlap > 0))


def link_part(nodes: np.ndarray, sets: list[np.ndarray], pivot: int, num: int, den: int) -> tuple[list, list[int]]:
    """Spanning links of a part, and the nodes that the pivot's component does not hold."""
    part, links = Incidence(sets), Links(nodes)
    hub = next((i for i, x in enumerate(nodes.tolist()) if x == pivot), None)
    if hub is not None:
        for j in part.linked(sets[hub], num, den).tolist():
            links.add(hub, j)
    for i in range(len(sets)):
        if hub is None or links.root(i) != links.root(hub):
            for j in part.linked(sets[i], num, den).tolist():
                links.add(i, j)
    held = set() if hub is None else {i for i in range(len(sets)) if links.root(i) == links.root(hub)}
    return links.found, [int(nodes[i]) for i in range(len(sets)) if i not in held]


def _groups(batches: Iterator[pa.RecordBatch], keys: int, words: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns; the text, which is last, becomes its set (without `words`: is an array)."""
    key, held = None, []
    for b in batches:
        columns = [c.to_pylist() for c in b.columns[:-1]]
        last = b.column(b.num_columns - 1)
        if words:
            sets = (x for some in sets_of_texts(last, words) for x in some)
        else:
            sets = (x.values.to_numpy() for x in last)
        for *row, grams in zip(*columns, sets, strict=True):
            if tuple(row[:keys]) != key:
                if held:
                    yield key, held
                key, held = tuple(row[:keys]), []
            held.append((*row[keys:], grams))
    if held:
        yield key, held


def _sets(rows: list[tuple]) -> tuple[np.ndarray, list[np.ndarray]]:
    return np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]


FOUND = "a long, b long, open_part int"


def _found(edges: list[tuple], left_open: list[tuple]) -> pa.RecordBatch:
    rows = [(a, b, None) for a, b in edges] + left_open
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    kinds = (pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["a", "b", "open_part"])


def links(docs: DataFrame, members: DataFrame, words: int, num: int, den: int, block_rows: int) -> DataFrame:
    """(a, b): links that span every component within and across the blocks' parts."""
    sizes = members.groupBy("pivot").agg(F.count("*").alias("m"), F.sum("n").alias("grams"))
    most = F.greatest(F.col("m") / block_rows, F.col("grams") / BLOCK_GRAMS)
    parts = sizes.select("pivot", F.ceil(most).cast("int").alias("parts"))
    parts = materialise(parts, "parts")
    hot = hot_keys(members.groupBy("pivot").agg(F.count("*").alias("c")), "pivot")
    placed = join_spread(members, parts, "pivot", materialise(hot, "hot")).select(
        "pivot", "node", "parts", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("part")
    )
    placed = materialise(placed, "placed")
    everywhere = placed.where("node = pivot").select(  # the pivot stands in every part
        "pivot", "node", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    rows = with_text(docs, placed.where("node <> pivot").unionByName(everywhere))

    def parts_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pivot, part, parts), held in _groups(batches, 3, words):
            nodes, grams = _sets(held)
            edges, left = link_part(nodes, grams, pivot, num, den)
            yield _found(edges, [(pivot, x, part) for x in left] if parts > 1 else [])

    found = materialise(
        rows.select("pivot", "part", "parts", "node", "text")
        .repartition("pivot", "part")
        .sortWithinPartitions("pivot", "part", "node")
        .mapInArrow(parts_, FOUND),
        "found",
    )
    edges = found.where("open_part is null").select("a", "b")
    waiting = found.where("open_part is not null").select(
        F.col("a").alias("pivot"), F.col("b").alias("node"), F.col("open_part").alias("own")
    )
    if waiting.isEmpty():
        return edges
    # Open rows of a split block meet its other parts, OPEN_ROWS or so at a time.
    counts = waiting.groupBy("pivot").agg(F.ceil(F.count("*") / OPEN_ROWS).cast("int").alias("pieces"))
    plan = counts.join(parts, "pivot")
    asking = (
        waiting.join(plan, "pivot")
        .withColumn("piece", F.pmod(F.xxhash64("node", F.lit(2)), F.col("pieces")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where("part <> own")
        .select("pivot", "part", "piece", "node", F.lit(0).alias("side"))
    )
    asked = (
        placed.join(counts, "pivot")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select("pivot", "part", "piece", "node", F.lit(1).alias("side"))
    )

    def pieces_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(batches, 3, words):
            left = [r[1:] for r in held if r[0] == 0]
            right = [r[1:] for r in held if r[0] == 1]
            (a, mine), (b, others) = _sets(left), _sets(right)
            part, across = Incidence(others), Links(np.concatenate([a, b]))
            for i, row in enumerate(mine):
                for j in part.linked(row, num, den).tolist():
                    across.add(i, len(mine) + j)
            yield _found(across.found, [])

    more = (
        with_text(docs, asking.unionByName(asked))
        .select("pivot", "part", "piece", "side", "node", "text")
        .repartition("pivot", "part", "piece")
        .sortWithinPartitions("pivot", "part", "piece", "side", "node")
        .mapInArrow(pieces_, FOUND)
    )
    return edges.unionByName(more.select("a", "b"))


def jaccard_components(
    docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row.

    Two documents link when den * intersection >= num * union of their sets
    of word n-grams; component_id is the smallest doc_id that links reach.
    Words are runs of other than \\x20, \\x09-\\x0D, in lower case for A-Z; a
    text of fewer words has one n-gram, all of it.  A text without words, or
    null, has none and stands alone.  A null doc_id stands alone with a null
    component.  Rows that repeat a doc_id are judged each by its own text;
    texts whose smallest doc_id is the same count as linked.  Extra columns
    are not read; an empty table gives no rows.
    """
    rows = materialise(incidence(docs, words, num, den), "incidence")
    all_rows = rows.select("doc_id", "set_id", "n")
    usable = rows.where("doc_id is not null and n > 0")
    firsts = materialise(usable.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.count("*").alias("c")), "firsts")
    sharing, hot = sharing_rows(one_per_set(usable.where("least > 0"), firsts))
    all_rows = materialise(all_rows, "sets")
    discard(rows)  # signatures are the largest table
    wide = materialise(blocks(sharing, hot), "wide")
    members = materialise(narrowed(wide, sharing, num, den), "blocks")
    discard(sharing, wide)
    found = connected(links(docs, members, words, num, den, block_rows))
    of_set = firsts.join(found, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    return all_rows.join(of_set, "set_id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"),
    )


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs` that stand for their component (its smallest doc_id), unchanged.

    Rows without an id stay, as do texts without words.  Of rows that repeat
    a doc_id, all stay if that id stands for any of their texts' components.
    """
    found = jaccard_components(docs, words, num, den)
    stays = found.where("doc_id = component_id").select(F.col("doc_id").alias("__rq_id")).distinct()
    return docs.join(stays, docs["doc_id"] == stays["__rq_id"], "left_semi").unionByName(docs.where("doc_id is null"))
