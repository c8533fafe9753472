"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text: each byte shifts the hash and
adds the byte's gear, so the hash depends on the last WINDOW bytes alone.  A
chunk ends where the hash's top bits are zero.  Boundaries are decided by
content, so an insertion moves none but those beside it, and equal passages
fall into equal chunks wherever they stand.

Chunks are deduplicated by digest: the earliest (doc_id, start) keeps the
chunk.  Repeated chunks that touch each other are joined to runs.  A run is
short of its repeat by part of a chunk at each end, so it is compared there
with the text that is kept and extended to the repeat's true ends.  Spans of
fewer than MIN_WORDS words are left alone, as are chunks without words.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, docs_bytes, hot_keys, join_spread, materialise

WINDOW = 16
#: A chunk ends at one byte in 2 ** CUT_BITS.
CUT_BITS = 5
#: Words of a whole span: repeats of over 50 words are to be found, stock phrases are not.
MIN_WORDS = 30
#: Words in whole chunks from which a run is extended.
RUN_WORDS = 4
#: Chunks at each end of a run that vote on the place it repeats.
VOTERS = 8
#: Bytes compared at each end: past the neighbouring chunk two texts differ, and chunks are 32 bytes on average.
CONTEXT = 1024
#: Bits of the filter that spares chunks found once from being shuffled again: a fixed size, 8 MB.
FILTER_BITS = 1 << 26
#: Bytes hashed at a time: a long text is worked off in pieces.
PIECE = 1 << 20

_GEARS = np.frombuffer(
    b"".join(xxhash.xxh3_64_digest(bytes([b]), seed=20) for b in range(256)), ">u8"
).astype(np.uint16)


def boundaries(text: bytes) -> np.ndarray:
    """Chunk ends (exclusive), the last one being the text's end; never inside a UTF-8 character."""
    raw = np.frombuffer(text, np.uint8)
    ends = []
    for first in range(0, len(raw), PIECE):
        back = min(first, WINDOW - 1)
        h = _GEARS[raw[first - back : first + PIECE]]
        # h[i] = sum of gear[i - k] << k: by doubling the number of bytes that each value covers.
        for step in (1, 2, 4, 8):
            h[step:] += h[:-step] << np.uint16(step) if len(h) > step else 0
        ends.append(np.flatnonzero(h[back:] >> np.uint16(16 - CUT_BITS) == 0) + first + 1)
    at = np.concatenate(ends) if ends else np.empty(0, np.int64)
    if len(at):
        inner = at[at < len(raw)]
        at = inner[(raw[inner] & 0xC0) != 0x80]
    return np.append(at, len(raw)) if len(raw) else at


CHUNKS = "doc_id long, start int, end int, words int, h long"


def chunks(docs: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """One row per chunk: place in code points, words that end in it, and a 64-bit digest.

    With `bits`, only chunks whose bit of the filter is set.  A span takes
    several chunks in a row, so a chance collision of digests makes none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _pieces(b):
                doc, start, end, words, digests = [], [], [], [], []
                for d, text in zip(ids, texts, strict=True):
                    cuts = boundaries(text)
                    raw = np.frombuffer(text, np.uint8)
                    points = np.cumsum((raw & 0xC0) != 0x80)
                    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
                    word_ends = np.cumsum(~white & np.append(white[1:], True))
                    to = cuts.tolist()
                    at = [0, *to[:-1]]
                    doc.append(np.full(len(to), d, np.int64))
                    end.append(points[cuts - 1])
                    start.append(np.append(0, points[cuts[:-1] - 1]))
                    words.append(np.diff(word_ends[cuts - 1], prepend=0))
                    digests += [xxhash.xxh3_64_intdigest(text[i:j]) for i, j in zip(at, to, strict=True)]
                if not doc:
                    continue
                h = np.array(digests, np.uint64).view(np.int64)
                columns = [np.concatenate(doc), *(np.concatenate(c).astype(np.int32) for c in (start, end, words)), h]
                if bits is not None:
                    bit = np.mod(h, FILTER_BITS)
                    kept = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    columns = [c[kept] for c in columns]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), [c.split()[0] for c in CHUNKS.split(", ")])

    return docs_bytes(docs).where("doc_id is not null and length(text) > 0").mapInArrow(run, CHUNKS)


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Rows of a batch, some megabytes of text at a time."""
    ids, texts, held = [], [], 0
    for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
        ids.append(d)
        texts.append(text.as_py())
        held += len(texts[-1])
        if held >= 4 * PIECE:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


RUNS = (
    "doc_id long, start int, end int, words int, "
    "left_doc long, left_pos int, right_doc long, right_pos int"
)


def _vote(kept: np.ndarray, shift: np.ndarray, weight: np.ndarray) -> tuple[int, int]:
    """The (document, shift) of most weight, the smallest of equal ones."""
    votes: dict[tuple[int, int], int] = {}
    for k, s, w in zip(kept.tolist(), shift.tolist(), weight.tolist(), strict=True):
        votes[k, s] = votes.get((k, s), 0) + w
    return min(votes, key=lambda v: (-votes[v], v))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of touching chunks, and the kept places that face their first and last chunks."""
    for b in batches:
        lists = b.column(1)
        flat = lists.flatten()
        start, end, words, kept, place = (
            flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64)
            for n in ("start", "end", "words", "kept", "kept_start")
        )
        doc = np.repeat(b.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
        out: list[list] = [[] for _ in range(8)]
        if len(doc):
            at = np.flatnonzero(np.append(True, (start[1:] != end[:-1]) | (doc[1:] != doc[:-1])))
            total = np.add.reduceat(words, at)
            until = np.append(at[1:], len(doc))
            for r in np.flatnonzero(total >= RUN_WORDS):
                i, j = int(at[r]), int(until[r])
                first, last = slice(i, min(j, i + VOTERS)), slice(max(i, j - VOTERS), j)
                left, right = (_vote(kept[e], place[e] - start[e], end[e] - start[e]) for e in (first, last))
                row = (doc[i], start[i], end[j - 1], total[r], left[0], start[i] + left[1], right[0], end[j - 1] + right[1])
                for column, value in zip(out, row, strict=True):
                    column.append(int(value))
        fields = [f.split() for f in RUNS.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64() if t == "long" else pa.int32()) for c, (_, t) in zip(out, fields, strict=True)],
            [n for n, _ in fields],
        )


ENDS = "doc_id long, pos int, left boolean, start int, end int, other_doc long, other_pos int, before binary, after binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each end asked for, with the text on its two sides as far as the neighbouring cut and a window beyond."""
    for b in batches:
        ids, texts, asked = (b.column(n) for n in ("doc_id", "text", "asked"))
        for d, text, asks in zip(ids.to_pylist(), texts, asked, strict=True):
            text, asks = text.as_py(), asks.as_py()
            cuts = np.append(0, boundaries(text))
            raw = np.frombuffer(text, np.uint8)
            at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            asks = [a for a in asks if 0 <= a["pos"] < len(at)]
            where = at[[a["pos"] for a in asks]] if asks else np.empty(0, np.int64)
            low = cuts[np.maximum(np.searchsorted(cuts, where, "left") - 1, 0)] - WINDOW
            high = cuts[np.minimum(np.searchsorted(cuts, where, "right"), len(cuts) - 1)] + WINDOW
            low = np.maximum(np.maximum(low, where - CONTEXT), 0).tolist()
            high = np.minimum(high, where + CONTEXT).tolist()
            for n in range(0, len(asks), 4096):
                some = asks[n : n + 4096]
                places = list(zip(low[n : n + 4096], where[n : n + 4096].tolist(), high[n : n + 4096], strict=True))
                names = [f.split()[0] for f in ENDS.split(", ")]
                columns = [
                    pa.array([d] * len(some), pa.int64()),
                    *(
                        pa.array([a[name] for a in some], t)
                        for name, t in zip(
                            names[1:7], (pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True
                        )
                    ),
                    pa.array([text[i:j] for i, j, _ in places], pa.binary()),
                    pa.array([text[j:k] for _, j, k in places], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)


_SPACE = frozenset(b" \t\n\v\f\r")


def _grown(left: bool, before: bytes, after: bytes, other_before: bytes, other_after: bytes) -> tuple[int, int]:
    """Code points and words by which an end moves outwards; none where the run's own text does not face it."""
    inner, outer = ((after, other_after), (before, other_before)) if left else ((before, other_before), (after, other_after))
    if left:
        outer = tuple(x[::-1] for x in outer)
    else:
        inner = tuple(x[::-1] for x in inner)
    if len(commonprefix(inner)) < max(1, min(map(len, inner)) - WINDOW):
        return 0, 0
    n = len(commonprefix(outer))
    if left:
        while n and before[len(before) - n] & 0xC0 == 0x80:
            n -= 1
        piece, rest = before[len(before) - n :], after
    else:
        while n and n < len(after) and after[n] & 0xC0 == 0x80:
            n -= 1
        piece, rest = after[:n], after[n:]
    follow = piece[1:] + (rest[:1] or b" ")
    words = sum(x not in _SPACE and y in _SPACE for x, y in zip(piece, follow, strict=False))
    return sum(x & 0xC0 != 0x80 for x in piece), words


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("left", "before", "after", "other_before", "other_after")
    for b in batches:
        moved = [_grown(*row) for row in zip(*(b.column(n).to_pylist() for n in names), strict=True)]
        left = b.column("left").to_pylist()
        chars = [m[0] for m in moved]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"), b.column("start"), b.column("end"),
                pa.array([c if x else 0 for c, x in zip(chars, left, strict=True)], pa.int32()),
                pa.array([0 if x else c for c, x in zip(chars, left, strict=True)], pa.int32()),
                pa.array([m[1] for m in moved], pa.int32()),
            ],
            ["doc_id", "start", "end", "before", "after", "more"],
        )


def _extended(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, start, end, before, after, more): code points and words that each end of a run gains."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("left", "boolean"), ("start", "int"), ("end", "int"))]

    def end(side: str, pos: str, left: bool) -> DataFrame:
        return runs.select(
            "doc_id", F.col(pos).alias("pos"), F.lit(left).alias("left"), "start", "end",
            F.col(f"{side}_doc").alias("other_doc"), F.col(f"{side}_pos").alias("other_pos"),
        )

    ends = end("left", "start", True).unionByName(end("right", "end", False))
    faced = ends.groupBy("other_doc", "other_pos").agg(F.count("*").alias("c"))
    faced = materialise(faced, "faced")
    hot = materialise(hot_keys(faced, "other_doc", "other_pos"), "hot")
    places = faced.select(
        F.col("other_doc").alias("doc_id"), F.col("other_pos").alias("pos"), *none,
        F.lit(None).cast("long").alias("other_doc"), F.lit(None).cast("int").alias("other_pos"),
    )
    # What a document is asked for is bounded by its text: its own ends, and each place of it once.
    ask = F.struct("pos", "left", "start", "end", "other_doc", "other_pos")
    asked = ends.unionByName(places).groupBy("doc_id").agg(F.collect_list(ask).alias("asked"))
    found = docs_bytes(docs).join(asked, "doc_id").mapInArrow(_contexts, ENDS)
    found = materialise(found, "ends")
    # Rows that repeat a doc_id are one document: of several texts at a place one is taken.
    place = found.where("other_doc is null").groupBy(F.col("doc_id").alias("other_doc"), F.col("pos").alias("other_pos"))
    place = place.agg(F.min(F.struct("before", "after")).alias("p")).select(
        "other_doc", "other_pos", F.col("p.before").alias("other_before"), F.col("p.after").alias("other_after")
    )
    met = join_spread(found.where("other_doc is not null").drop("pos"), place, ["other_doc", "other_pos"], hot)
    moved = met.mapInArrow(_extend, "doc_id long, start int, end int, before int, after int, more int")
    each = moved.groupBy("doc_id", "start", "end", (F.col("before") > 0).alias("side"))
    best = each.agg(F.max(F.struct("before", "after", "more")).alias("m"))
    return best.select("doc_id", "start", "end", "m.*")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end, words, kept_doc_id: spans of text that stand in an earlier place too.

    Positions are code points, end exclusive; kept_doc_id is the document that
    keeps most of the span's first chunks (the document itself, where it
    repeats its own text).  Of equal chunks the one in the smallest doc_id at
    the smallest start is kept; rows that repeat a doc_id count as one
    document, of which equal chunks in equal places are one.  A span goes on
    to both sides as far as the text does that it repeats, CONTEXT bytes at
    most; spans of one document that repeat different places may overlap.
    Null or empty texts and rows with a null doc_id have no spans; extra
    columns are not read; an empty table gives no rows.
    """
    # Earliest document first, then the earliest place in it: long buffers, so both aggregate before the shuffle.
    repeated = chunks(docs).groupBy("h").agg(F.min("doc_id").alias("kept"), F.count("*").alias("c")).where("c > 1")
    repeated = materialise(repeated, "repeated")
    # A chunk that very many documents hold meets its earliest place by a broadcast.
    hot = materialise(hot_keys(repeated, "h"), "hot")
    repeated = repeated.select("h", "kept")
    bits = bit_filter(repeated, "h", FILTER_BITS)
    met = materialise(join_spread(chunks(docs, bits), repeated, "h", hot), "met")
    places = met.where("doc_id = kept").groupBy("h").agg(F.min("start").alias("kept_start"))
    met = join_spread(met, places, "h", hot).where("doc_id <> kept or start <> kept_start")
    # Runs of touching chunks: a document's repeated chunks in one row, bounded by its text.
    one = F.struct("start", "end", "words", "kept", "kept_start")
    held = met.groupBy("doc_id").agg(F.array_sort(F.collect_set(one)).alias("c"))
    runs = materialise(held.mapInArrow(_runs, RUNS), "runs")
    whole = runs.select("doc_id", "start", "end", F.col("left_doc").alias("kept_doc_id"), "words")
    more = _extended(docs, runs).withColumn("kept_doc_id", F.lit(None).cast("long")).withColumn("words", F.lit(0))
    both = whole.withColumns({n: F.lit(0) for n in ("before", "after", "more")}).unionByName(more)
    spans = both.groupBy("doc_id", "start", "end").agg(
        F.max("kept_doc_id").alias("kept_doc_id"), F.sum("before").alias("before"), F.sum("after").alias("after"),
        (F.max("words") + F.sum("more")).cast("int").alias("words"),
    )
    return spans.where(F.col("words") >= min_words).select(
        "doc_id", (F.col("start") - F.col("before")).cast("int").alias("start"),
        (F.col("end") + F.col("after")).cast("int").alias("end"), "words", "kept_doc_id",
    )
