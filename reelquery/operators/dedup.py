"""Near-duplicates across splits by mean absolute difference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from .labels import split_rank

THRESHOLD = 0.05
#: Vectors and bytes of a block, at most.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 23
#: Vectors whose distances bound those of all others.
PIVOTS = 4
#: Components that are summed before a pair may be given up.
EARLY = 16


def mean_abs_diff(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(a)


def _packed(items: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """One row per block: block, split, rank, size, ids, data, and the range of its vectors' distances to each pivot.

    Blocks hold vectors of one split and length in the order of their distance
    to the first pivot, so that ranges are narrow where distances differ.
    """
    rank = split_rank(F.col("split"))
    clean = items.select("id", "split", rank.alias("rank"), F.col("v").cast("array<double>").alias("v"))
    clean = clean.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    first = F.lit([float(x) for x in pivots[0]]) if pivots else F.array()
    near = F.when(F.size("v") == F.size(first), mean_abs_diff(F.col("v"), first)) if pivots else F.lit(0.0)
    clean = clean.withColumns({"size": F.size("v"), "at": near})
    id_type = clean.schema["id"].dataType
    rows = clean.repartitionByRange("rank", "split", "size", "at").sortWithinPartitions("rank", "split", "size", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def row() -> pa.RecordBatch:
            data = np.array([v for _, v in held], np.float64).reshape(len(held), -1)
            low, high = [], []
            for p in pivots:
                d = np.abs(data - p).mean(1) if len(p) == key[2] and key[2] else np.zeros(1)
                low.append(float(d.min()))
                high.append(float(d.max()))
            rank_, split, size = key
            ids = pa.array([[i for i, _ in held]], pa.list_(id_kind))
            columns = [
                pa.array([split], pa.string()), pa.array([rank_], pa.int32()), pa.array([size], pa.int32()), ids,
                pa.array([data.tobytes()], pa.binary()), pa.array([low], pa.list_(pa.float64())), pa.array([high], pa.list_(pa.float64())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["split", "rank", "size", "ids", "data", "low", "high"])

        id_kind = pa.int64()
        for b in batches:
            id_kind = b.column(0).type
            for i, split, rank_, v, size in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if held and (key != (rank_, split, size) or len(held) >= min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * max(size, 1))))):
                    yield row()
                    held = []
                key = (rank_, split, size)
                held.append((i, v))
        if held:
            yield row()

    schema = f"split string, rank int, size int, ids array<{id_type.simpleString()}>, data binary, low array<double>, high array<double>"
    packed = rows.select("id", "split", F.col("rank").cast("int"), "v", "size").mapInArrow(run, schema)
    return written(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _pairs_within(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of a, rows of b, differences) below the threshold; most pairs are given up after a few components."""
    size = a.shape[1]
    limit = threshold * size
    for i, x in enumerate(a):
        some = np.flatnonzero(np.abs(b[:, :EARLY] - x[:EARLY]).sum(1) < limit * (1 + 1e-9) + 1e-9)
        if len(some):
            # A running sum adds in the order of the components.
            diff = np.add.accumulate(np.abs(b[some] - x), axis=1)[:, -1] / size
            hit = diff < threshold
            if hit.any():
                yield i, some[hit], diff[hit]


def near_duplicates(items: DataFrame, threshold: float = THRESHOLD, across: bool = True) -> DataFrame:
    """(a_id, b_id, a_split, b_split, diff) with diff below the threshold, a before b in (split, id) order.

    Input: id, split, v.  Vectors are packed into blocks of one split, and a
    block meets blocks of other splits only (of its own as well, without
    `across`).  Mean absolute differences obey the triangle inequality, so
    blocks whose distances to a pivot lie further apart than the threshold do
    not meet; where all distances are alike, all of them do.  Vectors with a
    null or NaN, of other lengths, or empty take no part with one another.
    """
    chosen = items.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).select("v")
    chosen = chosen.orderBy(F.xxhash64("v"), "v").limit(PIVOTS).collect()
    packed = _packed(items, [np.array(r["v"], np.float64) for r in chosen])
    place = F.struct("rank", "split", "block")
    outline = packed.where("size > 0").select("block", "rank", "split", "size", "low", "high", place.alias("place"))
    a = outline.select(*[F.col(c).alias("a_" + c) for c in outline.columns])
    b = outline.select(*[F.col(c).alias("b_" + c) for c in outline.columns])
    apart = F.exists(
        F.arrays_zip("a_low", "a_high", "b_low", "b_high"),
        lambda r: (r["a_low"] - r["b_high"] > threshold * 1.000001) | (r["b_low"] - r["a_high"] > threshold * 1.000001),
    )
    order = F.col("a_place") < F.col("b_place") if across else F.col("a_place") <= F.col("b_place")
    cells = a.join(b, (F.col("a_size") == F.col("b_size")) & order).where(~apart)
    if across:
        cells = cells.where("a_split <> b_split")
    data = packed.select("block", "split", "size", "ids", "data")
    left = data.select(*[F.col(c).alias("a_" + c) for c in data.columns])
    right = data.select(*[F.col(c).alias("b_" + c) for c in ("block", "split", "ids", "data")])
    met = cells.select("a_block", "b_block").join(left, "a_block").join(right, "b_block")
    id_type = packed.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                r = {n: batch.column(j)[k] for j, n in enumerate(batch.schema.names)}
                size = r["a_size"].as_py()
                x, y = (np.frombuffer(r[c].as_py(), np.float64).reshape(-1, size) for c in ("a_data", "b_data"))
                a_ids, b_ids = r["a_ids"].as_py(), r["b_ids"].as_py()
                a_split, b_split = r["a_split"].as_py(), r["b_split"].as_py()
                same, rows = r["a_block"] == r["b_block"], []
                for i, js, diff in _pairs_within(x, y, threshold):
                    for j, d in zip(js.tolist(), diff.tolist(), strict=True):
                        one, two = a_ids[i], b_ids[j]
                        if same and i >= j:
                            continue
                        if a_split == b_split and one > two:
                            one, two = two, one
                        if a_split != b_split or one != two:
                            rows.append((one, two, a_split, b_split, d))
                kinds = (batch.schema.field("a_ids").type.value_type,) * 2 + (pa.string(), pa.string(), pa.float64())
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["a_id", "b_id", "a_split", "b_split", "diff"]
                )

    names = ("a_block", "b_block", "a_size", "a_split", "b_split", "a_ids", "b_ids", "a_data", "b_data")
    return met.select(*names).mapInArrow(run, f"a_id {id_type}, b_id {id_type}, a_split string, b_split string, diff double")


def moves(pairs: DataFrame) -> DataFrame:
    """(id, from_split, n_pairs): the later copy of each pair goes to train.

    One pass over pairs in order, as a repair run does it: of a pair between
    the two evaluation splits the later copy moves, so a second run may still
    find the earlier one; `settled` goes on to the end.
    """
    return pairs.groupBy(F.col("b_id").alias("id"), F.col("b_split").alias("from_split")).agg(F.count("*").alias("n_pairs"))


def settled(pairs: DataFrame) -> DataFrame:
    """(id, from_split): all evaluation copies of any pair, which is where repeated runs end."""
    both = pairs.select(F.col("a_id").alias("id"), F.col("a_split").alias("from_split")).union(pairs.select("b_id", "b_split"))
    return both.where("from_split <> 'train'").distinct()
