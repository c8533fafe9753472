"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer weights (term = component).  Candidate
rows are laid out in blocks as postings per term; a block of queries scatters
each of its terms' weighted postings into a dense array of scores, one term
after the other.  Postings of most rows are laid out over all rows, zeros
included, so that they are added in order, and scores have the narrowest type
that holds every sum.  Each block keeps its best rows by partition selection,
and the blocks' lists are merged.

Blocks of candidates meet blocks of queries: both have a fixed size, so no
task holds more than one of each, whatever the tables' sizes.  All pairs are
scored: the work grows as queries times candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import P

CANDIDATES_PER_BLOCK = 16_384
QUERIES_PER_BLOCK = 16_384
#: Scores held at a time: queries x candidates, so that they stay in cache.
QUERIES_AT_ONCE = 16
#: Postings of one row in so many, or more, are laid out over all rows: adding in order costs less than scattering.
FULL_FROM = 16

TOP = "qid long, sid long, self_score long, copies long, vec_id long, score long"


def quantised(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows with a null or non-finite component go."""
    x = F.col(vector).cast("array<double>")
    return (
        vectors.select(F.col(key).cast("long").alias("id"), x.alias("v"))
        .where(F.col("v").isNotNull() & F.col("id").isNotNull())
        .where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
        .select("id", F.transform("v", lambda e: F.lit(float(scale)) * e).alias("v"))
        .where(F.forall("v", lambda e: F.abs(e) < float("inf")))
        # A double of 2^52 or more is whole, and beyond a long it has no floor.
        .select("id", F.transform("v", lambda e: F.when(F.abs(e) < 2.0**52, F.floor(e).cast("double")).otherwise(e)).alias("v"))
    )


def _packed(rows: DataFrame) -> DataFrame:
    """Adds narrow, the weights in 16 bits each, or wide, the weights as doubles, where one does not fit; the other is null."""
    fits = F.coalesce((F.array_max("v") < 2.0**15) & (F.array_min("v") >= -(2.0**15)), F.lit(True))
    return rows.withColumns({
        "narrow": F.when(fits, F.col("v").cast("array<smallint>")),
        "wide": F.when(~fits, F.col("v")),
    })


def _weights(rows: pa.Table) -> np.ndarray:
    """rows x terms; int64, or Python integers where a weight or a score could leave 63 bits."""
    parts = [rows[x].combine_chunks() for x in ("narrow", "wide")]
    lengths = [x.value_lengths().fill_null(0).to_numpy() for x in parts]
    dense = np.zeros((len(rows), max(x.max(initial=0) for x in lengths)))
    for part, length in zip(parts, lengths, strict=True):
        dense[np.arange(dense.shape[1]) < length[:, None]] = part.flatten().to_numpy()
    if dense.size and np.abs(dense).max() ** 2 * dense.shape[1] >= 2**62:
        return np.vectorize(int, otypes=[object])(dense)
    return dense.astype(np.int64)


def _score_type(q: np.ndarray, c: np.ndarray) -> type:
    """The narrowest type for weights, products and sums: no sum of some terms' products exceeds the product of the norms."""
    if q.dtype == object or c.dtype == object:
        return object
    squares = [int(np.einsum("ij,ij->i", x, x).max(initial=0)) for x in (q, c)]
    bound = max(math.isqrt(squares[0] * squares[1]), *map(math.isqrt, squares)) + 1
    return next((kind for kind, bits in ((np.int16, 15), (np.int32, 31), (np.int64, 62)) if bound < 2**bits), object)


def _best(row: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores; of equal ones at the end, the earliest."""
    n = len(row)
    if n <= k:
        return np.arange(n)
    # numpy partitions 32 bits faster than 16.
    floor = np.partition(row.astype(np.int32) if row.dtype == np.int16 else row, n - k)[n - k]
    kept = np.flatnonzero(row >= floor)
    if len(kept) > k:
        above = row[kept] > floor
        kept = np.concatenate([kept[above], kept[~above][: k - np.count_nonzero(above)]])
    return kept


def best_of_block(q: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query row: positions of its k best candidate rows and their scores.

    Candidates stand in the order of their ids; equal scores go to the earlier.
    """
    terms = min(q.shape[1], c.shape[1]) if q.size and c.size else 0
    q, c = q[:, :terms], c[:, :terms]
    kind = _score_type(q, c)
    q, c = q.astype(kind), c.astype(kind)
    n = len(c)
    postings = []
    for t in range(terms):
        at = np.flatnonzero(c[:, t])
        at = slice(None) if len(at) * FULL_FROM >= n else at
        postings.append((at, np.ascontiguousarray(c[at, t])))
    held, product = np.empty((2, min(QUERIES_AT_ONCE, len(q)), n), kind)
    for first in range(0, len(q), QUERIES_AT_ONCE):
        part = q[first : first + QUERIES_AT_ONCE]
        scores, products = held[: len(part)], product[: len(part)]
        scores[:] = 0
        for t, (at, weights) in enumerate(postings):
            asking = np.flatnonzero(part[:, t])
            if 2 * len(asking) >= len(part) and isinstance(at, slice):
                np.multiply(part[:, t, None], weights, out=products)
                scores += products
            else:
                for i in asking:
                    scores[i, at] += part[i, t] * weights
        for i, row in enumerate(scores):
            kept = _best(row, k)
            yield first + i, kept, row[kept]


def top_k(
    vectors: DataFrame,
    k: int = 20,
    scale: float = 64.0,
    every: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows by integer inner product of floor(scale * x).

    Queries are the rows whose key is divisible by `every`; each leaves out
    its own row.  Vectors that are null or hold null or non-finite components
    take no part, nor do rows with a null key.  Vectors of unequal length meet
    on their common terms.  Equal scores go to the smaller id.  A repeated
    row is a candidate each time and a query each time: its answer stands once
    per copy.  A score beyond a long is set to the nearest long.  Extra columns
    are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = quantised(vectors, key, vector, scale)
    queries = _packed(rows.where(F.col("id") % every == 0).groupBy("id", "v").agg(F.count("*").alias("copies")))
    counts = vectors.agg(
        F.count("*").alias("n"), F.count(F.when(F.col(key) % every == 0, 1)).alias("q")
    ).first()
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    c_blocks = max(-(-counts["n"] // CANDIDATES_PER_BLOCK), min(wide, -(-counts["n"] // 2048)), 1)
    q_blocks = max(-(-counts["q"] // QUERIES_PER_BLOCK), 1)
    # Each side is dealt by a hash of the row, once per block of the other side.
    left = _packed(rows).select(
        (F.pmod(F.xxhash64("id", "v"), F.lit(c_blocks))).cast("int").alias("cb"),
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"),
        "id", "narrow", "wide",
    )
    right = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"),
        (F.pmod(F.xxhash64("id", "v"), F.lit(q_blocks))).cast("int").alias("qb"),
        # Tells apart query rows of one id.
        F.xxhash64("v").alias("sid"), "id", "narrow", "wide", "copies",
    )

    names = [c.split()[0] for c in TOP.split(", ")]

    def block(_, c: pa.Table, q: pa.Table) -> pa.Table:
        columns = [np.empty(0, np.int64)] * len(names)
        if len(c) and len(q):
            c = c.sort_by("id")
            cw, qw = _weights(c), _weights(q)
            asked = q["id"].to_numpy(), q["sid"].to_numpy(), self_scores(qw), q["copies"].to_numpy()
            rows, at, scores = zip(*best_of_block(qw, cw, k + 1), strict=True)
            of = np.repeat(rows, [len(x) for x in at])
            columns = [*(x[of] for x in asked), c["id"].to_numpy()[np.concatenate(at)], as_long(np.concatenate(scores))]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(block, TOP)
    ask = Window.partitionBy("qid", "sid")
    order = [F.desc("score"), F.asc("vec_id")]
    own = (F.col("vec_id") == F.col("qid")) & (F.col("score") == F.col("self_score"))
    ranked = (
        found.withColumn("rn", F.row_number().over(ask.orderBy(*order)))
        .where(F.col("rn") <= k + 1)
        # The query's own row is one of those with its id and its own score; which of them does not matter.
        .withColumn("own_rn", F.min(F.when(own, F.col("rn"))).over(ask))
        .where(F.col("own_rn").isNull() | (F.col("rn") != F.col("own_rn")))
        .withColumn("rank", F.col("rn") - F.when(F.col("rn") > F.col("own_rn"), 1).otherwise(0))
        .where(F.col("rank") <= k)
    )
    return ranked.withColumn(
        P + "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    ).select(F.col("qid").alias("query_id"), F.col("rank").cast("int"), "vec_id", F.col("score").cast("long"))


def as_long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype != object:
        return scores.astype(np.int64)
    return np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in scores], np.int64)


def self_scores(rows: np.ndarray) -> np.ndarray:
    if rows.dtype != object:
        return np.einsum("ij,ij->i", rows, rows)
    return as_long(np.array([sum(x * x for x in row) for row in rows], object))
