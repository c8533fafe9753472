"""Selection of background and positive candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_CONF = 0.35
EDGE_TRIM = 20
MAX_FLAT = 0.3


def background(rows: DataFrame) -> DataFrame:
    return rows.where("n_det = 0")


def positive(rows: DataFrame, min_conf: float = MIN_CONF) -> DataFrame:
    """max_conf at least min_conf; NaN is no confidence."""
    return rows.where((F.col("max_conf") >= min_conf) & ~F.isnan("max_conf"))


def spans(on_disk: DataFrame) -> DataFrame:
    """First and last index of each video over the frames on disk: video, lo, hi."""
    return on_disk.where("idx is not null").groupBy("video").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))


def edge_trim(rows: DataFrame, on_disk: DataFrame, trim: int = EDGE_TRIM) -> DataFrame:
    """Rows at least `trim` frames inside their video's span; rows without a span go; 0 trims nothing."""
    if trim == 0:
        return rows
    inside = F.col("idx").between(F.col("lo") + trim, F.col("hi") - trim)
    return rows.join(spans(on_disk), "video").where(inside).drop("lo", "hi")


def not_flat(rows: DataFrame, max_flat: float = MAX_FLAT) -> DataFrame:
    """Rows with flatness at most max_flat; unknown flatness counts as 1.0; 1.0 or more keeps all."""
    if max_flat >= 1.0:
        return rows
    return rows.where(F.coalesce("flatness", F.lit(1.0)) <= max_flat)


def in_order(rows: DataFrame, limit: int = 0) -> DataFrame:
    """By video and index, frame names deciding ties; a limit of 0 is none."""
    ordered = rows.orderBy("video", "idx", "frame")
    return ordered.limit(limit) if limit else ordered


def flatness(blocks: DataFrame, key: str, threshold: float) -> DataFrame:
    """Share of blocks whose population deviation is below the threshold.

    Input: key, block, value.
    """
    per = blocks.groupBy(key, "block").agg(F.stddev_pop("value").alias("sd"))
    return per.groupBy(key).agg(F.avg((F.col("sd") < threshold).cast("double")).alias("flatness"))
