"""Stratified sampling: round-robin over videos, spread over each timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def subsample(frames: DataFrame, n: int) -> DataFrame:
    """Up to n frames (frame, video, idx), in the order of frame names.

    Each video is walked with the stride max(1, its frames * videos / n); the
    k-th pick is at the integer part of a running sum of strides.  Picks go
    round by round over the videos in order.  Short videos are not topped up
    by others, so fewer than n rows may come.
    """
    video = F.coalesce("video", F.lit(""))
    base = frames.withColumn("__rq_video", video)
    sizes = base.groupBy("__rq_video").agg(F.count("*").alias("size"))
    videos = sizes.agg(F.count("*").alias("videos"))
    # A video's picks are at most n, whatever its size.
    stride = F.greatest(F.lit(1.0), F.col("size") * F.col("videos") / F.lit(float(n)))
    rounds = F.least(F.ceil(F.col("size") / F.col("stride")), F.lit(n)).cast("int")
    steps = F.aggregate(
        F.sequence(F.lit(0), F.col("rounds")),
        F.struct(F.lit(0.0).alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda a, _: F.struct(
            (a["at"] + F.col("stride")).alias("at"), F.array_append(a["out"], F.floor(a["at"])).alias("out")
        ),
        lambda a: a["out"],
    )
    picks = (
        sizes.join(F.broadcast(videos))  # one row
        .withColumn("stride", stride)
        .withColumn("rounds", rounds)
        .select("__rq_video", "size", F.posexplode(steps).alias("k", "place"))
        .where(F.col("place") < F.col("size"))
        .orderBy("k", "__rq_video")
        .limit(n)
    )
    by_time = Window.partitionBy("__rq_video").orderBy(F.coalesce("idx", F.lit(0)), "frame")
    placed = base.withColumn("place", (F.row_number().over(by_time) - 1).cast("bigint"))
    return placed.join(picks.select("__rq_video", "place"), ["__rq_video", "place"], "left_semi").select(
        *frames.columns
    ).orderBy("frame")
