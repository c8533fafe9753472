"""Detector passes: per-frame scores, merging, labelled neighbourhoods, rescoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONF_FLOOR = 0.05
WINDOW = 2


def score_frames(frames: DataFrame, detections: DataFrame, conf: float = CONF_FLOOR, on: str = "frame") -> DataFrame:
    """n_det and max_conf (4 places, 0.0 if none) for every frame; detections: `on`, conf."""
    kept = detections.where((F.col("conf") >= conf) & ~F.isnan("conf"))
    per = kept.groupBy(on).agg(F.count("*").alias("n_det"), F.max("conf").alias("max_conf"))
    return frames.join(per, on, "left").withColumns(
        {"n_det": F.coalesce("n_det", F.lit(0)), "max_conf": F.coalesce(F.round("max_conf", 4), F.lit(0.0))}
    )


def merge_passes(passes: DataFrame) -> DataFrame:
    """One row per frame over all passes: a frame is empty only if every pass says so.

    Input: frame, video, idx, n_det, max_conf, pass, row_no.  video and idx
    come from the first pass, in the order of pass and row_no.
    """
    first = F.min_by(F.struct("video", "idx"), F.struct("pass", "row_no"))
    return (
        passes.groupBy("frame")
        .agg(first.alias("f"), F.max("n_det").alias("n_det"), F.max("max_conf").alias("max_conf"), F.count("*").alias("passes"))
        .select("frame", "f.video", "f.idx", "n_det", "max_conf", "passes")
    )


def empty_share(scores: DataFrame) -> DataFrame:
    """total, empty, percent."""
    return scores.agg(F.count("*").alias("total"), F.count_if(F.col("n_det") == 0).alias("empty")).withColumn(
        "percent", 100.0 * F.col("empty") / F.greatest("total", F.lit(1))
    )


def labelled_frames(names: DataFrame) -> DataFrame:
    """Distinct (video, idx) of a table with those columns, without nulls."""
    return names.select("video", "idx").dropna().distinct()


def exclude_labelled(frames: DataFrame, labelled: DataFrame, window: int = WINDOW) -> DataFrame:
    """Frames farther than `window` from each labelled frame of their video; unparsed names stay.

    The band becomes an equi-join: each labelled frame stands for its
    2 * window + 1 neighbours.
    """
    if window < 0:
        return frames
    near = labelled.select("video", F.explode(F.sequence(F.col("idx") - window, F.col("idx") + window)).alias("idx"))
    return frames.join(near, ["video", "idx"], "left_anti")


def rescore_candidates(frames: DataFrame, previous: DataFrame) -> DataFrame:
    """Frames that an earlier pass called empty."""
    return frames.join(previous.where("n_det = 0").select("frame"), "frame", "left_semi")
