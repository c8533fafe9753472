"""Streaming forms: new files only, scores per batch, and per-video tracking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import names


def new_frames(spark: SparkSession, root: str, sep: str = names.DEFAULT_SEP) -> DataFrame:
    """A stream of frames as they arrive; the checkpoint remembers which were seen."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.jpg")
        .load(root)
        .select("path", F.col("modificationTime").alias("modified"))
    )
    parsed = names.try_split(names.basename("path"), sep)
    return files.withColumns({"frame": names.basename("path"), "video": parsed["video"], "idx": parsed["idx"]})


def skip_done(new: DataFrame, done: DataFrame, key: str = "video") -> DataFrame:
    """Batch form: rows whose key has no output yet."""
    return new.join(done.select(key).distinct(), key, "left_anti")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work off what has arrived, batch by batch, and stop."""
    query = (
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


TRACKED = "video string, frame long, det int, track_id long"
STATE = "next_id long, last array<struct<x:double,y:double,id:long>>"


def link(last: list[tuple[float, float, int]], points: list[tuple[float, float]], next_id: int, reach: float) -> tuple[list[int], int]:
    """Ids for the points of a frame: the nearest unused last point within reach, else a new id."""
    pairs = sorted(
        ((x - a) ** 2 + (y - b) ** 2, i, j) for i, (x, y) in enumerate(points) for j, (a, b, _) in enumerate(last)
    )
    ids: dict[int, int] = {}
    used: set[int] = set()
    for dist, i, j in pairs:
        if dist <= reach * reach and i not in ids and j not in used:
            ids[i] = last[j][2]
            used.add(j)
    for i in range(len(points)):
        if i not in ids:
            ids[i], next_id = next_id, next_id + 1
    return [ids[i] for i in range(len(points))], next_id


def tracker(reach: float = 50.0) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """State function: ids persist over the frames of one video."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_id, last = state.get if state.exists else (1, [])
        last = [(p["x"], p["y"], p["id"]) if isinstance(p, dict) else (p[0], p[1], p[2]) for p in (last if last is not None else [])]
        rows = pd.concat(list(batches)).sort_values(["frame", "det"])
        out = []
        for frame, part in rows.groupby("frame", sort=True):
            points = list(zip(part["x"], part["y"], strict=True))
            ids, next_id = link(last, points, int(next_id), reach)
            last = [(x, y, i) for (x, y), i in zip(points, ids, strict=True)]
            out += [(key[0], int(frame), int(d), i) for d, i in zip(part["det"], ids, strict=True)]
        state.update((int(next_id), [{"x": float(x), "y": float(y), "id": int(i)} for x, y, i in last]))
        yield pd.DataFrame(out, columns=["video", "frame", "det", "track_id"])

    return step


def track(detections: DataFrame, reach: float = 50.0) -> DataFrame:
    """Streaming: video, frame, det, x, y -> track_id, with state per video."""
    return detections.groupBy("video").applyInPandasWithState(
        tracker(reach), TRACKED, STATE, "append", GroupStateTimeout.NoTimeout
    )


def track_batch(detections: DataFrame, reach: float = 50.0) -> DataFrame:
    """Batch form of `track`: one video at a time in order of its frames."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        last: list[tuple[float, float, int]] = []
        next_id, out = 1, []
        for frame, part in rows.sort_values(["frame", "det"]).groupby("frame", sort=True):
            points = list(zip(part["x"], part["y"], strict=True))
            ids, next_id = link(last, points, next_id, reach)
            last = [(x, y, i) for (x, y), i in zip(points, ids, strict=True)]
            out += [(key[0], int(frame), int(d), i) for d, i in zip(part["det"], ids, strict=True)]
        return pd.DataFrame(out, columns=["video", "frame", "det", "track_id"])

    return detections.groupBy("video").applyInPandas(run, TRACKED)
