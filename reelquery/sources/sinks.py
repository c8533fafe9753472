"""Sinks: tables as files, verdict logs, and plans that are carried out file by file.

Changes to files are planned as DataFrames; an applier carries a plan out,
and a dry run is a plan that is not.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from .files import exists, verdict_names


def _one_file(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores in the order of video and index; the commit protocol stands for a partial file."""
    columns = ["frame", "video", "idx", "n_det", "max_conf"]
    _one_file(scores.select(*columns).orderBy("video", "idx", "frame"), path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    _one_file(manifest.select("sheet", "tile", "frame").orderBy("sheet", "tile"), path)


def append_saved(rows: DataFrame, path: str) -> None:
    """Log of saved frames; times and confidences are rounded as they are logged."""
    rows.withColumns({"seconds": F.round("seconds", 2), "max_conf": F.round("max_conf", 4)}).write.mode("append").option(
        "header", True
    ).csv(path)


def record_names(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Add names to a verdict list: written beside it, then put in its place, since a table cannot overwrite its source."""
    beside = f"{path}.{uuid.uuid4().hex}"
    merged = verdict_names(spark, path).union(new.select("name")).distinct().orderBy("name")
    merged.coalesce(1).write.text(beside)
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # The old list stays, under another name, until the new one is in its place.
    old = fs_path(f"{beside}.old")
    if exists(spark, path) and not fs.rename(fs_path(path), old):
        raise OSError(f"cannot put {path} aside")
    if not fs.rename(fs_path(beside), fs_path(path)):
        raise OSError(f"cannot put {beside} in the place of {path}")
    fs.delete(old, True)


def copy_plan(manifest: DataFrame, frames: DataFrame, dest: str, empty_labels: bool) -> DataFrame:
    """src, dst, label of what is collected; rows without a source have a null src.

    Manifest fields are not trusted: only base names reach a path.
    """
    there = frames.select("frame", F.col("path").alias("src"))
    base = names.basename("frame")
    label = F.concat(F.lit(f"{dest.rstrip('/')}/labels/"), names.stem("frame"), F.lit(".txt"))
    return manifest.withColumn("frame", base).join(there, "frame", "left").select(
        "frame", "src", F.concat(F.lit(f"{dest.rstrip('/')}/images/"), "frame").alias("dst"),
        (label if empty_labels else F.lit(None).cast("string")).alias("label"),
    )


def _absent(value: object) -> bool:
    """Whether a field is null: pandas gives None or a NaN."""
    return value is None or value != value


def _local(path: str) -> str:
    return path.removeprefix("file:")


def _copy(row: dict) -> None:
    if _absent(row["src"]):
        raise FileNotFoundError("no source")
    os.makedirs(os.path.dirname(_local(row["dst"])), exist_ok=True)
    shutil.copy2(_local(row["src"]), _local(row["dst"]))
    if not _absent(row["label"]):
        os.makedirs(os.path.dirname(_local(row["label"])), exist_ok=True)
        open(_local(row["label"]), "w").close()


def _rewrite(row: dict) -> None:
    """Writes beside the file and puts that in its place; a file without a new text is left as it is."""
    if _absent(row["text"]):
        raise ValueError("no text to write; the file stays as it is")
    path = _local(row["path"])
    beside = f"{path}.{uuid.uuid4().hex}"
    try:
        with open(beside, "w", encoding="utf-8") as f:
            f.write(row["text"])
        os.replace(beside, path)
    finally:
        if os.path.exists(beside):
            os.remove(beside)


def _move(row: dict) -> None:
    if os.path.exists(_local(row["src"])):
        os.makedirs(os.path.dirname(_local(row["dst"])), exist_ok=True)
        os.replace(_local(row["src"]), _local(row["dst"]))


def _delete(row: dict) -> None:
    if os.path.exists(_local(row["path"])):
        os.remove(_local(row["path"]))


ACTIONS: dict[str, Callable[[dict], None]] = {"copy": _copy, "rewrite": _rewrite, "move": _move, "delete": _delete}


def carry_out(plan: DataFrame, action: str) -> DataFrame:
    """Run a plan's rows on the executors, each on its own: ok and error per row; a failed row stops no other.

    A row without what its action needs (a null src, dst, path or text) fails
    and touches no file; a null label writes none.
    Paths must be on a file system that all executors share.
    """
    act = ACTIONS[action]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            errors = []
            for row in b.to_dict("records"):
                try:
                    act(row)
                    errors.append(None)
                except Exception as e:  # whatever fails, fails for its row alone
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pd.DataFrame({"ok": [e is None for e in errors], "error": pd.Series(errors, dtype=object)})

    return plan.mapInPandas(run, "ok boolean, error string")
