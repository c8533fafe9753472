"""Scans: frames, exports, score passes, verdicts, lists and settings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import names
from ..operators.labels import SPLITS


class MissingInput(FileNotFoundError):
    """Nothing to read where something is needed."""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything that a glob stands for, exists in the session's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def _listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, modified) of files at any depth; contents are never read, since their column is not asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"))


def frames(spark: SparkSession, root: str, sep: str = names.DEFAULT_SEP, pattern: str = "*.jpg") -> DataFrame:
    """path, frame, dir, video, idx of every frame under root; none at all is an error."""
    if not exists(spark, root):
        raise MissingInput(f"no folder {root}")
    found = _listing(spark, root, pattern).withColumns(
        {"frame": names.basename("path"), "dir": F.element_at(F.split("path", "/"), -2)}
    )
    parsed = names.try_split("frame", sep)
    out = found.withColumns({"video": parsed["video"], "idx": parsed["idx"]})
    if out.isEmpty():
        raise MissingInput(f"no {pattern} under {root}")
    return out


def _per_split(spark: SparkSession, export: str, part: str, load, columns: str) -> DataFrame:
    out = spark.createDataFrame([], columns)
    for split in SPLITS:
        path = f"{export.rstrip('/')}/{split}/{part}"
        if exists(spark, path):
            out = out.unionByName(load(path).withColumn("split", F.lit(split)).select(*out.columns))
    return out


def videos(spark: SparkSession, folder: str, ext: str = "mp4") -> DataFrame:
    """path, video of the video files that lie in a folder itself, in the order of their paths; none at all is an error."""
    pattern = "*." + ext.lstrip(".")
    if not exists(spark, f"{folder.rstrip('/')}/{pattern}"):
        raise MissingInput(f"no {pattern} in {folder}")
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", names.stem("path").alias("video")).orderBy("path")


def stale_caches(spark: SparkSession, export: str) -> DataFrame:
    """path of every *.cache at any depth: a plan to delete, since a stale one would hide a changed export."""
    return _listing(spark, export, "*.cache").select("path")


def export_images(spark: SparkSession, export: str) -> DataFrame:
    """split, path, stem of the images of an export; splits that are not there give no rows."""
    return _per_split(
        spark, export, "images",
        lambda p: _listing(spark, p, "*.jpg").withColumn("stem", names.stem("path")),
        "split string, path string, stem string",
    )


def export_labels(spark: SparkSession, export: str) -> DataFrame:
    """split, path, stem, text of the label files of an export, one row per file."""

    def load(path: str) -> DataFrame:
        reader = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt")
        return reader.text(path).select(
            F.col("_metadata.file_path").alias("path"), names.stem("_metadata.file_path").alias("stem"), F.col("value").alias("text")
        )

    return _per_split(spark, export, "labels", load, "split string, path string, stem string, text string")


def score_passes(spark: SparkSession, folder: str) -> DataFrame:
    """All scores*.csv of a folder as passes: their columns, pass (file name) and row_no (order in the file)."""
    if not exists(spark, f"{folder}/scores*.csv"):
        raise MissingInput(f"no scores*.csv in {folder}")
    reader = spark.read.schema(schemas.SCORES).option("header", True).option("pathGlobFilter", "scores*.csv")
    return reader.csv(folder).select(
        "*", F.col("_metadata.file_name").alias("pass"),
        (F.col("_metadata.file_block_start") + F.monotonically_increasing_id()).alias("row_no"),
    )


def previous_scores(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise MissingInput(f"no scores at {path}")
    return spark.read.schema(schemas.SCORES).option("header", True).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise MissingInput(f"no manifest at {path}: make the sheets first")
    return spark.read.schema(schemas.MANIFEST).option("header", True).csv(path)


def verdict_names(spark: SparkSession, path: str) -> DataFrame:
    """name: trimmed lines, each once, without blanks; a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "name string")
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()


def whole_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row per file, for JSON documents of detections or events."""
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """url: trimmed lines, without blanks and comments; a line that would be read as an option is an error."""
    line = F.trim("value")
    safe: Column = F.when(
        F.startswith(line, F.lit("-")), F.raise_error(F.concat(F.lit("a url must not look like an option: "), line)).cast("string")
    ).otherwise(line)
    lines = spark.read.text(path).where((line != "") & ~F.startswith(line, F.lit("#")))
    return lines.select(safe.alias("url"))


def offsets(spark: SparkSession, path: str | None, pairs: list[str]) -> DataFrame:
    """video, offset: a JSON map, overridden by 'video=offset' pairs."""
    rows = []
    for pair in pairs:
        video, eq, value = pair.partition("=")
        if not eq or not re.fullmatch(r"\s*-?\d+\s*", value):
            raise ValueError(f"expected video=offset, got {pair!r}")
        rows.append((video, int(value), 1))
    out = spark.createDataFrame(rows, "video string, offset int, p int")
    if path:
        text = spark.read.option("wholetext", True).text(path)
        file = text.select(F.explode(F.from_json("value", "map<string,int>")).alias("video", "offset"))
        out = out.unionByName(file.withColumn("p", F.lit(0)))
    return out.groupBy("video").agg(F.max_by("offset", "p").alias("offset"))


def upload_layouts(spark: SparkSession, folder: str, split: str = "train", ext: str = "jpg") -> list[DataFrame]:
    """Layouts in order of priority: <split>/, <split>/images/, images/, loose files."""
    root, found = folder.rstrip("/"), []
    pattern = "*." + ext.lstrip(".")
    places = [(f"{root}/{s}{sub}", s) for sub in ("", "/images") for s in SPLITS]
    for path, of in [*places, (f"{root}/images", split), (root, split)]:
        if exists(spark, f"{path}/{pattern}"):
            listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
            found.append(listing.select(names.basename("path").alias("name"), "path", F.lit(of).alias("split")))
    return found


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pictures (`image` struct, BGR bytes); files that cannot be read have height -1."""
    return spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
