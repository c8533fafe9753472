"""Label rows: boxes, polygons, and repairs of an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "valid", "test")
GRAPHICS_FLATNESS = 0.30


def rows_of(text: Column) -> Column:
    """Fields of each row that is not blank."""
    rows = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda r: F.trim(F.regexp_replace(r, r"\s+", " ")))
    return F.transform(F.filter(rows, lambda r: r != ""), lambda r: F.split(r, " "))


def bbox(points: Column) -> Column:
    """struct(cx, cy, w, h) around interleaved x, y; null for an odd number of values."""
    xs = F.filter(points, lambda _, i: i % 2 == 0)
    ys = F.filter(points, lambda _, i: i % 2 == 1)
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    box = F.struct(
        ((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), (x1 - x0).alias("w"), (y1 - y0).alias("h")
    )
    return F.when((F.size(points) % 2 == 0) & (F.size(points) > 0), box)


def polygon_to_bbox(fields: Column) -> Column:
    """A polygon row as a box row of 6 decimals; null where the coordinates do not pair up."""
    points = F.transform(F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))), lambda v: v.cast("double"))
    b = bbox(points)
    return F.format_string("%s %.6f %.6f %.6f %.6f", fields[0], b["cx"], b["cy"], b["w"], b["h"])


def is_polygon(fields: Column) -> Column:
    return F.size(fields) > 5


def repair_labels(labels: DataFrame) -> DataFrame:
    """Rewrites of label files that hold polygons: the input's keys, n_polygons, text.

    Input: text, and any keys.  Files without a polygon are not returned; a
    polygon that cannot be read makes `text` null, so nothing is overwritten.
    """
    rows = labels.withColumn("__rq_rows", rows_of(F.col("text")))
    found = rows.where(F.exists("__rq_rows", is_polygon))
    fixed = F.transform(
        "__rq_rows",
        lambda r: F.when(is_polygon(r), F.when(F.size(r) % 2 == 1, polygon_to_bbox(r))).otherwise(F.array_join(r, " ")),
    )
    whole = F.when(F.forall(fixed, lambda r: r.isNotNull()), F.concat(F.array_join(fixed, "\n"), F.lit("\n")))
    return found.select(
        *[c for c in labels.columns if c != "text"],
        F.size(F.filter("__rq_rows", is_polygon)).alias("n_polygons"),
        whole.alias("text"),
    )


def zero_box(images: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """Images whose label file is missing or holds no row."""
    counts = labels.select(*on, F.size(rows_of(F.col("text"))).alias("n_boxes"))
    return images.join(counts, on, "left").where(F.coalesce("n_boxes", F.lit(0)) == 0).drop("n_boxes")


def graphics_to_drop(empty: DataFrame, threshold: float = GRAPHICS_FLATNESS) -> DataFrame:
    """Images without boxes that are flatter than the threshold."""
    return empty.where(F.col("flatness") > threshold)


def split_rank(split: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SPLITS]), split)


def split_counts(images: DataFrame) -> DataFrame:
    """Rows per split, splits without rows included."""
    spark = images.sparkSession
    every = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    counts = images.groupBy("split").agg(F.count("*").alias("n"))
    return every.join(counts, "split", "left").withColumn("n", F.coalesce("n", F.lit(0)))
