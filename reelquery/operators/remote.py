"""Planning of remote dataset work: paging, tags, uploads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written

PASSES, QUIET_PASSES = 6, 2


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__rq_n", F.row_number().over(w)).where("__rq_n = 1").drop("__rq_n")


def sweep_until_quiet(sweep: Callable[[int], DataFrame], key: str, order: list[str], passes: int = PASSES) -> DataFrame:
    """Rows of repeated sweeps, each key once, first seen first; ends after two sweeps that add nothing.

    `sweep(i)` returns the i-th sweep (with a column `sweep`); each round is
    written, so no sweep is asked twice.
    """
    seen, quiet = None, 0
    for i in range(passes):
        page = first_seen(written(sweep(i), "sweep"), key, order)
        new = page if seen is None else page.join(seen.select(key), key, "left_anti")
        new = written(new, "new")
        quiet = quiet + 1 if new.isEmpty() else 0
        seen = new if seen is None else seen.unionByName(new)
        if quiet == QUIET_PASSES:
            break
    return seen


def annotated(count: Column) -> Column:
    return F.coalesce(count, F.lit(0)) != 0


def split_histogram(images: DataFrame) -> DataFrame:
    return images.where(annotated(F.col("annotations.count"))).groupBy(
        F.coalesce("split", F.lit("?")).alias("split")
    ).agg(F.count("*").alias("n"))


def class_histogram(images: DataFrame) -> DataFrame:
    """Objects per class: sums over the maps of the annotated images."""
    each = images.where(annotated(F.col("annotations.count"))).select(F.explode("annotations.classes").alias("name", "n"))
    return each.groupBy("name").agg(F.sum("n").alias("n"))


def plain_boxes(boxes: Column | str) -> Column:
    """Objects that are no polygons and have no points."""
    return F.filter(
        boxes, lambda o: ~o["type"].eqNullSafe(F.lit("polygon")) & (F.coalesce(F.size(o["points"]), F.lit(0)) <= 0)
    )


def polygon_progress(annotations: DataFrame, boxes: str = "boxes") -> DataFrame:
    """done (no plain box), raw (plain boxes left), mixed (some of both)."""
    n = F.coalesce(F.size(boxes), F.lit(0))
    raw = F.coalesce(F.size(plain_boxes(boxes)), F.lit(0))
    return annotations.select(n.alias("n"), raw.alias("r")).agg(
        F.count_if(F.col("r") == 0).alias("done"),
        F.count_if(F.col("r") > 0).alias("raw"),
        F.count_if((F.col("r") > 0) & (F.col("r") < F.col("n"))).alias("mixed"),
    )


def tag_actions(candidates: DataFrame, tagged: DataFrame, finished: DataFrame) -> DataFrame:
    """(id, op): add to candidates without the tag, remove from finished ones that have it."""
    add = candidates.select("id").join(tagged.select("id"), "id", "left_anti").withColumn("op", F.lit("add"))
    remove = finished.select("id").join(tagged.select("id"), "id", "left_semi").withColumn("op", F.lit("remove"))
    return add.unionByName(remove)


def upload_jobs(layouts: list[DataFrame]) -> DataFrame:
    """One job per name over layouts (name, path, split) in order of priority, then of path."""
    every = None
    for i, layout in enumerate(layouts):
        part = layout.withColumn("prio", F.lit(i))
        every = part if every is None else every.unionByName(part)
    if every is None:
        raise ValueError("no layouts")
    return first_seen(every, "name", ["prio", "path"])


def job_counts(jobs: DataFrame) -> DataFrame:
    """Jobs per split, after each name was taken once."""
    return jobs.groupBy("split").agg(F.count("*").alias("n"))


def preview(rows: DataFrame, *order: str, n: int = 5) -> DataFrame:
    """The first n rows in the given order: what a dry run shows."""
    return rows.orderBy(*order).limit(n)


def with_offset(rows: DataFrame, offsets: DataFrame, key: str) -> DataFrame:
    """Adds offset, 0 where the table (`key`, offset) has none."""
    return rows.join(offsets, key, "left").withColumn("offset", F.coalesce("offset", F.lit(0)))


def overridden(base: DataFrame, over: DataFrame, key: str, value: str) -> DataFrame:
    """Union of two maps as tables; the second wins."""
    both = base.select(key, value, F.lit(0).alias("p")).unionByName(over.select(key, value, F.lit(1).alias("p")))
    return both.groupBy(key).agg(F.max_by(value, "p").alias(value))
