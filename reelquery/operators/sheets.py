"""Contact sheets: numbering, pages, rejects and verdicts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import integers
from ..plans.scratch import written

TILES, VERIFY_TILES = 36, 6


def numbered(rows: DataFrame, order: list[str | Column], name: str = "n") -> DataFrame:
    """Rows with their place (from 0) in a global order, without a one-partition window.

    Rows are range-partitioned and sorted; a row's place is its place in its
    partition plus the rows of the partitions before, one count each.
    """
    place = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ordered.select("*", place.alias("__rq_place")), "numbered")
    part = F.shiftright("__rq_place", 33)
    counts = sorted(placed.groupBy(part.alias("p")).count().collect())  # one row per partition
    before, at = [], 0
    for p, n in counts:
        before += [F.lit(p), F.lit(at)]
        at += n
    if not before:
        return placed.select("*", F.lit(0).cast("bigint").alias(name)).drop("__rq_place")
    offset = F.element_at(F.create_map(*before), part)
    inside = F.col("__rq_place").bitwiseAND((1 << 33) - 1)
    return placed.withColumn(name, (offset + inside).cast("bigint")).drop("__rq_place")


def paginate(rows: DataFrame, prefix: str, order: list[str | Column], tiles: int = TILES) -> DataFrame:
    """Rows with sheet (`prefix_001`, ...) and tile (from 1)."""
    n = F.col("n")
    return (
        numbered(rows, order)
        .withColumn("sheet", F.format_string(f"{prefix}_%03d", F.floor(n / tiles).cast("long") + 1))
        .withColumn("tile", (n % tiles + 1).cast("int"))
        .drop("n")
    )


def parse_reject(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """(sheet, tile) of specs such as 'bg_002:5,17 bg_004:3'; a word without ':' is an error."""
    words = F.filter(F.split(F.trim(F.coalesce(F.col(spec), F.lit(""))), r"\s+"), lambda w: w != "")
    word = specs.select(F.explode(words).alias("w"))
    bad = F.raise_error(F.concat(F.lit("expected sheet:tile,... in "), F.col("w"))).cast("array<string>")
    parts = word.select(F.when(F.contains("w", F.lit(":")), F.split("w", ":", 2)).otherwise(bad).alias("p"))
    tiles = F.filter(F.split(F.col("p")[1], ","), lambda t: F.trim(t) != "")
    return parts.select(F.col("p")[0].alias("sheet"), F.explode(tiles).alias("t")).select(
        "sheet", F.trim("t").cast("int").alias("tile")
    ).distinct()


def apply_rejects(manifest: DataFrame, rejects: DataFrame, rejected_names: DataFrame | None = None) -> DataFrame:
    """The manifest without rejected tiles and without frames rejected by name."""
    kept = manifest.join(rejects, ["sheet", "tile"], "left_anti")
    if rejected_names is not None:
        kept = kept.join(rejected_names.select(F.col("name").alias("frame")), "frame", "left_anti")
    return kept


def pending(collected: DataFrame, verified: DataFrame, rejected: DataFrame) -> DataFrame:
    """Names collected and not yet judged."""
    judged = verified.select("name").union(rejected.select("name"))
    return collected.join(judged, "name", "left_anti")


def verify_pages(names: DataFrame, tiles: int = VERIFY_TILES) -> DataFrame:
    """name, number (from 1, by name), page (from 1), tile (from 1)."""
    n = F.col("n")
    return numbered(names.select("name"), ["name"]).select(
        "name",
        (n + 1).alias("number"),
        (F.floor(n / tiles).cast("long") + 1).alias("page"),
        (n % tiles + 1).cast("int").alias("tile"),
    )


def record_verdicts(names: DataFrame, bad: str) -> DataFrame:
    """name, verdict: numbers in `bad` (commas or spaces) are rejected; a number beyond the list is an error."""
    pages = verify_pages(names)
    spark = names.sparkSession
    wanted = spark.range(1).select(F.explode(integers(F.lit(bad))).alias("number")).distinct()
    unknown = wanted.join(pages, "number", "left_anti").select("number").limit(5).collect()
    if unknown:
        raise ValueError(f"no such numbers: {sorted(r['number'] for r in unknown)}")
    marked = pages.join(wanted.withColumn("bad", F.lit(True)), "number", "left")
    return marked.select("name", F.when(F.col("bad"), "rejected").otherwise("verified").alias("verdict"))


def merged_verdicts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Names of both, each once, in order."""
    return existing.select("name").union(new.select("name")).distinct().orderBy("name")


def collect_plan(manifest: DataFrame, on_disk: DataFrame) -> DataFrame:
    """frame, found: whether the source of each manifest row is on disk."""
    there = on_disk.select("frame").distinct().withColumn("found", F.lit(True))
    return manifest.join(there, "frame", "left").withColumn("found", F.coalesce("found", F.lit(False)))


class Places(NamedTuple):
    """Where a mode's sheets lie and what it collects goes, and the prefix of its sheets' names."""

    prefix: str
    sheets: str
    dest: str


def places(mode: str, mining: str, data: str, dest: str | None = None) -> Places:
    """The places of a review mode: 'background', or 'positive' for any other; `dest` replaces the usual one."""
    prefix, usual = ("bg", "backgrounds") if mode == "background" else ("positive", "to_annotate")
    return Places(prefix, f"{mining.rstrip('/')}/contact_{prefix}", dest or f"{data.rstrip('/')}/{usual}")
