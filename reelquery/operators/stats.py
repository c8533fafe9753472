"""Latency summaries and run counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

P = "__rq_"


def latency_summary(samples: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """median, p90, least, per_second: p90 is the sorted sample at index int(0.9 n), per_second 1000 / median.

    Samples are counted per value before they are ordered, and the order is
    a running count, so no group is gathered.
    """
    by = by or []
    x, n, c, upto = (P + k for k in ("x", "n", "c", "upto"))
    keys = [F.col(k).alias(P + k) for k in by]
    held = samples.where(F.col(value).isNotNull())
    counts = held.groupBy(*keys, F.col(value).alias(x)).agg(F.count("*").alias(c))
    totals = held.groupBy(*by).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.min(value).alias("least"))
    order = Window.partitionBy(*[P + k for k in by]).orderBy(x)
    running = counts.withColumn(upto, F.sum(c).over(order))
    same = [totals[k].eqNullSafe(F.col(P + k)) for k in by]
    met = totals.where("n > 0").join(running, reduce(lambda a, b: a & b, same, F.lit(True)))
    at = F.least(F.floor(F.col("n") * 0.9), F.col("n") - 1)
    found = met.where(F.col(upto) > at).groupBy(*by, "n", "median", "least").agg(F.min(x).alias("p90"))
    return found.select(*by, "n", "median", "least", "p90", (1000 / F.when(F.col("median") > 0, F.col("median"))).alias("per_second"))


def stage_means(samples: DataFrame, stages: str = "stages") -> DataFrame:
    """Mean per stage of a map column; nulls do not count."""
    return samples.select(F.explode(stages).alias("stage", "ms")).groupBy("stage").agg(F.avg("ms").alias("mean"))


def extraction_total(videos: DataFrame, frames: str) -> DataFrame:
    """videos, frames: how many videos, and the sum of their frames (a null counts as none)."""
    return videos.agg(F.count("*").alias("videos"), F.coalesce(F.sum(frames), F.lit(0)).alias("frames"))


def run_summary(results: DataFrame, ok: str = "ok") -> DataFrame:
    """ok, failed, exit_code: 1 only if something failed and nothing went well."""
    good, bad = F.count_if(F.col(ok)), F.count_if(~F.coalesce(F.col(ok), F.lit(False)))
    return results.agg(good.alias("ok"), bad.alias("failed")).withColumn(
        "exit_code", F.when((F.col("failed") > 0) & (F.col("ok") == 0), 1).otherwise(0)
    )
