"""A cache of tracking passes: each is a Parquet table under its key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .files import exists


def cached(spark: SparkSession, root: str, key: str | None, make: Callable[[], DataFrame], rescan: bool = False) -> DataFrame:
    """The table kept under `key`; made and written where there is none, or on a rescan.

    A key of null (a model without a file of its own) is never kept.  A table
    whose writing was cut short lacks its success mark and is made again.
    """
    if key is None:
        return make()
    path = f"{root.rstrip('/')}/{key}"
    if rescan or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
