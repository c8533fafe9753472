"""Detectors as batched column functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column

BATCH = 16
DETECTIONS = "struct<conf:array<double>,cls:array<int>>"


def detector(make: Callable[[], Callable[[Sequence[str]], list[tuple[Sequence[float], Sequence[int]]]]], batch: int = BATCH) -> Callable[[Column], Column]:
    """Column function path -> struct(conf, cls) of arrays.

    `make` is called once per Python worker and returns a function from a
    batch of paths to one (confidences, classes) pair each.
    """

    def load():
        model = make()

        def predict(paths: np.ndarray) -> list[dict]:
            return [
                {"conf": np.asarray(conf, np.float64), "cls": np.asarray(cls, np.int32)} for conf, cls in model(list(paths))
            ]

        return predict

    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

    kind = StructType([StructField("conf", ArrayType(DoubleType())), StructField("cls", ArrayType(IntegerType()))])
    return predict_batch_udf(load, return_type=kind, batch_size=batch)
