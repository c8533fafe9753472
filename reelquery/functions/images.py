"""Picture measures as Arrow UDFs over the `image` source's BGR bytes.

Pixels are resized by area-free bilinear sampling at pixel centres, so results
may differ from another library's in the last grey level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

BLOCK, DEVIATION, FLAT_SIZE, DESCRIPTOR_SIZE = 8, 3.0, (256, 144), 32
#: Weights of blue, green and red in grey.
GREY = (0.114, 0.587, 0.299)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy = (y - y0).reshape(-1, 1, *[1] * (image.ndim - 2))
    fx = (x - x0).reshape(1, -1, *[1] * (image.ndim - 2))
    f = image.astype(np.float32)
    top = f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx
    return top * (1 - fy) + (f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx) * fy


def block_flatness(grey: np.ndarray, block: int = BLOCK, deviation: float = DEVIATION) -> float:
    """Share of blocks whose population deviation is below `deviation`."""
    h, w = (n - n % block for n in grey.shape)
    cells = grey[:h, :w].astype(np.float32).reshape(h // block, block, w // block, block)
    return float((cells.transpose(0, 2, 1, 3).std(axis=(2, 3)) < deviation).mean())


def _decode(data: bytes, height: int, width: int, channels: int) -> np.ndarray | None:
    if height is None or height <= 0 or not data:
        return None
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(image, 3, 2) if channels == 1 else image[:, :, :3]


@F.pandas_udf(DoubleType())
def _flatness(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for data, h, w, c in parts:
        out = []
        for row in zip(data, h, w, c, strict=True):
            image = _decode(*row)
            if image is None:
                out.append(1.0)
            else:
                grey = np.round(image @ np.array(GREY))
                out.append(block_flatness(np.round(resize(grey, *FLAT_SIZE))))
        yield pd.Series(out)


@F.pandas_udf(ArrayType(FloatType()))
def _descriptor(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for data, h, w, c in parts:
        out = []
        for row in zip(data, h, w, c, strict=True):
            image = _decode(*row)
            size = DESCRIPTOR_SIZE
            out.append(None if image is None else (np.round(resize(image, size, size)) / 255).astype(np.float32).ravel())
        yield pd.Series(out)


def _fields(image: str) -> list[Column]:
    return [F.col(f"{image}.{c}") for c in ("data", "height", "width", "nChannels")]


def flatness(image: str = "image") -> Column:
    """Share of flat blocks of the grey picture; 1.0 where it cannot be read."""
    return _flatness(*_fields(image))


def descriptor(image: str = "image") -> Column:
    """The picture at 32 x 32 as values from 0 to 1; null where it cannot be read."""
    return _descriptor(*_fields(image))
