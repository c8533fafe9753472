"""Scalar rules: clamping, scrubbing, parsing of flags and lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for true in a setting.
TRUE_WORDS = ("1", "true", "yes", "on", "y", "t")
CONF_STEP, CONF_LOW, CONF_HIGH = 0.05, 0.05, 0.95


def clamp(value: Column, high: Column | int) -> Column:
    """Truncate toward zero, then into [0, high]; null for what is no finite number."""
    v = value.cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    whole = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")
    high = F.lit(high) if isinstance(high, int) else high
    bounded = F.greatest(F.lit(0.0), F.least(F.when(v.between(-1e15, 1e15), whole).otherwise(v), high.cast("double")))
    return F.when(finite, bounded.cast("int"))


def scrub(text: Column, secret: str) -> Column:
    """Text without a secret; an empty secret scrubs nothing."""
    return F.replace(text, F.lit(secret), F.lit("<redacted>")) if secret else text


def first_set(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def is_true(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(*TRUE_WORDS), F.lit(False))


def listed(text: Column) -> Column:
    """Items of a comma-separated list, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def integers(text: Column) -> Column:
    """Integers separated by commas or spaces."""
    parts = F.split(F.trim(F.translate(text, ",", " ")), r"\s+")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: x.cast("int"))


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def voc_xml(name: Column, width: int = 1920, height: int = 1080) -> Column:
    """A Pascal VOC annotation without objects (a fixed form); the name is escaped."""
    safe = F.replace(F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    form = (
        "<annotation><folder></folder><filename>%s</filename>"
        f"<size><width>{width}</width><height>{height}</height><depth>3</depth></size><segmented>0</segmented></annotation>"
    )
    return F.format_string(form, safe)


def resolve_classes(names: dict[int, str], spec: str | None) -> list[int] | None:
    """Sorted distinct ids of a comma-separated list of ids and names; None, for all classes, if it holds neither.

    A number that is an id stands for it, even where a class bears it as its name.
    """
    wanted = [x for x in map(str.strip, (spec or "").split(",")) if x]
    known = {name: i for i, name in names.items()} | {str(i): i for i in names}
    numbers = {x: int(x) for x in wanted if re.fullmatch(r"-?[0-9]+", x)}
    ids = {x: numbers[x] if numbers.get(x) in names else known.get(x) for x in wanted}
    if unknown := sorted(x for x, i in ids.items() if i is None):
        raise ValueError(f"unknown class {', '.join(map(repr, unknown))}; known: {sorted(names.values())}")
    return sorted(set(ids.values())) or None


def step_confidence(conf: Column, up: bool) -> Column:
    moved = F.round(conf + (CONF_STEP if up else -CONF_STEP), 2)
    return F.least(F.lit(CONF_HIGH), moved) if up else F.greatest(F.lit(CONF_LOW), moved)


def step_position(idx: Column, by: int, total: Column) -> Column:
    return F.greatest(F.lit(0), F.least(total - 1, idx + by))


def seconds(idx: Column, fps: Column | float) -> Column:
    """Time of a frame; a rate of 0 stands for 25 frames a second."""
    rate = F.lit(float(fps)) if isinstance(fps, int | float) else fps
    return idx / F.when(rate > 0, rate).otherwise(25.0)


def memory_mb(counter: int, system: str) -> float:
    """Peak memory in MB: the counter is in bytes on darwin and in KB elsewhere."""
    return counter / (1 << 20) if system == "darwin" else counter / 1024
