"""Frame identity: names that hold a video and a signed index."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEP = "_mp4-"
DEFAULT_PAD = 4
#: Fixed value: the suffix that an annotation platform appends to exported names.
EXPORT_SUFFIX = r"(?i)_jpg\.rf\.[0-9a-f]+\.jpg$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_export_suffix(name: Column | str) -> Column:
    return F.regexp_replace(_col(name), EXPORT_SUFFIX, "")


def try_split(name: Column | str, sep: str = DEFAULT_SEP) -> Column:
    """struct(video, idx), cut at the last separator; null where the name is no frame name."""
    stem = F.regexp_replace(strip_export_suffix(name), r"(?i)\.jpg$", "")
    pattern = f"(?s)^(.*){re.escape(sep)}(.*)$"
    idx = F.regexp_extract(stem, pattern, 2).try_cast("bigint")
    found = F.struct(F.regexp_extract(stem, pattern, 1).alias("video"), idx.alias("idx"))
    return F.when(stem.rlike(pattern) & idx.isNotNull(), found)


def split(name: Column | str, sep: str = DEFAULT_SEP) -> Column:
    """As `try_split`, but a name that is none is an error."""
    found = try_split(name, sep)
    message = F.concat(F.lit("not a frame name: "), F.coalesce(_col(name), F.lit("NULL")))
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(message).cast("struct<video:string,idx:bigint>"))


def padded(idx: Column | str, pad: int = DEFAULT_PAD) -> Column:
    """Zero-padded magnitude with the sign outside the padding; never cut."""
    i = _col(idx).cast("bigint")
    return F.concat(F.when(i < 0, "-").otherwise(""), F.format_string(f"%0{pad}d", F.abs(i)))


def frame_name(
    video: Column | str, idx: Column | str, sep: str = DEFAULT_SEP, pad: int = DEFAULT_PAD, ext: str = ".jpg"
) -> Column:
    return F.concat(_col(video), F.lit(sep), padded(idx, pad), F.lit(ext))


def saved_name(stem: Column | str, idx: Column | str) -> Column:
    """Name under which a reviewed frame is saved."""
    return F.format_string("%s_f%06d.jpg", _col(stem), _col(idx).cast("bigint"))


def tile_label(video: Column | str, idx: Column | str) -> Column:
    """Caption of a tile: the sign counts as part of the width."""
    return F.concat(F.substring(_col(video), 1, 11), F.lit("-"), F.format_string("%04d", _col(idx).cast("bigint")))


def dataset_index(seq: Column | str, offset: Column | str) -> Column:
    """Index of the seq-th extracted frame (from 1) of a video whose clip starts `offset` frames in."""
    return _col(seq) - _col(offset)


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def stem(path: Column | str) -> Column:
    """Base name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def extension(ext: Column | str) -> Column:
    """Extension without leading dots."""
    return F.regexp_replace(_col(ext), r"^\.+", "")


def path_order(path: Column | str) -> Column:
    """Sort key that compares paths component by component."""
    return F.split(_col(path), "/")
