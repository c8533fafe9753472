"""Calls to a remote dataset, one per row: uploads, null annotations, tags, and single annotations.

Each row is sent on its own, and a failed one stops no other: its error is
returned, scrubbed of the key.  A task that runs again sends its rows again,
so a call must bear being repeated (these overwrite, add or remove).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, scalars
from .remote import call, transport

RESULT = "ok boolean, error string, found string"


def _each(rows: DataFrame, keys: list[str], options: dict[str, str], send: Callable[[Any, dict], Any]) -> DataFrame:
    """keys, ok, error, found (what the call returned, as JSON)."""
    key = options.get("key", "")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        remote = transport(options)
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                try:
                    found = call(send, key, remote, row)
                    out.append((True, None, None if found is None else json.dumps(found)))
                except Exception as e:  # any failure is the row's own
                    out.append((False, str(e)[:200], None))
            done = pd.DataFrame(out, columns=["ok", "error", "found"], dtype=object)
            yield pd.concat([b[keys].reset_index(drop=True), done], axis=1)

    return rows.mapInPandas(run, f"{schema}, {RESULT}")


def upload(jobs: DataFrame, options: dict[str, str], batch: str, tags: list[str]) -> DataFrame:
    """Sends the images of `upload_jobs` (name, path, split): name, split, ok, error."""
    sent = _each(jobs.select("name", "path", "split"), ["name", "split"], options, lambda r, x: r.upload(x["path"], x["split"], batch, tags))
    return sent.drop("found")


def mark_null(images: DataFrame, options: dict[str, str], width: int = 1920, height: int = 1080) -> DataFrame:
    """Stores an annotation without objects for each image (id, name): id, name, ok, error."""
    xml = scalars.voc_xml(F.col("name"), width, height)
    ready = images.select("id", "name", F.concat(names.stem("name"), F.lit(".xml")).alias("file"), xml.alias("text"))
    return _each(ready, ["id", "name"], options, lambda r, x: r.save_annotation(x["id"], x["file"], x["text"])).drop("found")


def set_tags(actions: DataFrame, options: dict[str, str], tags: list[str]) -> DataFrame:
    """Carries out `tag_actions` (id, op): id, op, ok, error."""
    return _each(actions.select("id", "op"), ["id", "op"], options, lambda r, x: r.set_tags(x["id"], tags, x["op"])).drop("found")


def annotations(images: DataFrame, options: dict[str, str], schema: str) -> DataFrame:
    """The stored annotation of each image (id), read by `schema`: id, annotation, ok, error."""
    got = _each(images.select("id"), ["id"], options, lambda r, x: r.annotation(x["id"]))
    return got.select("id", F.from_json("found", schema).alias("annotation"), "ok", "error")


def preview(images: DataFrame, order: Column | str = "name", n: int = 5) -> DataFrame:
    """The first few images, which a dry run shows."""
    return images.orderBy(order).limit(n)


def jobs_per_split(jobs: DataFrame) -> DataFrame:
    """split, n of the jobs of an upload."""
    return jobs.groupBy("split").agg(F.count("*").alias("n"))
