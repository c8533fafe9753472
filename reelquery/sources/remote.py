"""A remote search as a Spark data source, with a pluggable transport.

    spark.dataSource.register(SearchSource)
    spark.read.format("image_search").options(transport="offline", path=...).load()

Pages are read until one is empty.  With `total`, an estimate of the number
of records, pages up to it are read in parallel, and the last reader goes on
to the end, so a low estimate loses nothing.

The offline transport reads pages from JSON lines; a transport over a network
is a class with `page(body, offset, limit)`, named by `module:Class`.
"""

from __future__ import annotations

import importlib
import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PAGE = 100


class ApiError(RuntimeError):
    """A failed call; its message never holds the key."""


def call(send, key: str, *args: Any, **kw: Any) -> Any:
    """send(...), its error scrubbed of the key and raised without the original as its context."""
    message = None
    try:
        return send(*args, **kw)
    except Exception as e:  # any transport error
        message = f"{type(e).__name__}: {e}"
    if key:
        message = message.replace(key, "<redacted>")
    raise ApiError(message)


@lru_cache(maxsize=4)
def _records(path: str, changed: int) -> list[dict]:
    """All records of a file, parsed once as long as it does not change."""
    with open(path, encoding="utf-8") as f:
        return [json.loads(line) for line in f if line.strip()]


class OfflineTransport:
    """Records in a JSON-lines file, one per line, filtered as a server would."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.log = options.get("path", ""), options.get("log", "")

    def page(self, body: dict[str, Any], offset: int, limit: int) -> list[dict]:
        records = _records(self.path, os.stat(self.path).st_mtime_ns)
        if body.get("split"):
            records = [r for r in records if r.get("split") == body["split"]]
        if body.get("class_name"):
            records = [r for r in records if body["class_name"] in (r.get("annotations") or {}).get("classes", {})]
        if body.get("tag"):
            records = [r for r in records if body["tag"] in r.get("tags", [])]
        found = records[offset : offset + limit]
        fields = body.get("fields")
        return [{k: r[k] for k in fields if k in r} for r in found] if fields else found

    def annotation(self, image_id: str) -> dict:
        found = next(r for r in _records(self.path, os.stat(self.path).st_mtime_ns) if r.get("id") == image_id)
        return found["annotation"]

    def _log(self, **call: Any) -> None:
        """A call leaves a file of its own in the folder `log`."""
        os.makedirs(self.log, exist_ok=True)
        with open(os.path.join(self.log, uuid.uuid4().hex + ".json"), "w", encoding="utf-8") as f:
            json.dump(call, f)

    def upload(self, path: str, split: str, batch: str, tags: list[str]) -> None:
        if not os.path.exists(path.removeprefix("file:")):
            raise FileNotFoundError(path)
        self._log(call="upload", path=path, split=split, batch=batch, tags=tags)

    def save_annotation(self, image_id: str, name: str, text: str) -> None:
        self._log(call="annotation", id=image_id, name=name, text=text)

    def set_tags(self, image_id: str, tags: list[str], operation: str) -> None:
        self._log(call="tags", id=image_id, tags=tags, operation=operation)


def transport(options: dict[str, str]) -> Any:
    name = options.get("transport", "offline")
    if name == "offline":
        return OfflineTransport(options)
    module, _, cls = name.partition(":")
    return getattr(importlib.import_module(module), cls)(dict(options))


class Page(InputPartition):
    """A page, or all from it on."""

    def __init__(self, offset: int, last: bool) -> None:
        self.offset, self.last = offset, last


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[Page]:
        starts = range(0, max(int(self.options.get("total", 1)), 1), PAGE)
        return [Page(o, o == starts[-1]) for o in starts]

    def read(self, partition: Page) -> Iterator[tuple]:
        body = {k: self.options[k] for k in ("tag", "split", "class_name", "in_dataset") if k in self.options}
        if self.options.get("fields"):
            body["fields"] = [f.strip() for f in self.options["fields"].split(",")]
        send, offset, end = transport(self.options).page, partition.offset, partition.offset + PAGE
        while partition.last or offset < end:
            found = call(send, self.options.get("key", ""), body, offset, PAGE if partition.last else end - offset)
            if not found:
                return
            for r in found:
                notes = r.get("annotations")
                kept = (notes.get("count"), notes.get("classes")) if notes else None
                yield r.get("id"), r.get("name"), r.get("split"), kept
            offset += len(found)


class SearchSource(DataSource):
    """id, name, split, annotations of a remote image search; options tag, split, class_name, fields go to the server."""

    @classmethod
    def name(cls) -> str:
        return "image_search"

    def schema(self) -> str:
        from .. import schemas

        return schemas.SEARCH_RECORD

    def reader(self, schema: StructType) -> SearchReader:
        return SearchReader(dict(self.options))
