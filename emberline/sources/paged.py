"""A Spark data source over a paged search index: bounded time ranges for batches, settled offsets for streams.

The index is reached through a ``fetch(since_ms, until_ms, size, seen) -> list of hits`` function named as
``module:function``, so that any client can stand behind it: hits in ascending order of ``@timestamp`` from ``since_ms``
on and before ``until_ms``, without those whose ``_id`` is in ``seen``. The next page starts at the last hit's time and
leaves out the ids already seen at that time, so equal times over a page's end are neither lost nor doubled. With the
option ``source`` a named function is called with that text first: ``function(source, ...)``.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "id string, hit string, time long"


def pages(fetch, since_ms: int, until_ms: int, size: int) -> Iterator[tuple[str | None, str, int]]:
    at, seen = since_ms, set()
    while True:
        hits = fetch(at, until_ms, size, seen)
        for h in hits:
            yield h.get("_id"), json.dumps(h), int(h["_source"]["@timestamp"])
        if len(hits) < size:
            return
        last = int(hits[-1]["_source"]["@timestamp"])
        same = {h["_id"] for h in hits if "_id" in h and int(h["_source"]["@timestamp"]) == last}
        seen = seen | same if last == at else same
        at = last


def _function(name: str):
    module, _, f = name.partition(":")
    return getattr(importlib.import_module(module), f)


def _bound(options, name: str, default: Callable | None = None) -> Callable:
    """The function that an option names, with the source before its other arguments."""
    if name not in options:
        if default is None:
            raise ValueError(f"option {name!r} is missing")
        return default
    f = _function(options[name])
    return partial(f, options["source"]) if "source" in options else f


class _Range(InputPartition):
    def __init__(self, since: int, until: int) -> None:
        self.since, self.until = since, until


def _ranges(since: int, until: int, n: int) -> list[_Range]:
    cuts = [since + (until - since) * k // n for k in range(n + 1)]
    return [_Range(a, b) for a, b in zip(cuts, cuts[1:]) if a < b] or [_Range(since, since)]


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.o = options

    def partitions(self):
        return _ranges(int(self.o["since"]), int(self.o["until"]), int(self.o.get("partitions", 1)))

    def read(self, partition):
        yield from pages(_bound(self.o, "fetch"), partition.since, partition.until, int(self.o.get("size", 1000)))


class _Stream(DataSourceStreamReader):
    """Offsets are times up to which the index has been read: now, less the time that hits take to settle.

    The driver only cuts the range into partitions; executors fetch their pages. A batch begins ``overlap`` before the
    offset, the first one after a start ``replay`` before it, so hits that were indexed late are seen as well, and others
    again: ``distinct_hits`` lets each through once. A hit dated after now is read when its time has come.
    """

    def __init__(self, options) -> None:
        self.o = options
        self.since = int(options.get("since", 0))
        self.started = False

    def initialOffset(self) -> dict:
        return {"cursor": self.since}

    def latestOffset(self) -> dict:
        self.since = max(self.since, _bound(self.o, "clock", lambda: int(time.time() * 1000))() - int(self.o.get("settle", 0)))
        return {"cursor": self.since}

    def partitions(self, start: dict, end: dict):
        back = max(int(self.o.get("overlap", 0)), 0 if self.started else int(self.o.get("replay", 0)))
        self.started = True
        return _ranges(max(int(self.o.get("since", 0)), start["cursor"] - back), end["cursor"], int(self.o.get("partitions", 1)))

    def read(self, partition):
        yield from pages(_bound(self.o, "fetch"), partition.since, partition.until, int(self.o.get("size", 1000)))

    def commit(self, end: dict) -> None:
        """Tells the function ``on_cursor``, if there is one, how far the index has been read for good."""
        told = _bound(self.o, "on_cursor", lambda cursor: None)
        told(end["cursor"])


class PagedIndex(DataSource):
    """Options: ``fetch`` (required), ``source`` (given to every named function first), ``since``, ``until``, ``size``,
    ``partitions``; for streams ``clock``, ``settle``, ``overlap``, ``replay`` (milliseconds) and ``on_cursor``."""

    @classmethod
    def name(cls) -> str:
        return "paged_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def distinct_hits(hits: DataFrame, overlap_ms: int) -> DataFrame:
    """A stream of hits, each id once. State is kept for twice the overlap (and a second), which is as long as a hit can
    come again; hits without an id are let through."""
    known = hits.withColumn("at", F.timestamp_millis("time")).withColumn("_key", F.coalesce("id", F.concat(F.lit("~"), F.sha2("hit", 256))))
    return known.withWatermark("at", f"{overlap_ms + 1000} milliseconds").dropDuplicatesWithinWatermark(["_key"]).drop("at", "_key")
