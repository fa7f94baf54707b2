"""A paged service as a Spark data source: a partition for each window of dates, as a batch or as a stream."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "start date, stop date, place long, record string"


class Window(InputPartition):
    def __init__(self, start: dt.date, stop: dt.date):
        self.start, self.stop = start, stop


class Pages:
    """Windows of `days` between the options start and stop, and how one is read: page by page, each page tried again with pauses that double."""

    def __init__(self, fetch: Callable[..., tuple[list[str], int]], options: dict):
        self.fetch = fetch
        self.first, self.last = (dt.date.fromisoformat(options[k]) for k in ("start", "stop"))
        self.days, self.size, self.tries, self.pause = int(options.get("days", 100)), int(options.get("size", 2_000)), int(options.get("tries", 4)), float(options.get("pause", 0))
        if self.days < 1 or self.size < 1 or self.last < self.first:
            raise ValueError("days and size must be positive, and stop not before start")

    def windows(self, low: int = 0, high: int | None = None) -> list[Window]:
        """Those with numbers low .. high - 1."""
        n = (self.last - self.first).days // self.days + 1
        at = lambda k: self.first + dt.timedelta(days=k * self.days)
        return [Window(at(k), min(self.last, at(k + 1) - dt.timedelta(days=1))) for k in range(low, n if high is None else min(n, high))]

    def rows(self, window: Window) -> Iterator[tuple]:
        place, total = 0, 1
        while place < total:
            for k in range(self.tries):
                try:
                    records, total = self.fetch(window.start, window.stop, place, self.size)
                    break
                except OSError:
                    if k == self.tries - 1:
                        raise
                    time.sleep(self.pause * 2**k)
            for record in records:
                yield window.start, window.stop, place, record
                place += 1
            if not records:
                break


class _Batch(DataSourceReader):
    def __init__(self, pages: Pages):
        self.pages = pages

    def partitions(self) -> list[Window]:
        return self.pages.windows()

    def read(self, partition: Window) -> Iterator[tuple]:
        return self.pages.rows(partition)


class _Stream(DataSourceStreamReader):
    """Offsets count windows; at most `per_batch` of them are read at once."""

    def __init__(self, pages: Pages, per_batch: int):
        self.pages, self.per_batch, self.seen = pages, per_batch, 0

    def initialOffset(self) -> dict:
        return {"window": 0}

    def latestOffset(self) -> dict:
        self.seen = min(len(self.pages.windows()), self.seen + self.per_batch)
        return {"window": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        self.seen = max(self.seen, end["window"])  # also after a restart from a checkpoint
        return self.pages.windows(start["window"], end["window"])

    def read(self, partition: Window) -> Iterator[tuple]:
        return self.pages.rows(partition)

    def commit(self, end: dict) -> None:
        pass


def register_paged(spark: SparkSession, name: str, fetch: Callable[..., tuple[list[str], int]]) -> str:
    """Make spark.read.format(name) and spark.readStream.format(name) read a service through fetch(start, stop, place, size) -> (records, how many in all).

    Options: start, stop (dates), days of a window, size of a page, tries, pause in seconds, per_batch (windows of a micro-batch).
    A task reads one window; if it fails, Spark tries that window alone again.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Batch(Pages(fetch, self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(Pages(fetch, self.options), int(self.options.get("per_batch", 1)))

    spark.dataSource.register(Paged)
    return name
