"""A paged source as a Spark data source: batch and streaming reads of list pages and their details, with resume and retry.

The transport is a function of the page number that gives rows, or raises; the offset of a stream is the next page, so a
restart goes on where its checkpoint stands. Rows already known are left out by an anti join on their id.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "id string, page int, text string"


def wait(attempt: int, cap: float = 60.0) -> float:
    """Seconds before the next attempt."""
    return min(cap, 4.0 * 2**attempt)


def fetched(fetch: Callable[[int], list[tuple]], page: int, attempts: int = 4, pause: Callable[[float], None] = time.sleep) -> list[tuple]:
    for attempt in range(attempts):
        try:
            return fetch(page)
        except OSError:
            if attempt + 1 == attempts:
                raise
            pause(wait(attempt))
    return []


def paged_source(name: str, fetch: Callable[[int], list[tuple]], pages: int) -> type[DataSource]:
    """A data source class over ``fetch`` with ``pages`` pages; register it with ``spark.dataSource.register``."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(p) for p in range(pages)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from fetched(fetch, partition.value)

    class Stream(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"page": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            page = start["page"]
            if page >= pages:
                return iter([]), start
            return iter(fetched(fetch, page)), {"page": page + 1}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            for page in range(start["page"], end["page"]):
                yield from fetched(fetch, page)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader()

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Stream()

    return Source


def unseen(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.join(known.select("id"), "id", "left_anti")


def read(spark: SparkSession, source: type[DataSource]) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()
