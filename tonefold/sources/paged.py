"""A source that is read page by page at a bounded rate, as a Python data source (filing archives and the like).

The fetcher is the caller's: fetch(offset, size) -> list of (ticker, date, raw_text, source), empty behind the last page. One reader goes from
page to page until it has kept as many records as asked for, so the rate holds for the whole query; if its task fails it begins again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[int, int], list[tuple]]


def read_pages(spark: SparkSession, fetch: Fetch, limit: int, page: int = 10, per_second: float = 8.0, least_chars: int = 1000) -> DataFrame:
    """ticker, date, raw_text, source of the first `limit` texts over least_chars, with at most per_second requests a second."""

    class Pages(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(0)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            kept, at = 0, partition.value
            while kept < limit and (rows := fetch(at, page)):
                good = [tuple(r) for r in rows if len(r[2] or "") > least_chars][: limit - kept]
                yield from good
                kept += len(good)
                at += page
                time.sleep(1 / per_second)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_transcripts"

        def schema(self) -> str:
            return "ticker string, date string, raw_text string, source string"

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Pages()

    spark.dataSource.register(Source)
    return spark.read.format("paged_transcripts").load()
