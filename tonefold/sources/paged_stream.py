"""The paged source as a stream that can be resumed: offsets are record numbers, a batch is replayed from them, and one rate holds for the query.

A batch is up to so many pages; how far records reach is found by asking for single records, with as many requests as the number of pages has binary digits. Its pages are read by one task, one after
another at the rate, and by a task that begins again after a failure in the same way. What a batch holds is told by its offsets alone, so a restarted query goes on where the last
finished batch ended and each record comes once. The fetcher's records have to keep their numbers: it may only grow at the end.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tonefold.sources.paged import Fetch

SCHEMA = "ticker string, date string, raw_text string, source string, dataset_row_id long"


@dataclass
class Stretch(InputPartition):
    """Records from start to end."""

    start: int
    end: int


class PageStream(DataSourceStreamReader):
    def __init__(self, fetch: Fetch, page: int, per_second: float, least_chars: int, pages: int) -> None:
        self.fetch, self.page, self.per_second, self.least_chars, self.pages = fetch, page, per_second, least_chars, pages
        self.at = 0
        self.last = 0.0

    def _asked(self, at: int, size: int) -> list[tuple]:
        """A request, no sooner than the rate allows."""
        time.sleep(max(0.0, self.last + 1 / self.per_second - time.monotonic()))
        self.last = time.monotonic()
        return self.fetch(at, size)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The end of the next batch: whole pages as far as there are any, and what the last page has."""
        low, high = 0, self.pages  # pages low are full, those from high on aren't all there
        if self._asked(self.at + self.page * high - 1, 1):
            self.at += self.page * high
            return {"at": self.at}
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self._asked(self.at + self.page * mid - 1, 1) else (low, mid)
        self.at += self.page * low + len(self._asked(self.at + self.page * low, self.page))
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["at"])  # after a restart the first batch is told from the checkpoint
        return [Stretch(start["at"], end["at"])]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        at = partition.start
        while at < partition.end:
            rows = self._asked(at, min(self.page, partition.end - at))
            if not rows:
                raise ValueError(f"record {at} is gone")
            for k, r in enumerate(rows):
                if len(r[2] or "") > self.least_chars:
                    yield (*r, at + k)
            at += len(rows)

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["at"])


def stream_pages(spark: SparkSession, fetch: Fetch, page: int = 10, per_second: float = 8.0, least_chars: int = 1000, pages: int = 64) -> DataFrame:
    """A stream of ticker, date, raw_text, source and record number of texts over least_chars; pages: of a batch at most. fetch(offset, size) as in paged."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_transcript_stream"

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
            return PageStream(fetch, page, per_second, least_chars, pages)

    spark.dataSource.register(Source)
    return spark.readStream.format("paged_transcript_stream").load()
