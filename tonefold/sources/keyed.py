"""Transcripts as a file a key, written as a transaction.

A task writes its rows to a staging folder of its own, and the commit moves the files to their places by rename, so a key's file is whole or isn't there: a task that dies leaves nothing, nor does a
job that fails, but for a staging folder (which readers skip by its name) of tasks that outlive it. Whether a key is stored already is decided when the job commits; such files stay as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "keyed_transcripts"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class KeyedWriter(DataSourceWriter):
    def __init__(self, path: str, least_bytes: int) -> None:
        self.path, self.least_bytes = path.rstrip("/"), least_bytes
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        where, at = _opened(folder)
        where.create_dir(at, recursive=True)
        for row in iterator:
            record = {k: v for k, v in row.asDict(recursive=True).items() if v is not None}
            with where.open_output_stream(f"{at}/{record['ticker']}_{record['date']}.json") as f:
                f.write(json.dumps(record, indent=2, ensure_ascii=False, default=str).encode())
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        where, at = _opened(self.path)
        for message in messages:
            if message is None:
                continue
            for file in where.get_file_info(fs.FileSelector(_opened(message.folder)[1])):
                there = where.get_file_info(f"{at}/{file.base_name}")
                if there.type == fs.FileType.NotFound or there.size <= self.least_bytes:
                    where.move(file.path, f"{at}/{file.base_name}")
        self._clean()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        where, at = _opened(self.staging)
        if where.get_file_info(at).type == fs.FileType.Directory:
            where.delete_dir(at)


class KeyedFiles(DataSource):
    """Writes rows with ticker and date (letters, digits and underscores) to {ticker}_{date}.json under path. Each key has to come once."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return KeyedWriter(self.options["path"], int(self.options.get("least_bytes", "1000")))


def write(rows: DataFrame, path: str, least_bytes: int = 1000) -> None:
    """Keys whose file has more than least_bytes already stay as they are; smaller files are replaced."""
    spark: SparkSession = rows.sparkSession
    where, at = _opened(path)
    where.create_dir(at, recursive=True)
    spark.dataSource.register(KeyedFiles)
    rows.write.format(NAME).mode("append").option("path", path).option("least_bytes", str(least_bytes)).save()
