"""Files written by tasks: one of each row ``(name, content)``, staged first and moved into place when all tasks are done.

A task that is run again stages its files anew; a job that fails leaves none; the driver moves files and opens none. Paths are of any
file system that Arrow opens (local and shared folders, HDFS, object stores), names are relative to them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pixelveil.functions.tables import with_import_path


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written: (staged path, name)."""

    files: list[tuple[str, str]]


class StagedWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        store, top = _opened(self.path)
        task = TaskContext.get()
        folder = f"{top}/{self.staging}/{task.partitionId()}-{task.taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        out = []
        for i, row in enumerate(iterator):
            if not row.name or row.name.startswith("/") or ".." in row.name.split("/"):
                raise ValueError(f"not a relative name: {row.name}")
            with store.open_output_stream(f"{folder}/{i}") as f:
                f.write(bytes(row.content))
            out.append((f"{folder}/{i}", row.name))
        return Staged(out)

    def commit(self, messages: list[Staged | None]) -> None:
        store, top = _opened(self.path)
        made = set()
        for staged, name in (x for m in messages if m for x in m.files):
            to = f"{top}/{name}"
            folder = to.rpartition("/")[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            if store.get_file_info(to).type != fs.FileType.NotFound:
                store.delete_file(to)
            store.move(staged, to)
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, top = _opened(self.path)
        if store.get_file_info(f"{top}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{top}/{self.staging}")


class StagedFiles(DataSource):
    """Write with ``df.write.format("staged_files").mode("append").save(path)``; files of the same names are replaced."""

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return StagedWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Every row of ``(name, content)`` as a file of that name under ``path``, by the tasks that have the rows."""
    with_import_path(files.sparkSession).dataSource.register(StagedFiles)
    files.select(F.col("name").cast("string"), F.col("content").cast("binary")).write.format("staged_files").mode("append").save(path)
