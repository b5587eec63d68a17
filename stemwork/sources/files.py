"""A sink for whole files: each row is a name and the bytes of one file, which the task that has it writes.

Tasks write below a folder of their job that no reader looks at. The files come to their places when all tasks have
ended well, and none does if one has failed; a task that runs twice stages its files under two names, of which the job
takes those of the attempt that counts. Paths are what pyarrow's file systems know (local, hdfs, s3, gs).
"""

from __future__ import annotations

import contextlib
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "whole_files"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        store, root = place(self.path)
        folder, names = f"{root}/{self.job}/{uuid.uuid4().hex}", []
        for batch in iterator:
            for name, content in zip(*(batch.column(c) for c in ("name", "content"))):
                where = f"{folder}/{name.as_py()}"
                store.create_dir(posixpath.dirname(where), recursive=True)
                with store.open_output_stream(where) as out:
                    out.write(content.as_buffer())
                names.append(name.as_py())
        return _Staged(folder, names)

    def commit(self, messages: list[_Staged | None]) -> None:
        store, root = place(self.path)
        for m in messages:
            for name in m.names if m else []:
                store.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
                store.move(f"{m.folder}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[_Staged | None]) -> None:
        store, root = place(self.path)
        with contextlib.suppress(FileNotFoundError):
            store.delete_dir(f"{root}/{self.job}")


class WholeFiles(DataSource):
    """Write only: .format("whole_files").option("path", ...) of (name string, content binary)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def write_files(df: DataFrame, path: str) -> None:
    """Writes each row (name, content) as a file below path, by the task that has the row."""
    df.sparkSession.dataSource.register(WholeFiles)
    df.select("name", "content").write.format(FORMAT).option("path", path).mode("append").save()
