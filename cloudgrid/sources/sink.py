"""A sink of whole files with commit: ``rows.write.format("blobs").mode("append").save(folder)`` of rows (name, content).

A task writes under a name of its own attempt; files get their names only when all tasks have succeeded, and whatever was written is
removed when one has not, so neither a task that runs twice nor one that is lost leaves a file over.  Folders are reached through Arrow's
file systems (local paths, and those of hdfs, s3 or gs where Arrow has them); others are refused before anything is written.
"""

from __future__ import annotations

import posixpath
import re
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.LocalFileSystem(), path
    try:
        return fs.FileSystem.from_uri(path)
    except Exception as e:
        raise ValueError(f"no file system is known here for {path}: {e}") from e


@dataclass
class Written(WriterCommitMessage):
    """What one attempt of a task wrote: (name, where it is)."""

    files: list[tuple[str, str]]


class BlobWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, f"_attempts-{uuid.uuid4().hex}"
        disk, at = place(path)  # refused here, not in a task
        disk.create_dir(posixpath.join(at, self.job))  # tasks only write below it, so none brings it back once it is gone

    def write(self, rows: Iterator) -> Written:
        disk, at = place(self.path)
        own = posixpath.join(at, self.job, uuid.uuid4().hex)
        disk.create_dir(own, recursive=False)
        files, out = [], None
        try:
            for r in rows:
                if not r.name or r.name.startswith((".", "_")) or "/" in r.name:
                    raise ValueError(f"{r.name!r} is no name of a file")
                if nth := getattr(r, "piece", 0):
                    if not files or (r.name, nth) != (files[-1][0], last + 1):
                        raise ValueError(f"piece {nth} of {r.name!r} doesn't follow the one before")
                else:
                    if out:
                        out.close()
                    files.append((r.name, posixpath.join(own, str(len(files)))))
                    out = disk.open_output_stream(files[-1][1])
                out.write(bytes(r.content or b""))
                last = nth
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        disk, at = place(self.path)
        files = [f for m in messages if m for f in m.files]
        twice = [n for n, k in Counter(n for n, _ in files).items() if k > 1]
        if twice:
            raise ValueError(f"several rows have the name {twice[0]!r}")
        disk.create_dir(at)
        for name, where in files:
            disk.move(where, posixpath.join(at, name))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self):
        disk, at = place(self.path)
        left = posixpath.join(at, self.job)
        for again in range(5):  # a task that is being stopped may write while files go
            try:
                if disk.get_file_info(left).type == fs.FileType.Directory:
                    disk.delete_dir(left)
                return
            except OSError:
                if again == 4:
                    raise
                time.sleep(0.2)


class Blobs(DataSource):
    """Options: path, a folder."""

    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> BlobWriter:
        if overwrite:
            raise ValueError("files are added to a folder: mode append")
        return BlobWriter(self.options["path"])


def write_each(rows: DataFrame, folder: str) -> None:
    """Rows (name, content) as one file each."""
    rows.sparkSession.dataSource.register(Blobs)
    rows.select("name", "content").write.format("blobs").mode("append").save(folder)


def write_pieces(rows: DataFrame, folder: str) -> None:
    """Rows (name, content, piece) as files of several rows: a file's pieces 0, 1, 2, ... lie one after another in one partition, and only one is held."""
    rows.sparkSession.dataSource.register(Blobs)
    rows.select("name", "content", "piece").write.format("blobs").mode("append").save(folder)
