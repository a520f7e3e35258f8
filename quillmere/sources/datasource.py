"""Documents as a Spark data source: ``spark.read.format("documents")`` and ``spark.readStream``.

A registry of loaders becomes a format of its own: a partition for each file, so that files are parsed in
parallel and a lost task parses its own again; filters on loader, stem or path leave files unopened; and
a stream takes the files that came since the last batch. Folders may be in any store that Arrow's file
systems reach.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from . import SCHEMA, Registry


@dataclass
class _File(InputPartition):
    path: str
    loader: str


def _open(folder: str):
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def _listed(folder: str, loaders: dict) -> list[tuple[int, str, str]]:
    """(time, path, loader) of the supported files right in a folder, in order of time and name."""
    from pyarrow import fs

    store, root = _open(folder)
    found = []
    for f in store.get_file_info(fs.FileSelector(root)):
        suffix = posixpath.splitext(f.path)[1].lower()
        if f.type == fs.FileType.File and suffix in loaders:
            found.append((f.mtime_ns or 0, f.path, loaders[suffix][0]))
    return sorted(found)


def _row(folder: str, part: _File, loaders: dict) -> tuple:
    """A file's row; one that fails to parse is a row with its error."""
    store, _ = _open(folder)
    with store.open_input_file(part.path) as f:
        content = f.read()
    name, suffix = posixpath.splitext(posixpath.basename(part.path))
    parse = loaders[suffix.lower()][1]
    try:
        if parse is None:
            text, blocks = content.decode("utf-8").removeprefix("﻿"), None
        else:
            text, blocks = parse(content)
        error = None if text.strip() else "empty"
    except Exception as e:  # any failure of a parser belongs to its file
        text, blocks, error = None, None, type(e).__name__
    return part.path, name, part.loader, text, blocks, error


class _Reader(DataSourceReader):
    def __init__(self, folder: str, loaders: dict):
        self.folder, self.loaders, self.wanted = folder, loaders, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if values is not None and f.attribute in (("loader",), ("stem",), ("path",)):
                self.wanted.append((f.attribute[0], set(values)))
            else:
                yield f

    def partitions(self) -> list[_File]:
        stem = lambda p: posixpath.splitext(posixpath.basename(p))[0]
        files = [(path, loader) for _, path, loader in _listed(self.folder, self.loaders)]
        for column, values in self.wanted:
            files = [f for f in files if {"path": f[0], "stem": stem(f[0]), "loader": f[1]}[column] in values]
        return [_File(*f) for f in files]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition is not None:
            yield _row(self.folder, partition, self.loaders)


class _Stream(DataSourceStreamReader):
    """An offset is the time of the newest file that was taken, and the names taken at that time."""

    def __init__(self, folder: str, loaders: dict):
        self.folder, self.loaders = folder, loaders

    def initialOffset(self) -> dict:
        return {"time": -1, "names": []}

    def latestOffset(self) -> dict:
        files = _listed(self.folder, self.loaders)
        newest = max((t for t, _, _ in files), default=-1)
        return {"time": newest, "names": [p for t, p, _ in files if t == newest]}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        new = lambda t, p, o: t > o["time"] or (t == o["time"] and p not in o["names"])
        return [_File(p, loader) for t, p, loader in _listed(self.folder, self.loaders) if new(t, p, start) and not new(t, p, end)]

    def read(self, partition: _File) -> Iterator[tuple]:
        yield _row(self.folder, partition, self.loaders)


def register(spark: SparkSession, registry: Registry | None = None, name: str = "documents") -> None:
    """Make the loaders of ``registry`` the format ``name`` of this session, with its filters pushed down."""
    loaders, short = dict((registry or Registry())._by), name

    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return short

        def schema(self) -> str:
            return SCHEMA

        def _folder(self) -> str:
            if not self.options.get("path"):
                raise ValueError("load() takes the folder of the documents")
            return self.options["path"]

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self._folder(), loaders)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(self._folder(), loaders)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Documents)
