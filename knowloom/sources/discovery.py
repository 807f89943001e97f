"""Folder discovery as a Spark data source, batch and streaming: directories are listed and files read in tasks.

``spark.read.format("folder_listing")`` and ``spark.readStream.format("folder_listing")`` return the rows of
``folder.scan_folder`` with size and change time. Excluded folders are never entered and excluded files never opened.
The folders must be mounted on every worker; for stores that only Spark reads, use ``folder.scan_folder``.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from knowloom.sources.folder import DEFAULT_EXCLUDES, DEFAULT_EXTENSIONS, MIME_TYPES

SCHEMA = "external_id string, object_type string, content_hash string, mime_type string, content_ref string, size long, changed long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_BLOCK = 1 << 20
_ROWS = 1024


@dataclass
class Folder(InputPartition):
    """One directory of a task: with all that lies below it, or its own files only."""

    root: int
    path: str
    below: bool
    since: int = -1
    until: int = 1 << 62


class _Walker:
    def __init__(self, options: dict[str, str]) -> None:
        self.roots = [r.rstrip("/") for r in json.loads(options["roots"])]
        self.extensions = {e.lower() for e in json.loads(options.get("extensions", json.dumps(DEFAULT_EXTENSIONS)))}
        self.globs = json.loads(options.get("excludes", json.dumps(DEFAULT_EXCLUDES)))
        self.tasks = int(options.get("tasks", "64"))
        self._globs = [re.compile(fnmatch.translate(g)) for g in self.globs]

    def _excluded(self, path: str) -> bool:
        return any(g.match(path) for g in self._globs)

    def external_id(self, root: int, path: str) -> str:
        below = path[len(self.roots[root]) + 1:]
        return f"{root}/{below}" if len(self.roots) > 1 else below

    def skips(self, root: int, path: str) -> bool:
        """A directory is left out by its own absolute path, or if a glob that ends with ``*`` covers all that it can hold."""
        inside = self.external_id(root, path) + "/"
        return self._excluded(path) or any(glob.endswith("*") and g.match(inside) for glob, g in zip(self.globs, self._globs, strict=True))

    def entries(self, root: int, path: str) -> tuple[list[str], list[os.DirEntry]]:
        """Directories to enter and files to read, by name. Symbolic links are skipped."""
        folders, files = [], []
        with os.scandir(path) as found:
            for e in sorted(found, key=lambda e: e.name):
                if e.is_symlink():
                    continue
                if e.is_dir():
                    if not self.skips(root, e.path):
                        folders.append(e.path)
                elif os.path.splitext(e.name)[1].lower() in self.extensions and not self._excluded(self.external_id(root, e.path)):
                    files.append(e)
        return folders, files

    def folders(self, since: int = -1, until: int = 1 << 62) -> list[Folder]:
        """Directories level by level until there is one for every task; what was opened for that keeps only its own files."""
        out: list[Folder] = []
        level = [(i, r) for i, r in enumerate(self.roots) if not self.skips(i, r)]
        while level and len(out) + len(level) < self.tasks:
            deeper = []
            for root, path in level:
                out.append(Folder(root, path, False, since, until))
                deeper += [(root, p) for p in self.entries(root, path)[0]]
            level = deeper
        return out + [Folder(root, path, True, since, until) for root, path in level]

    def read(self, part: Folder) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        stack = [part.path]
        while stack:
            folders, files = self.entries(part.root, stack.pop())
            if part.below:
                stack += reversed(folders)
            for e in files:
                stat = e.stat()
                # A file that was renamed into the folder keeps its content time but not its change time.
                changed = max(stat.st_mtime_ns, stat.st_ctime_ns)
                if not part.since < changed <= part.until:
                    continue
                rows.append((self.external_id(part.root, e.path), "file", _digest(e.path), MIME_TYPES.get(os.path.splitext(e.name)[1].lower()), e.path, stat.st_size, changed))
                if len(rows) == _ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _digest(path: str) -> str:
    state = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(_BLOCK):
            state.update(block)
    return state.hexdigest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string()] * 5 + [pa.int64()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.walker = _Walker(options)

    def partitions(self) -> list[Folder]:
        return self.walker.folders()

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return self.walker.read(partition)


class _StreamReader(DataSourceStreamReader):
    """Offset: change time in nanoseconds up to which files were read. Files of the last ``settle`` seconds wait for the next batch."""

    def __init__(self, options: dict[str, str]) -> None:
        self.walker = _Walker(options)
        self.settle = int(float(options.get("settle", "1")) * 1e9)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": "-1"}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": str(time.time_ns() - self.settle)}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return self.walker.folders(int(start["until"]), int(end["until"]))

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return self.walker.read(partition)


class FolderListing(DataSource):
    """Options: roots, extensions, excludes (JSON lists), tasks (directories to deal to tasks), settle (seconds, streaming)."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))


def _options(roots: list[str], extensions: tuple[str, ...], excludes: tuple[str, ...], **more) -> dict[str, str]:
    return {"roots": json.dumps(roots), "extensions": json.dumps(extensions), "excludes": json.dumps(excludes), **{k: str(v) for k, v in more.items()}}


def list_folders(
    spark: SparkSession, roots: list[str], extensions: tuple[str, ...] = DEFAULT_EXTENSIONS, excludes: tuple[str, ...] = DEFAULT_EXCLUDES, tasks: int = 64
) -> DataFrame:
    """All kept files below the roots. With several roots the external id starts with the root's index."""
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").options(**_options(roots, extensions, excludes, tasks=tasks)).load()


def watch_folders(
    spark: SparkSession, roots: list[str], extensions: tuple[str, ...] = DEFAULT_EXTENSIONS, excludes: tuple[str, ...] = DEFAULT_EXCLUDES,
    tasks: int = 64, settle: float = 1.0,
) -> DataFrame:
    """Stream of new and changed files; where it stopped is in the query's checkpoint."""
    spark.dataSource.register(FolderListing)
    return spark.readStream.format("folder_listing").options(**_options(roots, extensions, excludes, tasks=tasks, settle=settle)).load()
