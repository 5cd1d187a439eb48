"""A data source that lists files, empty ones too, without reading them.

Folders are walked breadth-first on the driver only until there are enough of
them to share out; tasks list what lies below. With
spark.sql.python.filterPushdown.enabled, filters on the top folder leave whole
tasks out and filters on the length are applied where files are listed.
"""

from __future__ import annotations

import operator
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning and listing workers may lack the package

SCHEMA = "path string, folder string, name string, length long"
FOLDERS = 256  # folders to share out, at least, where there are as many
PER_TASK = 8  # folders of a task, at most, but for more than 32 times FOLDERS of them
ROWS = 10_000  # files of an Arrow batch
ORDERS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path within it, and what to put before such a path to name it as Spark does."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path.rstrip("/") or "/", "file:"
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.strip("/"), "file:"
    system, inner = fs.FileSystem.from_uri(("s3:" if scheme in ("s3a", "s3n") else scheme + ":") + rest)
    inner = inner.rstrip("/") or "/"
    return system, inner, path.rstrip("/").removesuffix(inner.lstrip("/")).rstrip("/") + ("/" if not inner.startswith("/") else "")


def hidden(info: fs.FileInfo) -> bool:
    return info.base_name.startswith(("_", "."))


def listed(system: fs.FileSystem, folder: str) -> tuple[list[str], list[fs.FileInfo]]:
    """Folders and files right below a folder, in order of their names, but for hidden ones."""
    found = sorted((i for i in system.get_file_info(fs.FileSelector(folder)) if not hidden(i)), key=lambda i: i.path)
    return [i.path for i in found if i.type == fs.FileType.Directory], [i for i in found if i.type == fs.FileType.File]


class Share(InputPartition):
    """Folders of one task: those listed alone, and those with all that lies below."""

    def __init__(self, alone: list[str], below: list[str]):
        super().__init__((alone, below))
        self.alone, self.below = alone, below


class ListingReader(DataSourceReader):
    def __init__(self, root: str, folders: int = FOLDERS):
        self.root, self.folders = root, folders
        self.tops: set[str] | None = None
        self.lengths: list[tuple[type, int]] = []

    def top(self, inner: str, folder: str) -> str:
        """The first folder below the root on the way to `folder`; '' for the root itself."""
        return folder[len(inner.rstrip("/")) + 1 :].partition("/")[0]

    def wanted(self, inner: str, folder: str) -> bool:
        return self.tops is None or self.top(inner, folder) in self.tops

    def partitions(self) -> list[Share]:
        system, inner, _ = opened(self.root)
        if system.get_file_info(inner).type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        if system.get_file_info(inner).type == fs.FileType.File:
            return [Share([inner], [])] if self.wanted(inner, inner) else []
        passed, open_ = [], [inner]
        while open_ == [inner] or 0 < len(open_) < self.folders:  # the root always, so that whole shares lie below one top folder
            inside = [f for folder in open_ for f in listed(system, folder)[0] if self.wanted(inner, f)]
            passed += [f for f in open_ if self.wanted(inner, f)]
            open_ = inside
        per = max(PER_TASK, -(-len(open_) // (32 * self.folders)))
        cut = lambda x: [x[i : i + per] for i in range(0, len(x), per)]
        return [Share(x, []) for x in cut(passed)] + [Share([], x) for x in cut(open_)] or [Share([], [])]

    def files(self, system: fs.FileSystem, share: Share) -> Iterator[fs.FileInfo]:
        for path in share.alone:
            info = system.get_file_info(path)
            yield from [info] if info.type == fs.FileType.File else listed(system, path)[1]
        waiting = list(share.below)
        while waiting:
            folders, found = listed(system, waiting.pop())
            waiting += folders
            yield from found

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        system, inner, before = opened(self.root)
        rows = []
        for i in self.files(system, partition):
            if all(ORDERS[kind](i.size, value) for kind, value in self.lengths):
                folder = i.path[: -len(i.base_name) - 1]
                rows.append((before + i.path, self.top(inner, folder), i.base_name, i.size))
            if len(rows) == ROWS:
                yield batch(rows)
                rows = []
        yield batch(rows)


class PruningReader(ListingReader):
    """Takes filters on folder (=, IN) and length; Spark applies the rest."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if f.attribute == ("folder",) and isinstance(f, EqualTo | In):
                these = set(f.value) if isinstance(f, In) else {f.value}
                self.tops = these if self.tops is None else self.tops & these
            elif f.attribute == ("length",) and type(f) in ORDERS and f.value is not None:
                self.lengths.append((type(f), f.value))
            elif not isinstance(f, IsNotNull):  # no column is ever null
                yield f


def batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "folder", "name", "length"])


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = PruningReader if self.options.get("pushdown") == "true" else ListingReader
        return kind(self.options["path"], int(self.options.get("folders", FOLDERS)))


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """path, folder (the first below `path`, '' for none), name and length of every file below `path`.

    `path` is a folder or one file, local or of a system that Arrow opens by its
    URI; patterns aren't expanded and a missing path is an error. Names that begin
    with _ or . are left out, as by Spark's own file sources. A folder's direct
    files are listed by one task.
    """
    spark.dataSource.register(Listing)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("file_listing").option("pushdown", pushdown).load(path)
