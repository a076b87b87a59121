"""A streaming source of the files that arrive in a folder (X1): their inventory, without bytes.

Spark's file source gives no row for an empty file or a name starting with ``_`` or ``.``,
and remembers every path it has seen. Here a position is a point in time: a micro-batch is
the files whose *arrival* lies after its start and not after its end, so nothing of earlier
batches is kept or read. A file's arrival is the later of its modification and its inode
change (a file moved into the folder arrives when it is moved); on a remote store, its
modification. A file that is written again arrives again, and one that is still being
written arrives with the batch in which its writing ended.

The driver only names the directories directly under the root. Tasks walk some of them each,
``parts`` tasks the same ones, which share what is in them by a hash of the names, and stat
what they list, so the rows are an inventory (``INVENTORY_PROBED`` and ``arrival``) and no file is probed again.

A store may show a file a little later than the time it stamps on it: the end of a batch is
fixed, and listing begins ``settle`` seconds after it. It must be at least the clocks'
difference. Files that are gone when they are listed are not part of the batch.
"""

from __future__ import annotations

import fnmatch
import os
import time
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .files import INVENTORY_PROBED, _remote, _remote_fs, _stat_one

NAME = "textbarge_drop_folder"
SCHEMA = INVENTORY_PROBED + ", arrival bigint"
#: Rows in an Arrow batch; directories that a task walks; tasks that walk the same ones (of a local folder), each for a share of the names.
ROWS, FOLDERS, PARTS, SETTLE = 1000, 16, 4, 1.0


class Share(InputPartition):
    """The names in ``folders`` that hash to ``part``: all below a folder, or (the root, not ``deep``) its own files only."""

    def __init__(self, folders: list[tuple[str, bool]], part: int, parts: int, start: int, end: int):
        self.folders, self.part, self.parts, self.start, self.end = folders, part, parts, start, end


def _mine(name: str, share: Share) -> bool:
    return zlib.crc32(name.encode("utf-8", "surrogateescape")) % share.parts == share.part


def _local(share: Share, glob: str | None) -> Iterator[tuple]:
    folders = list(share.folders)
    while folders:
        folder, deep = folders.pop()
        try:
            with os.scandir(folder) as entries:
                listed = [(e.name, e.path, e.is_dir(follow_symlinks=False)) for e in entries]
        except (FileNotFoundError, NotADirectoryError):
            continue
        for name, path, is_dir in listed:
            if is_dir:
                if deep:
                    folders.append((path, True))
            elif _mine(name, share) and (glob is None or fnmatch.fnmatchcase(name, glob)):
                try:
                    st = os.lstat(path)
                except OSError:
                    continue
                arrival = max(st.st_mtime_ns, st.st_ctime_ns)
                if share.start < arrival <= share.end:
                    row = _stat_one(path, {})
                    if row[1]:
                        yield (*row, arrival)


def _listed(folder: str, deep: bool) -> list:
    """(URI, info) of what a remote folder holds."""
    from pyarrow import fs as pafs
    fs, inner = _remote_fs(folder, {})
    head = folder[:len(folder) - len(inner)] if folder.endswith(inner) else folder.split("://")[0] + "://"
    return [(head + i.path, i) for i in fs.get_file_info(pafs.FileSelector(inner, recursive=deep, allow_not_found=True))]


def _stored(share: Share, glob: str | None) -> Iterator[tuple]:
    from pyarrow import fs as pafs
    for path, info in (x for folder, deep in share.folders for x in _listed(folder, deep)):
        if info.type == pafs.FileType.File and share.start < info.mtime_ns <= share.end and (
                glob is None or fnmatch.fnmatchcase(info.base_name, glob)):
            yield path, True, False, True, True, int(info.size), int(info.size), info.mtime_ns


class Reader(DataSourceStreamReader):
    def __init__(self, options):
        root = options["path"]
        self.root = (root if _remote(root) else os.path.abspath(root.removeprefix("file://").removeprefix("file:"))).rstrip("/")
        self.glob = options.get("glob")
        self.parts = max(1, int(options.get("parts", PARTS)))
        self.settle = float(options.get("settle", SETTLE))

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        until = time.time_ns()
        time.sleep(self.settle)
        return {"until": until}

    def _folders(self) -> list[str]:
        if _remote(self.root):
            from pyarrow import fs as pafs
            return [p for p, i in _listed(self.root, False) if i.type == pafs.FileType.Directory]
        try:
            with os.scandir(self.root) as entries:
                return [e.path for e in entries if e.is_dir(follow_symlinks=False)]
        except FileNotFoundError:
            return []

    def partitions(self, start: dict, end: dict) -> list[Share]:
        parts = 1 if _remote(self.root) else self.parts
        folders = [(self.root, False), *((f, True) for f in sorted(self._folders()))]
        return [Share(folders[a:a + FOLDERS], i, parts, start["until"], end["until"])
                for a in range(0, len(folders), FOLDERS) for i in range(parts)]

    def read(self, partition: Share):
        import pyarrow as pa
        fields = [f.strip().split(" ") for f in SCHEMA.split(",")]
        schema = pa.schema([(n, {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}[t]) for n, t in fields])
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

        for row in (_stored if _remote(self.root) else _local)(partition, self.glob):
            held.append(row)
            if len(held) == ROWS:
                yield batch()
                held = []
        if held:
            yield batch()

    def commit(self, end: dict) -> None:
        """Nothing is kept for a batch."""


class DropFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)


def arrivals(spark: SparkSession, root: str, glob: str | None = None, settle: float = SETTLE, parts: int = PARTS) -> DataFrame:
    """Stream of the inventory rows of files arriving under ``root``, recursively."""
    from ..session import ship_package
    ship_package(spark)
    spark.dataSource.register(DropFolder)
    r = spark.readStream.format(NAME).option("settle", str(settle)).option("parts", str(parts))
    return (r if glob is None else r.option("glob", glob)).load(root)
