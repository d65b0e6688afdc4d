"""File trees with every file in them, read by byte ranges.

Spark's own readers leave out names that start with a dot or an underscore, the usual home of secrets, and take a file as
one row. Here a data source lists the tree: the driver walks its top until there are enough folders, and each of
those is walked by a task. Files are then cut into pieces of bounded size. A piece holds the lines that begin in its byte
range, and the line counts of the pieces before it make their numbers whole.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keysieve.functions import paths

PIECE_BYTES = 8 << 20
FOLDERS = 256                 # how many folders the driver looks for before tasks take over
BATCH_BYTES = 4 << 20
_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]+):(?://(?=/)|(?=/[^/]))?")
_BREAK = re.compile(rb"\r\n|[\r\n]")
_CHUNK = 1 << 16


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root and its absolute path there. Without a scheme it is a path that all executors share."""
    scheme = _SCHEME.match(root)
    if scheme is None or scheme.group(1) == "file":
        return fs.LocalFileSystem(), os.path.abspath(root[scheme.end():] if scheme else root)
    return fs.FileSystem.from_uri(root)


def absolute(root: str) -> str:
    """The root as tasks can use it, whose working folder is another one."""
    files, base = open_root(root)
    return base if isinstance(files, fs.LocalFileSystem) else root


def can_open(root: str) -> bool:
    """Whether the tree's store can be reached without Spark's readers."""
    try:
        open_root(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _is_link(files: fs.FileSystem, path: str) -> bool:
    return isinstance(files, fs.LocalFileSystem) and os.path.islink(path)


class _Folder(InputPartition):
    """A folder below the root, and whether its subfolders belong to the partition too."""

    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.depth = int(options.get("max_depth", -1))
        self.ignored = [g for g in options.get("ignore_list", "").split("\0") if g]
        self.folders = int(options.get("folders", FOLDERS))

    def _children(self, files: fs.FileSystem, base: str, folder: str) -> Iterator[tuple[str, fs.FileInfo]]:
        """Names relative to the root, without folders that pruning takes whole. Links to folders are not followed, as
        they can lead in circles."""
        for info in files.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base)):
            name = f"{folder}/{info.base_name}" if folder else info.base_name
            if info.type == fs.FileType.Directory and (
                    _is_link(files, info.path) or 0 <= self.depth < name.count("/") + 1
                    or any(fnmatchcase(name, glob) for glob in self.ignored)):
                continue
            yield name, info

    def partitions(self) -> Sequence[InputPartition]:
        files, base = open_root(self.root)
        if files.get_file_info(base).type == fs.FileType.File:
            return [_Folder("", False)]
        ahead, passed = deque([""]), []
        while ahead and len(ahead) + len(passed) < self.folders:
            folder = ahead.popleft()
            passed.append(_Folder(folder, False))
            ahead.extend(n for n, info in self._children(files, base, folder) if info.type == fs.FileType.Directory)
        return [*passed, *(_Folder(folder, True) for folder in ahead)]

    def read(self, partition: _Folder) -> Iterator[tuple[str, int]]:
        files, base = open_root(self.root)
        info = files.get_file_info(base)
        if info.type == fs.FileType.File:
            yield info.base_name, info.size
            return
        ahead = [partition.path]
        while ahead:
            for name, info in self._children(files, base, ahead.pop()):
                if info.type == fs.FileType.File:
                    yield name, info.size
                elif info.type == fs.FileType.Directory and partition.deep:
                    ahead.append(name)


class TreeSource(DataSource):
    """``spark.read.format("file_tree").load(root)``: (file_name, size) of every file below the root, or of the one it names."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "file_name string, size long"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TreeReader(self.options)


def list_tree(spark: SparkSession, root: str, max_depth: int = -1, ignore_list: Sequence[str] = (), folders: int = FOLDERS) -> DataFrame:
    """(file_name, size) of the files that survive pruning. A missing root raises FileNotFoundError."""
    files, base = open_root(root)
    if files.get_file_info(base).type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{root} does not exist")
    spark.dataSource.register(TreeSource)
    listed = (spark.read.format("file_tree").option("max_depth", max_depth).option("ignore_list", "\0".join(ignore_list))
              .option("folders", folders).load(absolute(root)))
    return listed.filter(paths.keep_path(F.col("file_name"), max_depth, ignore_list))


def pieces(listed: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(file_name, size, start, stop, n_pieces): the byte ranges of every file, dealt out evenly. Empty files have none."""
    # As many tasks as there are cores, or one for every 64 MB if that is more.
    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(listed.sparkSession.sparkContext.defaultParallelism, total // (64 << 20) + 1)
    step = F.lit(piece_bytes).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)
    return (listed.filter("size > 0").select("file_name", "size", F.explode(starts).alias("start"), F.size(starts).alias("n_pieces"))
            .withColumn("stop", F.least(F.col("start") + step, "size")).repartition(tasks, "file_name", "start"))


class _Bytes:
    """Line starts and byte ranges of one file."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size = file, size

    def line_start(self, at: int, limit: int) -> int | None:
        """The first place from ``at`` on, and before ``limit``, where a line begins; the end of the file counts as one."""
        if at in (0, self.size):
            return at
        before, here = self.file.read_at(2, at - 1)
        if before == 10 or before == 13 and here != 10:
            return at
        while at < min(limit, self.size):
            chunk = self.file.read_at(_CHUNK + 1, at)
            found = _BREAK.search(chunk, 0)
            if found and found.start() < _CHUNK:
                end = at + found.end()
                return end if end < limit or end == limit == self.size else None
            at += _CHUNK
        return self.size if limit >= self.size else None

    def lines(self, start: int, stop: int) -> bytes:
        """The lines that begin in a range. A piece inside a long line has none and reads no further than its end."""
        begin = self.line_start(start, stop)
        if begin is None or begin >= stop:
            return b""
        return self.file.read_at(self.line_start(stop, self.size + 1) - begin, begin)


def _reading(root: str, whole: bool, counting: bool, schema: pa.Schema):
    root = absolute(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_root(root)
        single = files.get_file_info(base).type == fs.FileType.File
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(base if single else f"{base}/{row['file_name']}") as file:
                    data = file.read_at(row["size"], 0) if whole else _Bytes(file, row["size"]).lines(row["start"], row["stop"])
                if not whole:
                    row["lines"] = len(data.splitlines())
                    try:
                        data = data.decode("utf-8")
                    except UnicodeDecodeError:
                        data = None
                    row["valid"] = data is not None
                row["content"] = None if counting else data
                rows.append({k: row[k] for k in schema.names})
                held += 0 if counting else row["size"] if whole else row["stop"] - row["start"]
                if held >= BATCH_BYTES or len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    return read


def read_whole(listed: DataFrame, root: str) -> DataFrame:
    """(file_name, content): every file as one binary value."""
    schema = pa.schema([("file_name", pa.string()), ("content", pa.binary())])
    spread = listed.repartition(listed.sparkSession.sparkContext.defaultParallelism, "file_name")
    return spread.mapInArrow(_reading(root, True, False, schema), "file_name string, content binary")


def read_pieces(cut: DataFrame, root: str) -> DataFrame:
    """(file_name, start, n_pieces, content): the lines of every piece as text, null if they are not UTF-8."""
    schema = pa.schema([("file_name", pa.string()), ("start", pa.int64()), ("n_pieces", pa.int32()), ("content", pa.string())])
    return cut.mapInArrow(_reading(root, False, False, schema), "file_name string, start long, n_pieces int, content string")


def lines_before(cut: DataFrame, root: str) -> DataFrame:
    """(file_name, start, lines_before, utf8) of the pieces of files that have several: a sum over counts, one row a piece."""
    schema = pa.schema([("file_name", pa.string()), ("start", pa.int64()), ("lines", pa.int64()), ("valid", pa.bool_())])
    counted = cut.filter("n_pieces > 1").mapInArrow(_reading(root, False, True, schema), "file_name string, start long, lines long, valid boolean")
    file = W.partitionBy("file_name")
    earlier = file.orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    return counted.select("file_name", "start", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("lines_before"),
                          F.min("valid").over(file).alias("utf8"))


def numbered(rows: DataFrame, before: DataFrame) -> DataFrame:
    """Rows with (file_name, start, n_pieces, line_number) numbered in their whole file; those of a file that is not UTF-8
    in one of its pieces go."""
    joined = rows.join(before, ["file_name", "start"], "left")
    return (joined.filter((F.col("n_pieces") == 1) | F.col("utf8"))
            .withColumn("line_number", (F.col("line_number") + F.coalesce("lines_before", F.lit(0))).cast("int"))
            .select(*[c for c in rows.columns if c not in ("start", "n_pieces")]))
