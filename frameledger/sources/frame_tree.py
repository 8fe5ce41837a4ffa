"""A data source for trees of frame files: root/subject/[wrapper/]*/class/clip*/rgb|annotation/frame_N.png.

Subjects are the partitions, so a scan of many contributors spreads over the cluster. Any file system that Arrow opens will
do (a path without a scheme is local). Unlike Spark's own file source it lists empty files, and it says what it rejects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from frameledger.constants import FRAME_PATTERN, GESTURES

_SCHEMA = "subject string, gesture string, clip string, kind string, frame bigint, path string, length bigint, problem string"
_BATCH = 4096
_CONTENT_BYTES = 16 << 20


class Subject(InputPartition):
    def __init__(self, name: str):
        self.name = name


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


def judged(step: list[str], length: int) -> tuple[str, str, str, int | None, str | None] | None:
    """(class, clip, kind, frame, problem) of a file by the steps of its path under the subject; None for what is no frame of a known class."""
    if len(step) < 4 or step[-4] not in GESTURES or not step[-3].startswith("clip") or step[-2] not in ("rgb", "annotation"):
        return None
    found = re.match(FRAME_PATTERN, step[-1])
    if not found:
        return None
    number = int(found[1])
    if number >= 1 << 63:
        return step[-4], step[-3], step[-2], None, "frame number beyond 64 bits"
    return step[-4], step[-3], step[-2], number, None if length else "empty file"


class _Reader(DataSourceReader):
    def __init__(self, root: str, content: bool):
        self.root, self.content = root, content

    def partitions(self) -> Sequence[InputPartition]:
        system, base = _place(self.root)
        return [Subject(f.base_name) for f in sorted(system.get_file_info(fs.FileSelector(base)), key=lambda f: f.base_name) if f.type == fs.FileType.Directory] or [Subject("")]

    def read(self, partition: Subject) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, base = _place(self.root)
        top = f"{base.rstrip('/')}/{partition.name}"
        rows, size = [], 0
        for f in system.get_file_info(fs.FileSelector(top, recursive=True)):
            if f.type != fs.FileType.File:
                continue
            found = judged(f.path[len(top) + 1 :].split("/"), f.size)
            if found is None:
                continue
            row = (partition.name, *found[:4], f.path, f.size, found[4])
            if self.content:
                with system.open_input_stream(f.path) as stream:
                    row = (*row, stream.read())
                size += f.size
            rows.append(row)
            if len(rows) == _BATCH or size >= _CONTENT_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * self.content
        names = [c.split()[0] for c in _SCHEMA.split(", ")] + ["content"] * self.content
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class FrameTree(DataSource):
    """Options: path (the root), content (`true` reads the bytes, too)."""

    @classmethod
    def name(cls) -> str:
        return "frame_tree"

    def _content(self) -> bool:
        return self.options.get("content", "false").lower() == "true"

    def schema(self) -> str:
        return _SCHEMA + (", content binary" if self._content() else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._content())


def frame_tree(spark: SparkSession, root: str, content: bool = False) -> tuple[DataFrame, DataFrame]:
    """(frames, rejects) of the files under `root`. Rejects are frame files that are empty or whose number is no 64-bit one.

    Files of other names, and of folders that are no known class or clip, are neither. Without `content` no byte is read.
    """
    spark.dataSource.register(FrameTree)
    files = spark.read.format("frame_tree").option("content", str(content).lower()).load(root)
    return files.where("problem is null").drop("problem"), files.where("problem is not null")
