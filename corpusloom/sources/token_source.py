"""Flat binary token files as a data source: `spark.read.format("token_file")` and `df.write.format("token_file")`.

A folder holds files of ids without any header, one after the other the stream, and `_manifest.json`, which
names them in order with their sizes and the width of an id.  Readers go by the manifest.  Tasks write
drafts to a hidden folder; when all have finished, the driver gives the files their names and puts the new manifest in
the place of the old one, in one step, so what is read is the state before a job or after it.  A job
that fails deletes its drafts; what a dead driver leaves is in no manifest.  Files made elsewhere, without a
manifest, are read in the order of their names.

Options: `dtype` of an id, `block` ids a row (the last of a file may have fewer) and, when reading, `stretch`,
the bytes of a partition.  Paths are those that pyarrow's file systems open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, start long, place long, ids array<int>"
MANIFEST, DTYPE, BLOCK, STRETCH = "_manifest.json", "<u2", 4096, 32 << 20


class TokenFile(NamedTuple):
    name: str
    tokens: int


def local_uri(path: str) -> str:
    """Spark's file:/x as file:///x; other paths as they are."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    system, name = fs.FileSystem.from_uri(local_uri(path))
    return system, name.rstrip("/")


def manifest(path: str) -> dict | None:
    """The manifest of a folder: dtype, tokens, files (name, tokens); None where there is none."""
    system, folder = _folder(path)
    name = f"{folder}/{MANIFEST}"
    if system.get_file_info(name).type != fs.FileType.File:
        return None
    with system.open_input_file(name) as f:
        return json.loads(f.read())


def _files(path: str, width: int) -> list[TokenFile]:
    """The files of a path, in order, by their full names."""
    system, folder = _folder(path)
    known = manifest(path)
    if known is not None:
        return [TokenFile(f"{folder}/{f['name']}", f["tokens"]) for f in known["files"]]
    info = system.get_file_info(folder)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(folder))
        infos = sorted((i for i in found if i.type == fs.FileType.File and i.base_name.endswith(".bin") and i.base_name[0] not in "_."), key=lambda i: i.path)
    else:
        infos = [info] if info.type == fs.FileType.File else []
    if not infos:
        raise FileNotFoundError(f"{path} holds no token files, or none of a job that has finished")
    return [TokenFile(i.path, i.size // width) for i in infos]


@dataclass
class Stretch(InputPartition):
    """`count` ids of a file from id `start` on; `place` is the number of ids before it in all files."""

    path: str
    start: int
    place: int
    count: int


class TokenReader(DataSourceReader):
    def __init__(self, path: str, dtype: str, block: int, stretch: int):
        self.path, self.dtype, self.block, self.width = path, dtype, block, np.dtype(dtype).itemsize
        self.rows = max(1, stretch // (self.width * block))

    def partitions(self) -> list[InputPartition]:
        """A partition for each stretch of bytes: whole rows, none across two files."""
        out: list[InputPartition] = []
        before, size = 0, self.rows * self.block
        for f in _files(self.path, self.width):
            out += [Stretch(f.name, at, before + at, min(size, f.tokens - at)) for at in range(0, f.tokens, size)]
            before += f.tokens
        return out or [Stretch("", 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, _ = _folder(self.path)
        with system.open_input_file(partition.path) as f:
            f.seek(partition.start * self.width)
            for at in range(0, partition.count, self.block):
                n = min(self.block, partition.count - at)
                raw = f.read(n * self.width)
                if len(raw) < n * self.width:
                    raise OSError(f"{partition.path} is shorter than its manifest says")
                ids = np.frombuffer(raw, self.dtype).astype("int32")
                columns = [[partition.path], [partition.start + at], [partition.place + at], [ids]]
                types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "start", "place", "ids"])


@dataclass
class Draft(WriterCommitMessage):
    part: int
    name: str
    tokens: int


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, dtype: str, at: int, overwrite: bool):
        self.path, self.dtype, self.at, self.overwrite, self.job = path, dtype, at, overwrite, uuid.uuid4().hex[:12]

    @property
    def drafts(self) -> str:
        return f"{_folder(self.path)[1]}/_drafts-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Draft:
        """The ids of a partition's rows, in their order, as a draft of their own."""
        from pyspark import TaskContext

        task, limit = TaskContext.get(), np.iinfo(self.dtype).max
        system, _ = _folder(self.path)
        system.create_dir(self.drafts, recursive=True)
        draft, n = Draft(task.partitionId(), f"{self.drafts}/{task.partitionId()}-{task.taskAttemptId()}", 0), 0
        with system.open_output_stream(draft.name) as out:
            for batch in iterator:
                ids = batch.column(self.at).flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() > limit):
                    raise ValueError(f"an id doesn't fit {self.dtype}")
                out.write(ids.astype(self.dtype).tobytes())
                n += len(ids)
        draft.tokens = n
        return draft

    def commit(self, messages: list[Draft | None]) -> None:
        system, folder = _folder(self.path)
        system.create_dir(folder, recursive=True)
        old = manifest(self.path) or {"files": []}
        files = [] if self.overwrite else list(old["files"])
        for m in sorted((m for m in messages if m is not None and m.tokens), key=lambda m: m.part):
            name = f"part-{len(files):05d}-{self.job}.bin"
            system.move(m.name, f"{folder}/{name}")
            files.append({"name": name, "tokens": m.tokens})
        new = f"{folder}/_manifest-{self.job}"
        with system.open_output_stream(new) as f:
            f.write(json.dumps({"dtype": self.dtype, "tokens": sum(f["tokens"] for f in files), "files": files}, indent=1).encode())
        system.move(new, f"{folder}/{MANIFEST}")
        gone = {f["name"] for f in old["files"]} - {f["name"] for f in files}
        for name in gone:
            system.delete_file(f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Draft | None]) -> None:
        """Deletes the drafts, those of lost attempts too."""
        system, _ = _folder(self.path)
        if system.get_file_info(self.drafts).type == fs.FileType.Directory:
            system.delete_dir(self.drafts)


class TokenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_file"

    def schema(self) -> str:
        return SCHEMA

    def _dtype(self) -> str:
        known = None if "dtype" in self.options else manifest(self.options["path"])
        return known["dtype"] if known else self.options.get("dtype", DTYPE)

    def reader(self, schema: StructType) -> TokenReader:
        return TokenReader(self.options["path"], self._dtype(), int(self.options.get("block", BLOCK)), int(self.options.get("stretch", STRETCH)))

    def writer(self, schema: StructType, overwrite: bool) -> TokenWriter:
        """Of the frame only the column ids is written."""
        return TokenWriter(self.options["path"], self.options.get("dtype", DTYPE), schema.fieldNames().index("ids"), overwrite)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, start (ids before it in its file), place (ids before it in all files), ids."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_file").options(**options).load(path)


def write(rows: DataFrame, path: str, *, mode: str = "overwrite", **options) -> None:
    """Rows with a column ids: partition by partition, in the order that the rows have within each."""
    rows.sparkSession.dataSource.register(TokenFiles)
    rows.write.format("token_file").mode(mode).options(**options).save(path)
