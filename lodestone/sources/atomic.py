"""A sink that publishes all of a write or nothing, as a Python data source.

Tasks write JSON lines below a folder of this write's own beside the target.
Only when all tasks have ended is that folder given the target's name; a task
that fails, is killed or is repeated leaves nothing that a reader sees, and an
aborted write takes its folder away. What the target held stays whole until the
moment it is replaced. The file system must rename folders in one step, as local
ones and HDFS do. An empty table gives a folder without rows.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "lodestone_atomic"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class AtomicWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.own = f"{posixpath.dirname(self.path)}/.{posixpath.basename(self.path)}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = _filesystem(self.own)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}.json"
        n = 0
        with system.open_output_stream(name) as out:
            for row in iterator:
                out.write(json.dumps(row.asDict(recursive=True), default=str, separators=(",", ":")).encode() + b"\n")
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, folder = _filesystem(self.own)
        _, target = _filesystem(self.path)
        system.create_dir(folder, recursive=True)
        # Attempts that no message names were given up.
        kept = {m.path for m in messages if m}
        for f in system.get_file_info(fs.FileSelector(folder)):
            if f.path not in kept:
                system.delete_file(f.path)
        there = system.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            system.delete_dir(folder)
            raise FileExistsError(self.path)
        aside = f"{folder}-old"
        if there:
            system.move(target, aside)
        system.move(folder, target)
        if there:
            system.delete_dir(aside)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, folder = _filesystem(self.own)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class AtomicSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> AtomicWriter:
        return AtomicWriter(self.options["path"], overwrite)


def write_atomic(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """Rows as JSON lines in folder `path`, all at once."""
    df.sparkSession.dataSource.register(AtomicSink)
    df.write.format(NAME).mode("overwrite" if overwrite else "append").option("path", path).save()


def read_atomic(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)
