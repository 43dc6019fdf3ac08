"""Binary files that Spark writes whole and reads in ranges: a task writes under a name of its own, the driver gives files their names at the end."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

PIECE = 1 << 20  # bytes that are read at once


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def md5_of(path: str) -> str:
    """Of a file, a piece at a time."""
    system, own = file_system(path)
    found = hashlib.md5()
    with system.open_input_stream(own) as f:
        while data := f.read(PIECE):
            found.update(data)
    return found.hexdigest()


@dataclass
class _Written(WriterCommitMessage):
    """(name, place in the folder of unfinished files) of what a task has written."""

    files: list[tuple[str, str]] = field(default_factory=list)


class FilesWriter(DataSourceArrowWriter):
    """Writes rows (name, part, content), in order of part, as files of root. Files come into being on commit only; a second attempt of a task writes others."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.unfinished = f"{self.root}/_unfinished-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        done, name, out = _Written(), None, None
        system, folder = file_system(self.unfinished)
        system.create_dir(folder, recursive=True)
        try:
            for batch in iterator:
                for own, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                    if own != name:
                        if out is not None:
                            out.close()
                        if any(own == n for n, _ in done.files):
                            raise ValueError(f"{own}: parts are not together")
                        name, temporary = own, uuid.uuid4().hex
                        out = system.open_output_stream(f"{folder}/{temporary}")
                        done.files.append((name, temporary))
                    out.write(content.as_buffer())
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        if len({n for n, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError("a file was written by two tasks")
        system, root = file_system(self.root)
        if there := [i.path for i in system.get_file_info([f"{root}/{n}" for n, _ in files]) if i.type != fs.FileType.NotFound]:
            self.abort(messages)
            raise FileExistsError(f"{there[0]} is there already")
        _, folder = file_system(self.unfinished)
        for name, temporary in files:
            system.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
            system.move(f"{folder}/{temporary}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Removes what isn't finished, that of lost tasks too."""
        system, folder = file_system(self.unfinished)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class WholeFiles(DataSource):
    """A sink of rows (name, part, content): option root."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, part long, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["root"])


def write_files(chunks: DataFrame, root: str) -> None:
    """chunks: name, part, content. A file of root for each name, its chunks in order of part; each file is streamed by one task, chunk by chunk.

    All files get their names together, when all are written; a job that fails leaves none. A file that is there already is an error.
    """
    spark = chunks.sparkSession
    spark.dataSource.register(WholeFiles)
    own = chunks.select("name", F.col("part").cast("long").alias("part"), "content").repartition("name").sortWithinPartitions("name", "part")
    own.write.format("whole_files").option("root", root).mode("append").save()


def write_file(path: str, content: bytes) -> None:
    """A small file from the driver, under its name only when it is whole."""
    system, own = file_system(path)
    system.create_dir(own.rsplit("/", 1)[0], recursive=True)
    temporary = f"{own}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as f:
        f.write(content)
    system.move(temporary, own)


def read_small(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
