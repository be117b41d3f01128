"""Office documents and pages as data sources of Spark.

``spark.read.format("corpuslens_docx")`` gives the events of office documents below a
folder, a partition for each group of files. ``df.write.format("corpuslens_files")``
writes a file a row ``(name, content)``: tasks write beside the target folder, and only
when all have ended are the files moved into it; if one fails nothing is left.
Folders may be on any file system that pyarrow knows.
"""

from __future__ import annotations

import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FILES_A_PARTITION = 32


def _opened(path: str):
    """(file system, path on it)."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


@dataclass
class Group(InputPartition):
    paths: list[str]


class OfficeReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Group]:
        from pyarrow import fs

        system, path = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if system.get_file_info(path).type != fs.FileType.File else [system.get_file_info(path)]
        paths = sorted(f.path for f in found if f.is_file and f.path.lower().endswith(".docx"))
        return [Group(paths[i : i + self.size]) for i in range(0, len(paths), self.size)] or [Group([])]

    def read(self, partition: Group) -> Iterator[tuple]:
        from .docx import events_of

        system, _ = _opened(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as f:
                content = f.read()
            try:
                events = events_of(content)
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                events = [("unreadable", 0, "")]
            for seq, (kind, level, text) in enumerate(events):
                yield path, seq, kind, level, text


class OfficeSource(DataSource):
    """Options: path, filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "corpuslens_docx"

    def schema(self) -> str:
        return "path string, seq int, kind string, level int, text string"

    def reader(self, schema: StructType) -> OfficeReader:
        return OfficeReader(self.options["path"], int(self.options.get("filesPerPartition", FILES_A_PARTITION)))


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    names: list[str]


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = path, names, overwrite
        self.staging = f".staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, root = _opened(self.path)
        attempt, names = uuid.uuid4().hex, []
        system.create_dir(f"{root}/{self.staging}/{attempt}", recursive=True)
        for row in iterator:
            name, content = row[self.columns.index("name")], row[self.columns.index("content")]
            if not name or name.startswith(("/", ".")) or posixpath.normpath(name) != name:
                raise ValueError(f"no name for a file below the folder: {name!r}")
            target = f"{root}/{self.staging}/{attempt}/{len(names)}"
            with system.open_output_stream(target) as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            names.append(name)
        return Written(attempt, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        moves = [(f"{root}/{self.staging}/{m.attempt}/{i}", f"{root}/{name}") for m in messages if m for i, name in enumerate(m.names)]
        targets = [t for _, t in moves]
        there = [] if self.overwrite else [f.path for f in system.get_file_info(targets) if f.is_file]
        twice = sorted({t for t in targets if targets.count(t) > 1}) if len(set(targets)) < len(targets) else []
        if twice or there:
            self.abort(messages)
            raise FileExistsError(f"written already: {(twice or there)[:3]}")
        for source, target in moves:
            system.create_dir(posixpath.dirname(target), recursive=True)
            system.move(source, target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        system.delete_dir(f"{root}/{self.staging}") if system.get_file_info(f"{root}/{self.staging}").type.name == "Directory" else None


class FileSink(DataSource):
    """Rows ``(name, content)``; option path; mode append refuses names that are there, overwrite replaces them."""

    @classmethod
    def name(cls) -> str:
        return "corpuslens_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        missing = {"name", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return FileWriter(self.options["path"], schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OfficeSource)
    spark.dataSource.register(FileSink)


def write_files(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes a file for each row ``(name, content)``."""
    register(rows.sparkSession)
    rows.select("name", "content").write.format("corpuslens_files").option("path", path).mode("overwrite" if overwrite else "append").save()
