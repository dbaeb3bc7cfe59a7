"""Files of PDF as a source and sink of Spark: format "pdf" reads their objects, and writes files from bytes."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath
from uuid import uuid4

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from leafmill.functions import pdf

#: Bytes of files that one partition reads, about.
RANGE = 4 << 20


@dataclass
class Files(InputPartition):
    paths: list[str]
    folder: str | None = None


@dataclass
class Written(WriterCommitMessage):
    folder: str


class PdfReader(DataSourceReader):
    """One partition a range of files in order of their names, or a folder in the folder, which is listed by its task, so that the driver never lists all
    files. Filters on the file (its name, some names, how it begins or ends) choose the files that
    are opened; those on the kind of an object choose what comes out of them."""

    def __init__(self, options: dict) -> None:
        self.folder, self.glob, self.size = options["path"], options.get("glob", "*.[pP][dD][fF]"), int(options.get("rangeBytes", RANGE))
        self.most = int(options.get("mostBytes", 1 << 62))
        self.files: list[Filter] = []
        self.kinds: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            of = f.attribute if isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith) else ()
            if of == ("file",):
                self.files.append(f)
            elif of == ("kind",) and isinstance(f, EqualTo | In):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.kinds = wanted if self.kinds is None else self.kinds & wanted
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        tests = {EqualTo: lambda v: name == v, In: lambda v: name in v, StringStartsWith: name.startswith, StringEndsWith: name.endswith}
        return fnmatch.fnmatchcase(name, self.glob) and all(tests[type(f)](f.value) for f in self.files)

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def _fits(self, info: fs.FileInfo) -> bool:
        return info.is_file and info.size <= self.most and self._wanted(info.base_name)

    def partitions(self) -> list[Files]:
        store, base = self._store()
        out, folders, held = [Files([])], [], 0
        for info in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda i: i.path):
            if info.type == fs.FileType.Directory and not info.base_name.startswith(("_", ".")):
                folders.append(Files([], info.path))
            elif self._fits(info):
                if held and held + info.size > self.size:
                    out.append(Files([]))
                    held = 0
                out[-1].paths.append(info.path)
                held += info.size
        return [f for f in out if f.paths or not folders] + folders

    def _contents(self, partition: Files) -> Iterator[tuple[str, bytes]]:
        """Path and bytes of each file of a partition."""
        store, _ = self._store()
        inner = sorted(store.get_file_info(fs.FileSelector(partition.folder, recursive=True)), key=lambda i: i.path) if partition.folder else []
        for path in [*partition.paths, *(i.path for i in inner if self._fits(i))]:
            with store.open_input_stream(path) as file:
                yield path, file.read()

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, data in self._contents(partition):
            if data[:4] != b"%PDF":
                continue
            name = PurePosixPath(path).name
            for number, entries, stream in pdf.objects(data, self.kinds is None or "stream" in self.kinds):
                kind = "trailer" if number == 0 else "stream" if stream is not None else "plain"
                if self.kinds is None or kind in self.kinds:
                    yield name, number, kind, entries, stream


class WholeReader(PdfReader):
    """Path, length and content of every file."""

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, data in self._contents(partition):
            yield path, len(data), data


class PdfWriter(DataSourceWriter):
    """Rows (file, content) become files of a folder. A task writes into a folder aside; the driver moves its files when all are there, or, with the option
    folders, the folder as it is. It hears of a task's folder alone, never of all files at once."""

    def __init__(self, options: dict) -> None:
        self.folder, self.folders = options["path"], options.get("folders", "false") == "true"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, base = self._store()
        aside = f"{base}/_writing-{uuid4().hex}"
        store.create_dir(aside, recursive=True)
        for row in iterator:
            with store.open_output_stream(f"{aside}/{row.file}") as file:
                file.write(bytes(row.content))
        return Written(aside)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = self._store()
        for m in filter(None, messages):
            if self.folders:
                store.move(m.folder, m.folder.replace("/_writing-", "/part-"))
                continue
            for info in store.get_file_info(fs.FileSelector(m.folder)):
                store.move(info.path, f"{base}/{info.base_name}")
            store.delete_dir(m.folder)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = self._store()
        for m in filter(None, messages):
            store.delete_dir(m.folder)


class PdfSource(DataSource):
    """spark.read.format("pdf").load(folder): file (name), number, kind (trailer, stream or plain), entries (of the dictionary, as written), stream (unpacked).

    Options: glob of the names, rangeBytes of a partition, mostBytes of a file; files that do not begin as PDF are left out. The folder: a path or an address that pyarrow's file
    systems know. Writing takes (file, content); with the option folders a task's files stay in a folder of their own.
    """

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return "file string, number int, kind string, entries map<string, string>, stream binary"

    def reader(self, schema: StructType) -> PdfReader:
        return PdfReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PdfWriter:
        return PdfWriter(dict(self.options))


class WholeSource(DataSource):
    """spark.read.format("whole_files").load(folder): path, length, content. Options as those of "pdf"; all names if no glob is given."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema: StructType) -> WholeReader:
        return WholeReader({"glob": "*", **self.options})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfSource)
    spark.dataSource.register(WholeSource)


def read_objects(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("pdf").options(**options).load(folder)


def read_whole(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of all files of a folder, which no list in the driver holds if they lie in folders of it."""
    register(spark)
    return spark.read.format("whole_files").load(folder)


def write_files(files: DataFrame, folder: str, folders: bool = False) -> None:
    """files: file (name), content (binary). folders: each task's files stay in a folder of their own in the folder, as they must where they are very many."""
    register(files.sparkSession)
    files.select("file", "content").write.format("pdf").mode("append").option("folders", str(folders).lower()).save(folder)
