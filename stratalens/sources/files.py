"""A sink of one file for each row: a Python data source whose tasks write the files under their final names.

A task puts each file beside its name and moves it there, so no reader sees a part of one; nothing is left for the
driver to do for each file.  Before it writes a group of files, a task writes down their names (with whether
they were there before) in a record of the export, in the folder that driver and executors share.  When the job
fails, files that it has newly made are deleted by that record, and tasks that still run delete theirs; files that were there keep what was
written last.  Tasks that are run again write the same names again.

Paths may be of any store that Arrow's file systems open (local, HDFS, S3, GCS, Azure).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from stratalens.operators import shared

FORMAT = "stratalens_files"
#: Files of a group.
GROUP = 256
#: The mark of a failed export in its record.
ABORTED = "_aborted"


def opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a full URI, and the path in it."""
    return arrow_fs.FileSystem.from_uri(uri)


def full_uri(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as Spark resolves it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    authority = uri.getAuthority() or ""
    return f"{uri.getScheme()}://{authority}{quote(uri.getPath())}"


def _put(store: arrow_fs.FileSystem, folder: str, name: str, parts: Iterable[str]) -> None:
    """The file ``name`` of the parts, which has its name once it is whole; no reader sees less of it."""
    beside = f"{folder}/.{uuid.uuid4().hex}.part"
    try:
        with store.open_output_stream(beside) as out:
            for part in parts:
                out.write(part.encode("utf-8"))
        store.move(beside, f"{folder}/{name}")
    except BaseException:
        if store.get_file_info(beside).type != arrow_fs.FileType.NotFound:
            store.delete_file(beside)
        raise


def put(uri: str, parts: Iterable[str]) -> None:
    """Write a text file, given in parts; its folder is made."""
    store, at = opened(uri)
    folder, _, name = at.rpartition("/")
    store.create_dir(folder, recursive=True)
    _put(store, folder, name, parts)


@dataclass
class Written(WriterCommitMessage):
    files: int


class FilesWriter(DataSourceWriter):
    """Writes rows (name, value) below the folder of the option ``path``, with the record in that of ``record``."""

    def __init__(self, options: dict) -> None:
        self.directory, self.record = options["path"], options["record"]

    def write(self, rows: Iterator) -> Written:
        store, at = opened(self.directory)
        store.create_dir(at, recursive=True)
        count, group = 0, []
        for row in rows:
            group.append((row["name"], row["value"]))
            if len(group) == GROUP:
                count += self._put(store, at, group)
                group = []
        return Written(count + self._put(store, at, group))

    def _put(self, store: arrow_fs.FileSystem, at: str, group: list[tuple[str, str]]) -> int:
        if not group:
            return 0
        infos = store.get_file_info([f"{at}/{name}" for name, _ in group])
        told = [{"name": name, "new": i.type == arrow_fs.FileType.NotFound} for (name, _), i in zip(group, infos)]
        records, folder = opened(self.record)
        records.create_dir(folder, recursive=True)
        with records.open_output_stream(f"{folder}/{uuid.uuid4().hex}.json") as out:
            out.write("".join(json.dumps(x) + "\n" for x in told).encode("utf-8"))
        for name, value in [*group, (None, None)]:
            if records.get_file_info(f"{folder}/{ABORTED}").type != arrow_fs.FileType.NotFound:
                self._undo(store, at, told)
                raise RuntimeError("The export was aborted")
            if name is None:
                break
            _put(store, at, name, [value])
        return len(group)

    def _undo(self, store: arrow_fs.FileSystem, at: str, told: list[dict]) -> None:
        for x in told:
            if x["new"] and store.get_file_info(f"{at}/{x['name']}").type != arrow_fs.FileType.NotFound:
                store.delete_file(f"{at}/{x['name']}")

    def commit(self, messages: list[Written | None]) -> None:
        """Nothing is left to do: the files have their names."""

    def abort(self, messages: list[Written | None]) -> None:
        """Delete the files that this export has newly made.

        Other tasks may still be running: they look for the mark before and after each file, and delete their own then.
        """
        records, folder = opened(self.record)
        records.create_dir(folder, recursive=True)
        with records.open_output_stream(f"{folder}/{ABORTED}") as mark:
            mark.write(b"")
        store, at = opened(self.directory)
        for f in records.get_file_info(arrow_fs.FileSelector(folder)):
            if f.base_name != ABORTED:
                with records.open_input_stream(f.path) as held:
                    self._undo(store, at, [json.loads(x) for x in held.read().decode("utf-8").splitlines()])


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options)


class Exported(Sequence):
    """The paths of an export, in order; they are read only when they are asked for."""

    def __init__(self, spark: SparkSession, directory: str, record: str) -> None:
        self.spark, self.directory, self.record, self._names = spark, directory, record, None

    def names(self) -> DataFrame:
        """The files' names, each once."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.record)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], "name string")
        return self.spark.read.schema("name string").json(self.record).distinct()

    def _paths(self) -> list[str]:
        if self._names is None:
            self._names = [f"{self.directory}/{r.name}" for r in self.names().orderBy("name").collect()]
        return self._names

    def __len__(self) -> int:
        return self.names().count() if self._names is None else len(self._names)

    def __getitem__(self, at):
        return self._paths()[at]


def write_files(rows: DataFrame, directory: str, name: str, value: str) -> Exported:
    """Write each row's string ``value`` as the file ``name`` of ``directory``, UTF-8; names name one row each."""
    spark = rows.sparkSession
    spark.dataSource.register(FilesSource)
    record = f"{shared.folder(spark)}/record"
    named = rows.select(F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value"))
    named.write.format(FORMAT).mode("append").option("record", full_uri(spark, record)).save(full_uri(spark, directory))
    p = spark._jvm.org.apache.hadoop.fs.Path(directory.rstrip("/"))
    return Exported(spark, p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString(), record)
