"""A folder of named files as a sink: df.write.format("veil_files").

Rows are (name, content).  Tasks write into a hidden folder beside the files; only when all have
ended are the files moved to their names, and a job that fails leaves none.  Names are told
apart before (``told_apart``); two equal ones fail the job rather than lose a file.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    place: str
    files: int


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.job, self.overwrite = folder.rstrip("/"), uuid.uuid4().hex, overwrite

    def begin(self) -> FilesWriter:
        """Makes the hidden folder.  Once an abort has deleted it, tasks that still run fail instead of leaving files."""
        store, root = self._store()
        store.create_dir(self._hidden(root), recursive=True)
        return self

    def _store(self) -> tuple[fs.FileSystem, str]:
        if re.match(r"[a-z0-9+.-]+:", self.folder):
            return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.folder))
        return fs.LocalFileSystem(), self.folder

    def _hidden(self, root: str) -> str:
        return f"{root}/_pending-{self.job}"

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        store, root = self._store()
        task = TaskContext.get()
        # Attempts of a task write apart; only the one that is committed is moved.
        place = f"{self._hidden(root)}/{task.partitionId()}-{task.taskAttemptId()}"
        store.create_dir(place, recursive=False)
        seen = set()
        for row in rows:
            name, content = row["name"], row["content"]
            if not name or "/" in name or name.startswith((".", "_")) or name in seen:
                raise ValueError(f"not a name for a file, or used twice: {name!r}")
            seen.add(name)
            with store.open_output_stream(f"{place}/{name}") as out:
                out.write(bytes(content or b""))
        return Written(place, len(seen))

    def commit(self, messages) -> None:
        store, root = self._store()
        moves, names = [], set()
        for m in messages:
            for f in store.get_file_info(fs.FileSelector(m.place)) if m else ():
                if f.base_name in names:
                    self.abort(messages)
                    raise ValueError(f"two files of one name: {f.base_name!r}")
                names.add(f.base_name)
                moves.append((f.path, f"{root}/{f.base_name}"))
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.type == fs.FileType.File:
                    store.delete_file(f.path)
        for source, target in moves:
            store.move(source, target)
        if store.get_file_info(self._hidden(root)).type == fs.FileType.Directory:
            store.delete_dir(self._hidden(root))

    def abort(self, messages) -> None:
        store, root = self._store()
        if store.get_file_info(self._hidden(root)).type == fs.FileType.Directory:
            store.delete_dir(self._hidden(root))


class Files(DataSource):
    """Writes (name string, content binary) rows as files of a folder that driver and executors reach."""

    @classmethod
    def name(cls) -> str:
        return "veil_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite).begin()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)


#: Names that are shared and sent to every task at most.
BROADCAST = 100_000


def told_apart(rows: DataFrame, *key: str) -> DataFrame:
    """rows with names that stand once: where several rows share one, each gets its key before the extension.

    For pages before they are rendered: of these only names are read to count them.  A name may
    be that of a third of all rows; names are counted before they are shuffled, and the shared
    ones broadcast, or joined, where Spark splits a hot one.
    """
    shared = rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select(F.col("name").alias("shared_name"))
    few = shared.limit(BROADCAST + 1).count() <= BROADCAST
    met = rows.join(F.broadcast(shared) if few else shared, F.col("name") == F.col("shared_name"), "left")
    own: Column = F.concat_ws("-", *(F.regexp_replace(F.col(k).cast("string"), "[^A-Za-z0-9]+", "-") for k in key))
    longer = F.concat(F.regexp_extract("name", "^(.*?)(\\.[^.]*)?$", 1), F.lit("-"), own, F.regexp_extract("name", "(\\.[^.]*)?$", 0))
    return met.withColumn("name", F.when(F.col("shared_name").isNotNull(), longer).otherwise(F.col("name"))).drop("shared_name")


def save(files: DataFrame, folder: str) -> None:
    """Writes name, content rows as files of a folder; all of them or, if the job fails, none."""
    register(files.sparkSession)
    files.select("name", "content").write.format("veil_files").mode("append").save(folder)
