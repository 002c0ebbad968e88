"""A sink for pictures with a commit: files and their manifest appear together when all tasks are done, or not at all.

Rows carry the columns of a manifest and ``files``, an array of (path, data) with paths below the root. A task writes its files
and its part of the manifest into a folder of its own; its message names that folder. The commit moves what the messages name
into place and removes the rest, so attempts that were lost or repeated leave nothing. A run that is aborted removes its own folder,
and tasks of it that still run stop at their next file, for want of that folder.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessera.sources.stores import output, put

FILES = "files array<struct<path:string,data:binary>>"
#: Files moved at a time by the commit.
MOVERS = 16


@dataclass
class Written(WriterCommitMessage):
    """What a task leaves: its folder, its number, and how many rows and files it wrote. The files are listed in the folder."""

    home: str
    part: int
    rows: int
    files: int


def _cell(v) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, float) else str(v)


class _PictureWriter(DataSourceArrowWriter):
    def __init__(self, options, columns: list[str], overwrite: bool):
        self.root, self.manifest = options["root"].rstrip("/"), options.get("manifest", "manifest")
        self.columns, self.overwrite = [c for c in columns if c != "files"], overwrite
        self.staging = f"{self.root}/_staging-{uuid.uuid4().hex}"
        store, at = output(self.staging)
        store.create_dir(at, recursive=True)
        put(f"{self.staging}/_open", b"")  # stores without folders know files only

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        part, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, uuid.uuid4().hex)
        return self.write_part(iterator, part, f"{self.staging}/{part}-{attempt}")

    def write_part(self, batches: Iterator[pa.RecordBatch], part: int, home: str) -> Written:
        table, names, rows = io.StringIO(), [], 0
        out = csv.writer(table, lineterminator="\n")
        out.writerow(self.columns)
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                for f in r["files"] or []:
                    self._still_open()
                    put(f"{home}/{f['path']}", f["data"])
                    names.append(f["path"])
                out.writerow([_cell(r[c]) for c in self.columns])
                rows += 1
        self._still_open()
        put(f"{home}/_manifest.csv", table.getvalue().encode())
        put(f"{home}/_files", "\n".join(names).encode())
        return Written(home, part, rows, len(names))

    def _still_open(self) -> None:
        store, at = output(f"{self.staging}/_open")
        if store.get_file_info(at).type == fs.FileType.NotFound:
            raise RuntimeError("the run was aborted")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = output(self.root)
        if self.overwrite and store.get_file_info(f"{root}/{self.manifest}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.manifest}")
        moves = []
        for m in messages:
            if m is not None and m.rows:
                home = output(m.home)[1]
                with store.open_input_stream(f"{home}/_files") as f:
                    names = f.read().decode().split("\n") if m.files else []
                moves += [(f"{home}/{n}", f"{root}/{n}") for n in names]
                moves.append((f"{home}/_manifest.csv", f"{root}/{self.manifest}/part-{m.part:05d}-{uuid.uuid4().hex[:8]}.csv"))
        for folder in {to.rsplit("/", 1)[0] for _, to in moves} | {f"{root}/{self.manifest}"}:
            store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda x: store.move(*x), moves))
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, at = output(self.staging)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


class PictureSink(DataSource):
    """``df.write.format("pictures").option("root", ...).option("manifest", "manifest").mode("append").save()``; overwrite replaces the manifest, files by name."""

    @classmethod
    def name(cls) -> str:
        return "pictures"

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PictureWriter(self.options, schema.names, overwrite)


def write_pictures(rows: DataFrame, root: str, manifest: str = "manifest") -> DataFrame:
    """Writes the files of rows below root and the other columns as CSV to root/manifest, which is replaced; returns the manifest with the types of the rows."""
    spark = rows.sparkSession
    spark.dataSource.register(PictureSink)
    rows.write.format("pictures").option("root", root).option("manifest", manifest).mode("overwrite").save()
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(rows.drop("files").schema).csv(f"{root}/{manifest}")
