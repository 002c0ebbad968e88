"""Written tables in the shared folder: they cut lineage and survive the loss of executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from tessera.session import shared_dir

#: Shuffle files of a finished write are removed at once; nothing reads them after the table stands.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OPEN: ContextVar[list[Workspace] | None] = ContextVar("open_workspaces", default=None)


class Workspace:
    """A scratch folder below the shared one. Tables may be dropped once nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        made = _OPEN.get()
        if made is not None:
            made.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            # the plan is made anew, under the setting
            df.select("*").write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        """Everything goes: nothing may read a table of this folder any more."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the folders of all workspaces that are made within it, once it ends."""
    made: list[Workspace] = []
    token = _OPEN.set(made)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for w in made:
            w.close()
