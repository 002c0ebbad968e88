"""Session construction and the shared-folder rule."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the plans of this package assume.

    Shuffle partitions start high and adaptive execution merges small ones, so the same
    number serves a laptop and a cluster.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees, as named in ``spark.checkpoint.dir``.

    Where the setting is absent (tests on one machine) a temporary folder is made and set as
    the context's checkpoint folder; a cluster has to name its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + os.path.realpath(tempfile.mkdtemp(prefix="tessera-")))
    return sc._jsc.sc().getCheckpointDir().get()
