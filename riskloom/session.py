"""Session defaults and the shared scratch location."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "riskloom", **conf: str) -> SparkSession:
    """A session with the settings the operators assume; on a cluster, pass sizes through ``conf``."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.unix.domain.socket.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which the caller owns and every executor must see.

    Where the setting is missing and driver and executors are one process, as in tests, a folder of this process stands
    in and is removed when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _process_folder(spark.sparkContext.master)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@functools.cache
def _process_folder(master: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="riskloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def materialize(df, label: str):
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage and survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
