"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """From `spark.checkpoint.dir`, or the checkpoint folder that is set; a temporary one only where all runs in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='geolith-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def checkpoints(spark: SparkSession) -> None:
    """checkpoint() needs a folder; it is the shared one."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def local_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that only a plain path can open, such as SQLite's, as a path; the shared root has to be a mounted one."""
    import os

    root = shared_root(spark)
    if "://" in root and not root.startswith("file:"):
        raise RuntimeError(f"files need a mounted folder, not {root}")
    path = f"{re.sub('^file:/*', '/', root)}/geolith/{name}"
    os.makedirs(path, exist_ok=True)
    return path
