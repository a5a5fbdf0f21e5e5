"""A folder that all machines of the cluster see, for tables that a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name below spark.checkpoint.dir. Where that is unset: below a temporary folder on a single machine, else
    ValueError."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="folioloom-")  # one machine is all there is
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return f"{found}/folioloom-{name}-{uuid.uuid4().hex}"
