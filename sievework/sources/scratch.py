"""A folder for files that are read again by the same application."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path (nothing is there yet) in the folder that driver and executors share,
    ``spark.checkpoint.dir``. Where that is unset and both are one process (tests), it is a
    temporary folder. Files of an application lie in one folder, which may go with it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/files-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
