"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, name: str = "work") -> str:
    """A new folder under spark.checkpoint.dir; a local one only where that is unset and the session is a local one, else refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster, name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="zephyrlake-")
    return f"{base}/{name}-{uuid.uuid4().hex}"
