"""The scratch folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset a local session gets a temporary one; on a cluster that is an error."""
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif context.master == "local" or context.master.startswith("local["):
            base = f"file://{tempfile.mkdtemp(prefix='assimspark-')}"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
