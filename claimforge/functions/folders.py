"""Folders for tables that are written between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share, under ``spark.checkpoint.dir``; of this machine only where the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='claimforge-')}"
    return f"{root.rstrip('/')}/claimforge/{name}-{uuid.uuid4().hex}"
