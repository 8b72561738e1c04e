"""The session and its shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only a local session, which has no other machines, may go without one.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set(CHECKPOINT_DIR, root)
    return root


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
