"""Shared folder for queries whose feature is writing and reading back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="demarca-")
    return root.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared root."""
    return f"{shared_root(spark)}/demarca-{uuid.uuid4().hex}"
