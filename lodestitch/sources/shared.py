"""Paths in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under ``spark.checkpoint.dir`` (a temporary folder only where that is unset,
    and only in local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="lodestitch-")
        _own[app] = root
    return f"{root.rstrip('/')}/lodestitch/{label}-{uuid.uuid4().hex}"
