"""Folders for what a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; without that setting only a session of one process gets a temporary one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _OWN.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="downfield-"))
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
