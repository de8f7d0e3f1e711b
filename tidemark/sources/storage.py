"""The folder for tables that a job writes and reads again."""

from __future__ import annotations

import re
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where it names none, a session within this one
    process gets a temporary folder, and a cluster an error: no folder of this machine would be right there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where no table was written yet; any other failure to read it is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
