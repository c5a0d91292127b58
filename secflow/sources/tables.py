"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Local folders of sessions that name no shared one, as in tests.
_LOCAL: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a local folder only where that is unset in a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="secflow-")
        root = _LOCAL[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> str:
    """Writes a DataFrame as Parquet to a fresh shared path."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def stream_of(df: DataFrame, name: str) -> DataFrame:
    """The rows of a DataFrame as a stream of Parquet files."""
    path = written(df, name)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)
