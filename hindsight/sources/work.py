"""Written tables of one run in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions without a shared one, by application.
_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; only where that is unset on a local master (tests) in a temporary folder."""
    key, context = "spark.checkpoint.dir", spark.sparkContext
    base = spark.conf.get(key, None) or context.getConf().get(key)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set {key} to a folder that all executors share")
        base = _LOCAL.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="hindsight-")
        _LOCAL[context.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it again, which cuts its lineage for good."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
