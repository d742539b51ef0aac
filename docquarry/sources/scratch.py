"""Tables that live for one call, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_OWN: dict[str, str] = {}  # by application


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where unset, as in tests, a temp folder on a local master; any other must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="docquarry-")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_root(spark)}/docquarry/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """The rows, written as Parquet (partitioned by a column, if given) and read again: cuts the lineage."""
    path = scratch_path(df.sparkSession, what)
    writer = df.write
    if by:
        writer = writer.partitionBy(by)
    writer.parquet(path)
    # a column of partitions comes last when read
    schema = df.schema if not by else StructType([*[f for f in df.schema if f.name != by], df.schema[by]])
    return df.sparkSession.read.schema(schema).parquet(path)
