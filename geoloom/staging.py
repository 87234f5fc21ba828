"""Tables that a job writes into the folder all executors share, and reads again.

The folder is the one named by ``spark.checkpoint.dir``; where that is unset, a local master takes
one in the warehouse, and any other is an error.  A staged table cuts the lineage and survives the loss of executors.  Staged tables
go when the application ends; ``drop`` removes one that is no longer read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; deleted when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop(*staged: DataFrame) -> None:
    """Remove staged tables that nothing will read any more."""
    for df in staged:
        fs, at = _file_system(df.sparkSession, df._staged_path)
        fs.delete(at, True)
