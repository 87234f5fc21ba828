"""Tables that a job writes into the shared folder and reads again.

The folder is the one named by ``spark.checkpoint.dir``; where that is unset, a local master takes
one in the warehouse, and any other is an error.  A staged table cuts the lineage, survives the loss
of executors, and is compressed and columnar.  Staged tables go when the application ends;
``drop`` removes one that is no longer read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table or folder; deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


#: Spark's setting by which the shuffle files of a query go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    The shuffle files of the write go with its end, as the table is read from its files; the
    session's setting is as before afterwards.  ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop(*staged: DataFrame) -> None:
    """Remove staged tables that nothing will read any more."""
    for df in staged:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm = df.sparkSession._jvm
            hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the Arrow batches of whole texts in executors, unless the session has a bound of its own.

    Spark reads this setting when a query runs, that is after a lazy result was returned, so it stays set.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
