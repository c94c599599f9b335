"""Where operators put what outlives a stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from smeltery.session import shared_dir


def scratch_root(spark: SparkSession) -> str:
    """The application's own folder in the shared folder of the session, with the scheme Spark resolves it to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below ``scratch_root``."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove everything this application stored; call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder as Parquet and read again: lineage ends here, and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
