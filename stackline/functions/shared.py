"""The folder that the driver and all executors share, named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """Only a local session, whose executors are threads of the driver, may lack it and then gets a temporary one."""
    found = spark.conf.get(CONF, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CONF} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stackline-")
        spark.conf.set(CONF, found)
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A path in it that no other run uses."""
    return f"{folder(spark)}/stackline/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Written there as Parquet and read back: computed once, and safe from lost executors."""
    at = path(df.sparkSession, "settled")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Dealt by ``keys`` over as many tasks as shuffles have; few short rows may cost much, and would else be one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def distinct(df: DataFrame, *keys: str) -> DataFrame:
    """The different ``keys``, settled and spread. What is asked of a key later would else go below the aggregation, where every row pays for it."""
    return spread(settled(df.select(*keys).distinct()), *keys)


def file_system(spark: SparkSession, name: str):
    """Hadoop's file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
