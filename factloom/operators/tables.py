"""Intermediate tables of one application."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str | None:
    """Where this application's intermediate tables lie; None if spark.checkpoint.dir is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}" if shared else None


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a fresh table below spark.checkpoint.dir, so that what reads it several times doesn't repeat its plan; kept in the
    executors' storage instead where no such folder is named."""
    spark = df.sparkSession
    own = folder(spark)
    if not own:
        return df.persist()
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Tasks among which work is shared out that costs far more than moving its rows."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over tasks, by their number and not by a key: a table of one file is read by all cores, and repeated
    keys don't gather. For what costs far more to read than to move."""
    return rows.withColumn("_row", F.monotonically_increasing_id()).repartition(tasks(rows.sparkSession), "_row").drop("_row")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows spread over tasks by a key that hardly repeats, which a join on it takes as it is."""
    return rows.repartition(tasks(rows.sparkSession), key)


def clear(spark: SparkSession) -> None:
    """Remove this application's intermediate tables and what it keeps in storage; results made from them must have been written before."""
    spark.catalog.clearCache()
    if own := folder(spark):
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
