"""Table sinks: partitioned Parquet, dynamic overwrite, resume by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Overwrite only the partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All result partitions as one frame; partition folders come back as columns."""
    return spark.read.parquet(path)


def missing_only(todo: DataFrame, spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Resume: drop work items whose partition already exists."""
    try:
        done = spark.read.parquet(path).select(*keys).distinct()
    except AnalysisException:
        return todo
    return todo.join(done, keys, "left_anti")


def build_on_miss(spark: SparkSession, path: str, build, partition_by: list[str]) -> DataFrame:
    """Cache table: build and write when absent, then always read it back."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        write_partitions(build(), path, partition_by)
        return spark.read.parquet(path)


def misaligned(predictions: DataFrame, log: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of either side without a partner, and keys predicted more than once."""
    lost = predictions.join(log, key, "left_anti").select(key, F.lit("not in log").alias("problem"))
    gone = log.join(predictions, key, "left_anti").select(key, F.lit("no prediction").alias("problem"))
    twice = (predictions.groupBy(key).count().filter("count > 1")
             .select(key, F.lit("predicted twice").alias("problem")))
    return lost.unionByName(gone).unionByName(twice)
