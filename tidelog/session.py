"""Session settings and the few physical helpers every operator shares."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app: str = "tidelog", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it from anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tidelog-"), "tidelog"), "zip", root, "tidelog")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="tidelog-checkpoint-")
    sc.setCheckpointDir(shared)


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_by(df: DataFrame, column: str) -> DataFrame:
    """The rows written to the checkpoint folder by value of ``column``: a filter on it reads its own files only."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/by-{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    written = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(written)
    schema = T.StructType([*[f for f in df.schema.fields if f.name != column], df.schema[column]])
    return spark.read.schema(schema).parquet(path)


def attach(rows: DataFrame, state: DataFrame, on: list[str], how: str = "left",
           broadcast_rows: int = 500_000) -> DataFrame:
    """Join a large table with a derived state table.

    The state is settled once and counted; only a counted small state is
    broadcast. Beyond the bound the join stays a shuffle join, where adaptive
    execution splits skewed keys.
    """
    state = settle(state)
    if state.limit(broadcast_rows + 1).count() <= broadcast_rows:
        state = F.broadcast(state)
    return rows.join(state, on, how)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension written in code (expert registry, grid); its size is fixed by the caller."""
    return spark.createDataFrame(rows, schema)


def running_total(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, str],
                  slices: int | None = None) -> DataFrame:
    """Exact inclusive running sums over an arbitrarily large, arbitrarily skewed key.

    A window partitioned by ``keys`` alone would pull a hot key into one task.
    Here rows are range-partitioned on (keys, order), so a hot key spans many
    slices; the slice sums (at most slices x keys rows) give each slice its
    offset and the window only runs inside a slice.
    """
    spark = df.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
    sliced = settle(sliced.withColumn("_slice", F.spark_partition_id()))
    sums = sliced.groupBy("_slice", *keys).agg(*[F.sum(v).alias(f"_s_{out}") for out, v in values.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_slice", *keys, *[
        F.coalesce(F.sum(f"_s_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in values])
    inside = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(v).over(inside).alias(f"_l_{out}") for out, v in values.items()])
    joined = local.join(offsets, ["_slice", *keys])
    out_cols = [c for c in df.columns]
    return joined.select(*out_cols, *[(F.col(f"_l_{o}") + F.col(f"_o_{o}")).alias(o) for o in values])
