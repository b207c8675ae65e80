"""What the operators of this package share: tables, written intermediate tables, scratch column names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import ensure_checkpoint_dir, ship_package

TEXT_ROWS = 1000

#: White space as the line and word contracts define it (ASCII only).
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWNED: list[list[DataFrame]] = []


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and return the table that was written.

    Cuts lineage like a checkpoint and survives lost executors, but stays
    columnar and compressed. The folder goes with ``drop``, with the scope that
    is open, or at the latest when the application ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = sc._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(written)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    if _OWNED:
        _OWNED[-1].append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; the driver then lets go of finished shuffles too."""
    for df in tables:
        path = getattr(df, "stash_path", None)
        if path is None:
            continue
        sc = df.sparkSession.sparkContext
        written = sc._jvm.org.apache.hadoop.fs.Path(path)
        written.getFileSystem(sc._jsc.hadoopConfiguration()).delete(written, True)
        df.stash_path = None
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Owns the tables that are written inside it and deletes them at its end, but for those put into the list it gives."""
    kept: list[DataFrame] = []
    _OWNED.append([])
    try:
        yield kept
    finally:
        own = _OWNED.pop()
        if _OWNED:
            _OWNED[-1].extend(df for df in own if any(df is k for k in kept))
        drop(*[df for df in own if not any(df is k for k in kept)])


def join_counted(rows: DataFrame, few: DataFrame, on: list[str], how: str, most: int = 100_000) -> DataFrame:
    """Join with a written table, broadcast only when it counts at most ``most`` rows; beyond that a shuffle join."""
    return rows.join(F.broadcast(few) if few.limit(most + 1).count() <= most else few, on, how)


def ready(df: DataFrame) -> DataFrame:
    """``df``, with this package on the executors: called before Python functions of it run there.

    Whole texts go to Python in batches of at most TEXT_ROWS rows, so that what
    a worker and the transfer hold stays small; a lower setting is left as it is.
    """
    spark, rows = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    ship_package(spark)
    if not 0 < int(spark.conf.get(rows)) <= TEXT_ROWS:
        spark.conf.set(rows, TEXT_ROWS)
    return df


def text_of(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(text: str) -> str:
    """A-Z to a-z, all else untouched. Lone surrogates cannot occur in a Spark string."""
    return text.encode().lower().decode()


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name
