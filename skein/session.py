"""Shared storage and size-checked joins used by every multi-pass operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}

#: A side with at most this many narrow rows (a few MB) may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a folder of our own only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="skein-")
    return _own_dirs[app]


def app_dir(spark: SparkSession) -> str:
    """This application's own subfolder, which clean() deletes."""
    return f"{shared_dir(spark)}/skein-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{uuid.uuid4().hex}"
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.__dict__.update(_skein_path=path, _skein_rows=rows.get.get("n"))
    return back


def row_count(df: DataFrame) -> int:
    """The number of rows, known for a table made by materialize()."""
    known = df.__dict__.get("_skein_rows")
    return df.count() if known is None else known


def release(*tables: DataFrame) -> None:
    """Delete tables made by materialize() that no later plan reads."""
    for df in tables:
        path = df.__dict__.get("_skein_path")
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Delete everything that this application has materialized; no result that is still lazy may be read afterwards."""
    p = spark._jvm.org.apache.hadoop.fs.Path(app_dir(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `limit` rows; a table made by materialize() knows, of others no more than that is read."""
    known = df.__dict__.get("_skein_rows")
    if known is not None:
        return known <= limit
    return df.limit(limit + 1).count() <= limit


def lookup_join(big: DataFrame, table: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a lookup table: broadcast when its counted size is below the limit, else a shuffled join."""
    return big.join(F.broadcast(table) if small(table, limit) else table, on, how)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
