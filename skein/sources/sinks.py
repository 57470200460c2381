"""Sinks: series by flight and encoding, reports, and dense matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_series(series: DataFrame, path: str, encoding: str) -> None:
    """Series (flight, variable, vals) as Parquet, parted by flight; a rerun replaces what it writes."""
    series.withColumn("encoding", F.lit(encoding)).write.partitionBy("encoding", "flight").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_variables(long: DataFrame, path: str) -> None:
    """The long table (flight, variable, ts, value) parted by variable; a rerun replaces it."""
    long.write.partitionBy("variable").mode("overwrite").parquet(path)


def write_series_text(series: DataFrame, path: str) -> None:
    """One line per variable, values parted by blanks, in files by flight."""
    line = F.concat_ws(" ", F.col("vals").cast("array<string>")).alias("value")
    series.select("flight", "variable", line).repartition("flight").sortWithinPartitions("flight", "variable").select("flight", "value").write.partitionBy("flight").mode("overwrite").text(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines (kind, line) in order of kind, then line."""
    lines.repartitionByRange("kind", "line").sortWithinPartitions("kind", "line").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_matrix(cells: DataFrame, path: str, items: list) -> None:
    """Cells (i, j, value) as dense rows; cells that were not compared are written as 0."""
    both = cells.select("i", "j", "value").union(cells.where("i <> j").select("j", "i", "value"))
    both.groupBy("i").pivot("j", items).agg(F.first("value")).na.fill(0.0).orderBy("i").write.mode("overwrite").csv(path)
