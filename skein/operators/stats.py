"""Statistics, standardization and reshaping of long sensor tables (flight, variable, ts, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot(wide: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """The long form of a wide table: one row per key and variable."""
    return wide.unpivot([F.col(k) for k in keys], variables, "variable", "value")


def variable_stats(long: DataFrame) -> DataFrame:
    """(variable, n, mean, minimum, maximum, sd) over all flights; sd is that of the population. Nulls do not count."""
    v = F.col("value")
    return long.groupBy("variable").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.stddev_pop(v).alias("sd"))


def with_stats(long: DataFrame) -> DataFrame:
    """Each row with its variable's mean and sd.

    The statistics have one row per variable and are map-side combined; the planner broadcasts them when their measured
    size allows and joins by shuffle, splitting hot variables, when it does not.
    """
    return long.join(variable_stats(long).select("variable", "mean", "sd"), "variable")


def standardize(long: DataFrame) -> DataFrame:
    """value as its distance from the variable's mean in standard deviations; null where the variable does not vary."""
    return with_stats(long).withColumn("value", F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd"))).drop("mean", "sd")


def binarize(long: DataFrame) -> DataFrame:
    """value as 1 where it reaches the variable's mean, else 0."""
    return with_stats(long).withColumn("value", F.when(F.col("value") >= F.col("mean"), 1).when(F.col("value").isNotNull(), 0)).drop("mean", "sd")


def flight_extent(long: DataFrame) -> DataFrame:
    """(flight, first_ts, last_ts, n)."""
    return long.groupBy("flight").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def transpose(long: DataFrame, order: list[str]) -> DataFrame:
    """(flight, variable, vals): the values of each series in order. A series is as long as its flight."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "value")))
    return long.groupBy("flight", "variable").agg(F.transform(rows, lambda s: s["value"]).alias("vals"))
