"""Series sources: text lines, wide sensor files, and views over the event and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.encode import window
from skein.session import read_table


def parse_series(lines: DataFrame, id_col: str, text_col: str, start: int = 0, elements: int | None = None) -> DataFrame:
    """(item, vals) from lines of numbers parted by white space.

    A line is read up to the first word that is no finite number. With `elements` the window of that many values from
    `start` is kept, and lines too short for it are left out; so are null lines.
    """
    words = F.split(F.trim(F.regexp_replace(F.col(text_col), r"\s+", " ")), " ")
    vals = F.transform(words, lambda w: w.try_cast("double"))
    bad = F.array_position(F.transform(vals, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))), False)
    df = lines.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item"), vals.alias("vals"), bad.alias("bad"))
    df = df.select("item", F.when(F.col("bad") > 0, F.slice("vals", F.lit(1), (F.col("bad") - 1).cast("int"))).otherwise(F.col("vals")).alias("vals"))
    if elements is None:
        return df
    return df.select("item", window("vals", start, elements).alias("vals")).where("vals is not null")


def read_series_text(spark: SparkSession, path: str, start: int = 0, elements: int | None = None) -> DataFrame:
    """(file, item, vals) of text files, whose lines are numbered from 1 in the order of their file.

    Files are read in splits. A line's number is its place in its split plus the lines of the splits before it, of which
    one row per split is counted; no file has to be read as one piece.
    """
    at = F.monotonically_increasing_id()  # ascending within a split, in the order of its lines
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"), "value")
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n")
    numbered = rows.join(splits.select("file", "block", "first", before.alias("before")), ["file", "block"])
    key = F.struct("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("item"))
    return parse_series(numbered.select(key.alias("key"), "value"), "key", "value", start, elements).select("item.file", "item.item", "vals")


def read_flights(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(flight, columns...) of wide sensor files with a header; flight is the file's name."""
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in columns])
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    return df.select(F.col("_metadata.file_name").alias("flight"), *columns)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(line): the lines of report files."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def series_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vals"))


def series_events(spark: SparkSession, sf_dir: str, elements: int = 40) -> DataFrame:
    """(item, vals): each user's first values in order of time; users with fewer are left out.

    Only the first `elements` rows of a user leave the map side, however many a user has.
    """
    first = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    head = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value").withColumn("pos", first).where(F.col("pos") <= elements)
    rows = F.array_sort(F.collect_list(F.struct("pos", "value")))
    per = head.groupBy(F.col("user_id").alias("item")).agg(F.transform(rows, lambda s: s["value"]).alias("vals"))
    return per.select("item", window("vals", 0, elements).alias("vals")).where("vals is not null")


def flights_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flight, variable, ts, event_id, value): event types as flights, users as variables."""
    return read_table(spark, sf_dir, "events").select(F.col("event_type").alias("flight"), F.col("user_id").alias("variable"), "ts", "event_id", "value")
