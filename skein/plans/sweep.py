"""Parameter sweeps: the same network under several settings, with sizes and times of each trial."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import ClipConfig, SaxConfig, ShingleConfig
from skein.functions import batched, encode, hashing, similarity
from skein.operators import network
from skein.operators import stats
from skein.session import materialize, release
from skein.sources.series import read_flights, read_report
from skein.sources.sinks import write_matrix

Config = ClipConfig | SaxConfig | ShingleConfig


def encoded(series: DataFrame, cfg: Config) -> DataFrame:
    """(item, enc[, codes]): series under the encoding of cfg."""
    if isinstance(cfg, ClipConfig):
        return series.select("item", encode.clip("vals", cfg).alias("enc"))
    if isinstance(cfg, SaxConfig):
        return series.select("item", encode.sax("vals", cfg).alias("enc"))
    return batched.shingle_encoding(series, cfg)


def codes_of(enc: DataFrame, cfg: Config) -> DataFrame:
    if isinstance(cfg, ShingleConfig):
        each = enc.select("item", F.posexplode("codes").alias("at", "code")).where("code is not null")
        return each.select("item", (F.col("at") + 1).alias("table_id"), "code")
    return hashing.substring_codes(enc, cfg.offsets, cfg.code_len)


def measure_of(cfg: Config) -> Callable:
    if isinstance(cfg, ClipConfig):
        return lambda a, b: similarity.run_length(a, b, cfg.growth)
    if isinstance(cfg, SaxConfig):
        return lambda a, b: similarity.mindist(a, b, cfg)
    return similarity.jaccard


def network_of(series: DataFrame, cfg: Config) -> DataFrame:
    """(id1, id2, sim): encoding, codes, candidate pairs and verification under one setting."""
    enc = materialize(encoded(series, cfg))
    return network.verify(network.candidate_pairs(codes_of(enc, cfg)), enc, measure_of(cfg))


def sweep(spark: SparkSession, series: DataFrame, configs: list[Config]) -> DataFrame:
    """(trial, method, n_pairs, millis): one row per setting, run one after the other."""
    rows = []
    for trial, cfg in enumerate(configs, 1):
        began = time.time()
        sims = materialize(network_of(series, cfg))
        rows.append((trial, type(cfg).__name__.removesuffix("Config").lower(), sims.count(), int((time.time() - began) * 1000)))
        release(sims)
    return spark.createDataFrame(rows, "trial int, method string, n_pairs long, millis long")


def sweep_flights(spark: SparkSession, path: str, columns: list[str], configs: list[Config], time_col: str = "TS") -> DataFrame:
    """(flight, trial, method, n_pairs, millis): every flight file found at path under every setting.

    A flight's items are its columns but time_col, numbered from 1; a column with a gap or too short for a setting takes no part
    in it. Only file names come to the driver.
    """
    values = [c for c in columns if c != time_col]
    long = stats.unpivot(read_flights(spark, path, columns), ["flight", time_col], values)
    number = F.array_position(F.lit(values), F.col("variable")).alias("item")
    series = materialize(stats.transpose(long, [time_col]).where("forall(vals, x -> x is not null)").select("flight", number, "vals"))
    out = None
    for name in sorted(r["flight"] for r in series.select("flight").distinct().collect()):
        own = series.where(F.col("flight") == name).select("item", "vals")
        for k, cfg in enumerate(configs, 1):
            fits = own.where(F.size("vals") >= cfg.elements).select("item", F.slice("vals", 1, cfg.elements).alias("vals"))
            one = sweep(spark, fits, [cfg]).select(F.lit(name).alias("flight"), F.lit(k).alias("trial"), "method", "n_pairs", "millis")
            out = one if out is None else out.union(one)
    release(series)
    return spark.createDataFrame([], "flight string, trial int, method string, n_pairs long, millis long") if out is None else out


def report_to_matrix(spark: SparkSession, report: str, path: str, items: list[int], scale: bool = False) -> DataFrame:
    """A report file as a matrix file: its sim lines, each pair once, scaled into (0, 1) if asked, as dense rows; returns the cells.

    Cells keep their kind, so a compared pair of value 0 is told from one that was not compared, which the file writes as 0.
    """
    sims = network.deduplicate(network.parse_report(read_report(spark, report)))
    if scale:
        sims = network.normalized(sims).withColumnRenamed("value", "sim")
    cells = materialize(network.matrix(sims, spark.createDataFrame([(i,) for i in items], "item long")))
    write_matrix(cells, path, items)
    return cells
