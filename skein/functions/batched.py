"""The shingle encoding for whole Arrow batches: the same values as the column expressions, by array arithmetic.

Higher-order functions are evaluated one lambda call at a time, which this encoding needs thousands of per series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.config import ShingleConfig

#: Series worked on at a time; bounds a worker's memory.
ROWS = 2_000


def sketch_bits(x: np.ndarray, cfg: ShingleConfig) -> np.ndarray:
    """Sign bits of the sliding projection, summed left to right as the column expression does."""
    at = np.arange(cfg.bits) * cfg.stride
    total = np.zeros((len(x), cfg.bits))
    for j, v in enumerate(cfg.projection):
        total = total + v * x[:, at + j]
    return total >= 0


def shingles(bits: np.ndarray, cfg: ShingleConfig) -> np.ndarray:
    at = np.arange(cfg.shingles) * cfg.shingle_stride
    return sum(bits[:, at + k].astype(np.int64) << (cfg.shingle_bits - 1 - k) for k in range(cfg.shingle_bits))


def draw_codes(counts: np.ndarray, cfg: ShingleConfig) -> np.ndarray:
    """The first accepted draw per table; -1 where none is."""
    out = np.full((len(counts), len(cfg.draws)), -1, np.int64)
    for t, row in enumerate(cfg.draws):
        d = np.array(row)
        whole = d.astype(np.int64)
        ok = (d - whole)[None, :] < counts[:, whole] / float(cfg.shingles)
        out[:, t] = np.where(ok.any(1), ok.argmax(1), -1)
    return out


def shingle_encoding(series: DataFrame, cfg: ShingleConfig) -> DataFrame:
    """(item, enc, codes): the distinct shingles of each series, ascending, and its code in each table (null: none).

    Series shorter than the window, and those that hold a null, are left out; of longer ones the window counts.
    """
    item = series.schema["item"].dataType.simpleString()
    n = cfg.elements

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                if not b.num_rows:
                    continue
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                grams = shingles(sketch_bits(x, cfg), cfg)
                row = np.repeat(np.arange(len(x)), cfg.shingles)
                counts = np.zeros((len(x), cfg.kinds), np.int64)
                np.add.at(counts, (row, grams.ravel()), 1)
                codes = draw_codes(counts, cfg).ravel()
                r, kind = np.nonzero(counts)
                offs = np.concatenate(([0], np.cumsum(np.bincount(r, minlength=len(x)))))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(kind, pa.int32())),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(cfg.draws), pa.int32()), pa.array(codes, mask=codes < 0)),
                    ],
                    ["item", "enc", "codes"],
                )

    ready = series.select("item", F.slice("vals", 1, n).cast("array<double>").alias("vals")).where(F.expr(f"size(vals) = {n} and forall(vals, x -> x is not null)"))
    return ready.mapInArrow(run, f"item {item}, enc array<int>, codes array<long>")
