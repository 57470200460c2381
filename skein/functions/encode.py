"""Encodings of a series as pure column expressions: they stay in the JVM and can be used anywhere a column can."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.config import ClipConfig, SaxConfig, ShingleConfig


def literals(values: list) -> Column:
    return F.array(*map(F.lit, values))


def window(vals: Column | str, start: int, elements: int) -> Column:
    """The values at positions start .. start + elements - 1 (from 0); null where the series is shorter."""
    part = F.slice(vals, start + 1, elements)
    return F.when(F.size(part) == elements, part)


def normalize(vals: Column | str, mean: float, sd: float) -> Column:
    return F.transform(vals, lambda x: (x - mean) / sd)


def clip(vals: Column | str, cfg: ClipConfig) -> Column:
    """1 where a value is at least the threshold; NaN is not."""
    return F.transform(F.slice(vals, 1, cfg.elements), lambda x: ((x >= cfg.threshold) & ~F.isnan(x)).cast("int"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def segment_means(vals: Column, cfg: SaxConfig) -> Column:
    """Means of the segments of standardized values; the last segment takes what is left over."""
    z = normalize(F.slice(vals, 1, cfg.elements), cfg.mean, cfg.sd)
    full = cfg.words - 1
    parts = [F.slice(z, i * cfg.segment + 1, cfg.segment) for i in range(full)] + [F.slice(z, full * cfg.segment + 1, cfg.elements - full * cfg.segment)]
    return F.array(*(_sum(p) / F.lit(float(cfg.segment if i < full else cfg.elements - full * cfg.segment)) for i, p in enumerate(parts)))


def symbols(means: Column | str, cfg: SaxConfig) -> Column:
    """The number of breakpoints below each mean."""
    return F.transform(means, lambda a: sum(((F.lit(b) < a).cast("int") for b in cfg.breakpoints), F.lit(0)))


def sax(vals: Column | str, cfg: SaxConfig) -> Column:
    return symbols(segment_means(F.col(vals) if isinstance(vals, str) else vals, cfg), cfg)


def dot(vals: Column, start: Column, projection: list[float]) -> Column:
    """The inner product of the projection with the values from position start (from 0), summed left to right."""
    total = F.lit(0.0)
    for j, v in enumerate(projection):
        total = total + F.lit(v) * F.get(vals, start + F.lit(j))
    return total


def projections(vals: Column | str, cfg: ShingleConfig) -> Column:
    col = F.col(vals) if isinstance(vals, str) else vals
    return F.transform(F.sequence(F.lit(0), F.lit(cfg.bits - 1)), lambda i: dot(col, i * F.lit(cfg.stride), cfg.projection))


def sketch(vals: Column | str, cfg: ShingleConfig) -> Column:
    """1 where the projection at a position is not negative."""
    return F.transform(projections(vals, cfg), lambda d: ((d >= 0) & ~F.isnan(d)).cast("int"))


def shingles(bits: Column | str, cfg: ShingleConfig) -> Column:
    """The shingle read at each stride, first bit highest."""
    col = F.col(bits) if isinstance(bits, str) else bits

    def read(i: Column) -> Column:
        at = i * F.lit(cfg.shingle_stride)
        return sum((F.get(col, at + F.lit(k)) * F.lit(2 ** (cfg.shingle_bits - 1 - k)) for k in range(cfg.shingle_bits)), F.lit(0))

    return F.transform(F.sequence(F.lit(0), F.lit(cfg.shingles - 1)), read)


def shingle_counts(grams: Column | str, cfg: ShingleConfig) -> Column:
    """How often each of the 2**shingle_bits shingles occurs."""
    col = F.col(grams) if isinstance(grams, str) else grams
    return F.transform(F.sequence(F.lit(0), F.lit(cfg.kinds - 1)), lambda c: F.size(F.filter(col, lambda g: g == c)))
