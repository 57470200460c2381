"""Similarities of two encodings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.config import SaxConfig


def run_length(a: Column | str, b: Column | str, growth: float) -> Column:
    """Agreement that rewards runs: a run of r equal positions adds ((1 + growth)^r - 1) / growth (r at growth 0)."""
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, F.lit("1")).otherwise(F.lit("0")))
    runs = F.filter(F.transform(F.split(F.concat_ws("", same), "0"), lambda s: F.length(s)), lambda r: r > 0)
    part = (lambda r: r.cast("double")) if growth == 0 else (lambda r: (F.pow(F.lit(1 + growth), r) - 1) / F.lit(growth))
    return F.aggregate(runs, F.lit(0.0), lambda s, r: s + part(r))


def distance_table(breakpoints: list[float]) -> list[list[float]]:
    """Distances of symbols: none between neighbours, else the gap between their areas."""
    n = len(breakpoints) + 1
    return [[0.0 if abs(i - j) <= 1 else breakpoints[max(i, j) - 1] - breakpoints[min(i, j)] for j in range(n)] for i in range(n)]


def mindist(a: Column | str, b: Column | str, cfg: SaxConfig) -> Column:
    """The least distance two series with these symbols can have; the ratio of lengths is a whole number unless exact_ratio."""
    flat = [x * x for row in distance_table(cfg.breakpoints) for x in row]
    table = F.array(*map(F.lit, flat))
    square = F.aggregate(F.zip_with(a, b, lambda x, y: F.get(table, x * F.lit(cfg.alphabet) + y)), F.lit(0.0), lambda s, x: s + x)
    ratio = cfg.elements / cfg.words if cfg.exact_ratio else float(cfg.elements // cfg.words)
    return F.sqrt(F.lit(ratio)) * F.sqrt(square)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared part of two sets of shingles; 0 if both are empty."""
    shared, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ > 0, shared / all_).otherwise(0.0)
