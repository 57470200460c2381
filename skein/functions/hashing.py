"""Hash codes of encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.config import ShingleConfig
from skein.functions.encode import literals


def digits_code(enc: Column, offset: int, code_len: int) -> Column:
    """code_len symbols from an offset, packed as the digits of a decimal number."""
    return sum((F.get(enc, F.lit(offset + k)).cast("long") * F.lit(10 ** (code_len - 1 - k)) for k in range(code_len)), F.lit(0).cast("long"))


def substring_codes(encoded: DataFrame, offsets: list[int], code_len: int, enc: str = "enc") -> DataFrame:
    """(item, table_id, code): one row per item and table; table_id counts from 1."""
    each = F.array(*(F.struct(F.lit(t + 1).alias("table_id"), digits_code(F.col(enc), o, code_len).alias("code")) for t, o in enumerate(offsets)))
    return encoded.select("item", F.inline(each))


def draw_code(counts: Column, draws: list[float], n_shingles: int) -> Column:
    """The first draw whose fraction is below the weight of the shingle it points to; null if none is."""
    whole, part = [int(x) for x in draws], [x - int(x) for x in draws]
    taken = F.filter(F.sequence(F.lit(0), F.lit(len(draws) - 1)), lambda j: F.get(literals(part), j) < F.get(counts, F.get(literals(whole), j)) / F.lit(float(n_shingles)))
    return F.get(taken, F.lit(0)).cast("long")


def draw_codes(counted: DataFrame, cfg: ShingleConfig, counts: str = "counts") -> DataFrame:
    """(item, table_id, code): weighted min-hash codes; an item without an accepted draw has no row in that table."""
    each = F.array(*(F.struct(F.lit(t + 1).alias("table_id"), draw_code(F.col(counts), d, cfg.shingles).alias("code")) for t, d in enumerate(cfg.draws)))
    return counted.select("item", F.inline(each)).where("code is not null")
