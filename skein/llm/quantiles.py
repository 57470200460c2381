"""Percentiles of very large numeric columns from dyadic Count-sketches.

Values are encoded as integers of 16 bits over the range of their sensor. A sketch holds, for each binary resolution, how
many values fall into each cell: exactly down to 1,024 cells, and in a signed Count-sketch for the finer levels. Values
beyond the range have cells of their own, of a fixed relative width, which are counted exactly and kept only where occupied.
Sketches are linear: they merge by addition, over partitions and over days, and a deletion is an addition of weight -1. A
percentile is found by descending the levels, each step choosing the half that holds the wanted rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.tokens import mix
from skein.session import lookup_join, materialize, row_count

BITS, EXACT_BITS, ROWS, WIDTH = 16, 10, 5, 256
#: Stated bound: the rank of an answer is off by at most this part of the number of values and one, but for one in a thousand.
RANK_ERROR = 0.02
#: The range is widened by this part on either side; what lies further out is coded by its distance from that end.
MARGIN = 0.05
#: Distances beyond an end keep this many bits after the leading one: at most 2,097,152 cells a side, infinity included.
TAIL_BITS = 10
#: The part of its distance from the end by which an answer beyond the range may be off, unless a cell of the range is more.
TAIL_ERROR = 2.0 ** -(TAIL_BITS + 1)
#: Sketches are added up while they hold fewer occupied cells beyond the range than this.
TAIL_HELD = 2_000_000
LEVELS = BITS - EXACT_BITS
CELLS = (1 << EXACT_BITS) + LEVELS * ROWS * WIDTH
#: Readings that a task sketches at once, and sketches that it holds at once.
SLICE_ROWS, SLICE_KEYS = 200_000, 200
PARTIAL = "var_no int, day date, n long, sketch binary, tails binary"
NO_TAILS = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _ends(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends of the widened range and the width of its cells."""
    wide = (hi - lo) * MARGIN
    return lo - wide, hi + wide, (hi - lo + 2 * wide) / (1 << BITS)


def _far(distance: np.ndarray) -> np.ndarray:
    """The leading bits of a positive double, which keep the order."""
    return np.ascontiguousarray(distance, float).view(np.int64) >> (52 - TAIL_BITS)


def encode(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The code of each value: of 16 bits within the widened range; above it 65,536 or more, below it negative."""
    x, lo, hi = np.broadcast_arrays(np.asarray(x, float), lo, hi)
    low, high, unit = _ends(lo, hi)
    with np.errstate(invalid="ignore", over="ignore"):
        cell = np.floor((x - low) / unit)
        above, below = cell > (1 << BITS) - 1, cell < 0
        code = np.where(above | below, 0, cell).astype(np.int64)
        most = np.where(np.isinf(x), np.inf, np.finfo(float).max)
        for out, distance, sign, first in ((above, x - high, 1, 1 << BITS), (below, low - x, -1, -1)):
            code[out] = first + sign * _far(np.clip(distance[out], unit[out], most[out]))
    return code


def decode(code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The middle of each code's cell."""
    code, lo, hi = np.broadcast_arrays(np.asarray(code, float).astype(np.int64), np.asarray(lo, float), np.asarray(hi, float))
    low, high, unit = _ends(lo, hi)
    far = np.where(code < 0, -1 - code, np.maximum(code - (1 << BITS), 0))
    nearest, infinite = _far(unit), 2047 << TAIL_BITS
    middle = ((np.minimum(far, infinite - 1) << (52 - TAIL_BITS)) + (1 << (51 - TAIL_BITS))).view(float)
    distance = np.where(far >= infinite, np.inf, np.where(far <= nearest, unit / 2, middle))
    return np.where(code < 0, low - distance, np.where(code >= 1 << BITS, high + distance, low + (code + 0.5) * unit))


def _place(prefix: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter and the sign of cells of a fine level."""
    h = mix(prefix.astype(np.uint64) + np.uint64((level * ROWS + row + 1) << 32))
    return (1 << EXACT_BITS) + (level * ROWS + row) * WIDTH + (h & np.uint64(WIDTH - 1)).astype(np.int64), 1 - 2 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


def build(code: np.ndarray, group: np.ndarray, n_groups: int, weight: np.ndarray | None = None) -> np.ndarray:
    """The sketches (n_groups x CELLS) of encoded values within the range; weight -1 deletes. Others: see tails_of()."""
    w = np.ones(len(code)) if weight is None else weight.astype(float)
    inside = (code >= 0) & (code < 1 << BITS)
    code, group, w = code[inside], group[inside], w[inside]
    spots, weights = [group * CELLS + (code >> LEVELS)], [w]
    for level in range(LEVELS):
        prefix = code >> (LEVELS - 1 - level)
        for row in range(ROWS):
            at, sign = _place(prefix, level, row)
            spots.append(group * CELLS + at)
            weights.append(w * sign)
    flat = np.bincount(np.concatenate(spots), np.concatenate(weights), minlength=n_groups * CELLS)
    return np.rint(flat).astype(np.int64).reshape(n_groups, CELLS)


def add_tails(*tails: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of (codes, counts): distinct codes in order, none with a count of 0."""
    code, at = np.unique(np.concatenate([t[0] for t in tails]), return_inverse=True)
    count = np.zeros(len(code), np.int64)
    np.add.at(count, at, np.concatenate([t[1] for t in tails]))
    return code[count != 0], count[count != 0]


def tails_of(code: np.ndarray, group: np.ndarray, n_groups: int, weight: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group the exact counts of its codes beyond the range; weight -1 deletes."""
    out = np.flatnonzero((code < 0) | (code >= 1 << BITS))
    w = np.ones(len(code), np.int64) if weight is None else weight.astype(np.int64)
    tails = [NO_TAILS] * n_groups
    out = out[np.argsort(group[out], kind="stable")]
    for part in np.split(out, np.flatnonzero(np.diff(group[out])) + 1) if len(out) else []:
        tails[group[part[0]]] = add_tails((code[part], w[part]))
    return tails


def counts_of(sketches: np.ndarray, row: np.ndarray, level: int, prefix: np.ndarray) -> np.ndarray:
    """How many values of sketch `row` have each prefix at a fine level: the median over the rows of the sketch."""
    est = [sketches[row, at] * sign for at, sign in (_place(prefix, level, r) for r in range(ROWS))]
    return np.median(np.stack(est), axis=0)


def quantile_codes(sketches: np.ndarray, n: np.ndarray, quantiles: list[float], tails: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """For each sketch and quantile q the code whose rank is nearest q (n - 1), counted from 0; tails: of each sketch."""
    tails = [NO_TAILS] * len(n) if tails is None else tails
    below = np.array([t[1][t[0] < 0].sum() for t in tails], np.int64)
    top = np.cumsum(sketches[:, : 1 << EXACT_BITS], axis=1)
    k = len(quantiles)
    row = np.repeat(np.arange(len(n)), k)
    whole = (n[:, None] - 1) * np.array(quantiles)[None]
    rank = whole - below[:, None]
    cell = np.stack([(top <= rank[:, j : j + 1]).sum(1) for j in range(k)], 1).ravel()
    cell = np.minimum(cell, (1 << EXACT_BITS) - 1)
    inside = sketches[row, cell].astype(float)
    left = rank.ravel() - (top[row, cell] - inside)
    for level in range(LEVELS):
        # the halves share their parent's count: both estimates are used
        a, b = counts_of(sketches, row, level, 2 * cell), counts_of(sketches, row, level, 2 * cell + 1)
        a = np.clip((a + inside - b) / 2, 0.0, inside)
        low = left < a
        cell = 2 * cell + ~low
        inside, left = np.where(low, a, inside - a), np.where(low, left, left - a)
    cell = cell.reshape(len(n), k)
    for i, (code, count) in enumerate(tails):
        if len(code):
            cum = np.cumsum(count)
            for side, at in ((whole[i] < below[i], whole[i]), (rank[i] >= top[i, -1], whole[i] - top[i, -1])):
                cell[i, side] = code[np.minimum(np.searchsorted(cum, at[side], "right"), len(code) - 1)]
    return cell


_pack = zstandard.ZstdCompressor(level=1)
_unpack = zstandard.ZstdDecompressor()


def to_bytes(sketch: np.ndarray) -> bytes:
    """A compact form: the width of a counter, then the compressed counters."""
    most = int(np.abs(sketch).max(initial=0))
    kind = np.int8 if most < 128 else np.int16 if most < 32768 else np.int32 if most < 2**31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + _pack.compress(sketch.astype(kind).tobytes())


def from_bytes(b: bytes) -> np.ndarray:
    return np.frombuffer(_unpack.decompress(b[1:]), f"<i{b[0]}").astype(np.int64)


def tails_to_bytes(tails: tuple[np.ndarray, np.ndarray]) -> bytes:
    return _pack.compress(np.concatenate(tails).astype("<i8").tobytes()) if len(tails[0]) else b""


def tails_from_bytes(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not b:
        return NO_TAILS
    both = np.frombuffer(_unpack.decompress(b), "<i8")
    return both[: len(both) // 2], both[len(both) // 2 :]


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of (var_no, day, item, weight, lo, hi) rows in any order: one for each sensor and day of a slice of rows.

    A slice is sorted by sensor and day and sketched a bounded number of keys at a time, however sparse they are.
    """

    def sketch(t: pa.Table) -> Iterator[pa.RecordBatch]:
        v, day, x, w, lo, hi = (t.column(k).to_numpy() for k in range(6))
        day = day.astype("datetime64[D]").astype(np.int64)
        order = np.lexsort((day, v))
        v, day, x, w, lo, hi = (c[order] for c in (v, day, x, w, lo, hi))
        first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (day[1:] != day[:-1]))))
        code, ends = encode(x, lo, hi), np.concatenate((first, [len(v)]))
        for k in range(0, len(first), SLICE_KEYS):
            a, b = int(ends[k]), int(ends[min(len(first), k + SLICE_KEYS)])
            at = first[k : k + SLICE_KEYS]
            group = np.searchsorted(at, np.arange(a, b), "right") - 1
            sk, tails = build(code[a:b], group, len(at), w[a:b]), tails_of(code[a:b], group, len(at), w[a:b])
            n = np.rint(np.bincount(group, w[a:b], len(at))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[at], pa.int32()), pa.array(day[at].astype("datetime64[D]")), pa.array(n), pa.array([to_bytes(z) for z in sk], pa.binary()), pa.array([tails_to_bytes(z) for z in tails], pa.binary())],
                ["var_no", "day", "n", "sketch", "tails"],
            )

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= SLICE_ROWS:
            yield from sketch(pa.Table.from_batches(held).combine_chunks())
            held, rows = [], 0
    if rows:
        yield from sketch(pa.Table.from_batches(held).combine_chunks())


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, sketch, tails): sums of sketches. Each task first adds what it holds, so few sketches are shuffled."""
    fields = [f for f in sketches.schema.fields if f.name in by]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", n long, sketch binary, tails binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        far = 0
        for b in batches:
            cols = b.to_pydict()
            for i in range(b.num_rows):
                key = tuple(cols[c][i] for c in by)
                s, t = from_bytes(cols["sketch"][i]), tails_from_bytes(cols["tails"][i])
                if key in held:
                    far -= len(held[key][2][0])
                    held[key][0] += cols["n"][i]
                    held[key][1] += s
                    held[key][2] = add_tails(held[key][2], t)
                else:
                    held[key] = [cols["n"][i], s, t]
                far += len(held[key][2][0])
                if len(held) > 2000 or far > TAIL_HELD:
                    yield pack(held)
                    held, far = {}, 0
        if held:
            yield pack(held)

    arrow = {"int": pa.int32(), "date": pa.date32(), "string": pa.string(), "bigint": pa.int64()}

    def pack(held: dict) -> pa.RecordBatch:
        keys = list(zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(k, arrow[f.dataType.simpleString()]) for k, f in zip(keys, fields)] + [pa.array([x[0] for x in held.values()], pa.int64()), pa.array([to_bytes(x[1]) for x in held.values()], pa.binary()), pa.array([tails_to_bytes(x[2]) for x in held.values()], pa.binary())], [*(f.name for f in fields), "n", "sketch", "tails"])

    names = [f.name for f in fields]
    part = sketches.select(*names, "n", "sketch", "tails").mapInArrow(add, schema)
    return part.repartition(*names).sortWithinPartitions(*names).mapInArrow(add_sorted(names, pack), schema)


def add_sorted(by: list[str], pack):
    """Adds up the sketches of each key, which stand side by side: one key is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held = None, None
        for b in batches:
            cols = b.to_pydict()
            done: dict = {}
            for i in range(b.num_rows):
                key = tuple(cols[c][i] for c in by)
                one = [cols["n"][i], from_bytes(cols["sketch"][i]), tails_from_bytes(cols["tails"][i])]
                if key == open_:
                    held = [held[0] + one[0], held[1] + one[1], add_tails(held[2], one[2])]
                    continue
                if held is not None:
                    done[open_] = held
                    if len(done) >= SLICE_KEYS:
                        yield pack(done)
                        done = {}
                open_, held = key, one
            if done:
                yield pack(done)
        if held is not None:
            yield pack({open_: held})

    return run


def _counted(readings: DataFrame) -> DataFrame:
    """(reading_id, var_no, day, item) of the rows that can count."""
    r = readings.select(F.col("reading_id").cast("long").alias("reading_id"), F.col("var_no").cast("int").alias("var_no"), F.to_date("ts").alias("day"), F.col("item").cast("double").alias("item"))
    return r.where("var_no is not null and day is not null and reading_id is not null and item is not null and not isnan(item)")


def sketched(rows: DataFrame, sensors: DataFrame) -> DataFrame:
    """(var_no, day, n, sketch, tails): partial sketches of (var_no, day, item, weight), made where the rows are read."""
    limits = sensors.where("phys_hi > phys_lo").select(F.col("var_no").cast("int").alias("var_no"), "phys_lo", "phys_hi").dropDuplicates(["var_no"])
    return lookup_join(rows, limits, ["var_no"]).select("var_no", "day", "item", F.col("weight").cast("double").alias("weight"), "phys_lo", "phys_hi").mapInArrow(_partials, PARTIAL)


def daily_sketches(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """(var_no, day, n, sketch, tails): partial sketches per sensor and day, to be merged; see percentiles() for what counts.

    Readings are sketched before anything is shuffled, so that a sensor and day of any size is a few sketches. Of the
    readings only their ids are shuffled, to find those sent again; these are deleted from the sketches (weight -1).
    """
    r = _counted(readings)
    again = materialize(r.groupBy("reading_id").agg(F.count("*").alias("c")).where("c > 1").select("reading_id"))
    whole = sketched(r.withColumn("weight", F.lit(1)), sensors)
    if not row_count(again):
        return whole
    copy = F.row_number().over(W.partitionBy("reading_id").orderBy("var_no", "day", "item"))
    more = lookup_join(r, again, ["reading_id"], "left_semi").withColumn("copy", copy).where("copy > 1").withColumn("weight", F.lit(-1))
    return whole.union(sketched(more, sensors))


def answers(sketches: DataFrame, sensors: DataFrame, quantiles: list[float], by: list[str]) -> DataFrame:
    """(label, by without var_no..., n, p..): the percentiles of merged sketches."""
    names = [f"p{round(q * 100):02d}" for q in quantiles]
    keep = [c for c in by if c != "var_no"]
    of = lookup_join(sketches, sensors.select(F.col("var_no").cast("int").alias("var_no"), "label", "phys_lo", "phys_hi").dropDuplicates(["var_no"]), ["var_no"])
    schema = "label string" + "".join(f", {c} date" for c in keep) + ", n long" + "".join(f", {p} double" for p in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                cols = b.to_pydict()
                vals = quantile_codes(np.stack([from_bytes(x) for x in cols["sketch"]]), np.array(cols["n"]), quantiles, [tails_from_bytes(x) for x in cols["tails"]])
                lo, hi = (np.array(cols[c], float) for c in ("phys_lo", "phys_hi"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols["label"], pa.string()), *(pa.array(cols[c], pa.date32()) for c in keep), pa.array(cols["n"], pa.int64()), *(pa.array(decode(vals[:, k], lo, hi)) for k in range(len(names)))],
                    ["label", *keep, "n", *names],
                )

    return of.select("label", *keep, "n", "sketch", "tails", "phys_lo", "phys_hi").where("n > 0").mapInArrow(run, schema)


QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def percentiles(readings: DataFrame, sensors: DataFrame, quantiles: list[float] = QUANTILES, per_day: bool = True) -> DataFrame:
    """(label, [day,] n, p05, p25, ...): percentiles of item per sensor label, for each day of ts or over all days.

    The label is that of var_no in sensors, however a reading spells it. A reading sent twice counts once; null and NaN
    items, and readings without var_no, ts or reading_id, do not count. A sensor without a range in sensors is left out.
    Values are exact to a 65,536th of the sensor's range widened by a tenth, or, further out, to TAIL_ERROR of their
    distance from the end of that range if that is more; an infinite answer is infinite. Ranks are off by RANK_ERROR of n and one at most, but for one answer in a thousand. Empty tables give no
    rows. All days together are merged from the sketches of the days.
    """
    by = ["var_no", "day"] if per_day else ["var_no"]
    return answers(merge(daily_sketches(readings, sensors), by), sensors, quantiles, by)


def without(sketches: DataFrame, readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """The sketches with readings (each listed once) deleted from them: a correction that needs no other reading."""
    return sketches.union(sketched(_counted(readings).dropDuplicates(["reading_id"]).withColumn("weight", F.lit(-1)), sensors))


def exact_percentiles(readings: DataFrame, sensors: DataFrame, quantiles: list[float] = QUANTILES, per_day: bool = False) -> DataFrame:
    """(label, [day,] q, value): the exact percentiles (the value of rank floor(q (n - 1)), from 0), found by the sketches.

    Answers twice the stated error below and above q enclose the exact one; a second pass counts what lies below, and each
    distinct value between. If an answer is off by more than its bound the value is null.
    """
    day = ["day"] if per_day else []
    found = materialize(answers(merge(daily_sketches(readings, sensors), ["var_no", *day]), sensors, sorted({z for q in quantiles for z in (max(0.0, q - 2 * RANK_ERROR), min(1.0, q + 2 * RANK_ERROR))}), ["var_no", *day]))
    wide = (F.col("phys_hi") - F.col("phys_lo")) * MARGIN
    of = sensors.where("phys_hi > phys_lo").select(F.col("var_no").cast("int").alias("var_no"), "label", ((F.col("phys_hi") - F.col("phys_lo") + 2 * wide) / (1 << BITS)).alias("cell"), (F.col("phys_lo") - wide).alias("lo"), (F.col("phys_hi") + wide).alias("hi")).dropDuplicates(["var_no"])
    off = lambda p: F.greatest("cell", (F.col(p) - F.col("hi")) * 2 * TAIL_ERROR, (F.col("lo") - F.col(p)) * 2 * TAIL_ERROR)
    name = lambda q: f"p{round(q * 100):02d}"
    ends = [(q, name(max(0.0, q - 2 * RANK_ERROR)), name(min(1.0, q + 2 * RANK_ERROR))) for q in quantiles]
    brackets = lookup_join(found, of, ["label"]).select("label", *day, "n", F.inline(F.array(*[F.struct(F.lit(q).alias("q"), (F.col(a) - off(a)).alias("from"), (F.col(b) + off(b)).alias("to")) for q, a, b in ends])))
    r = lookup_join(_counted(readings).dropDuplicates(["reading_id"]), of.select("var_no", "label"), ["var_no"]).select("label", *day, "item")
    met = lookup_join(r, materialize(brackets), ["label", *day]).where("item <= to")
    # what lies below the bracket is one row per partition and group, what lies within one per distinct value
    counts = materialize(met.groupBy("label", *day, "q", "n", F.when(F.col("item") >= F.col("from"), F.col("item") + 0.0).alias("value")).agg(F.count("*").alias("c")))
    upto = F.sum("c").over(W.partitionBy("label", *day, "q").orderBy(F.col("value").asc_nulls_first()))
    rank = F.floor(F.col("q") * (F.col("n") - 1) + 1e-9)
    return counts.withColumn("upto", upto).where((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)).select("label", *day, "q", "value")


def within_bounds(readings: DataFrame, sensors: DataFrame, found: DataFrame, quantiles: list[float] = QUANTILES) -> DataFrame:
    """(label, [day,] n, bounded): whether every percentile's rank is within RANK_ERROR of n and one of the exact one, up to its cell.

    A check that counts all readings once more; it is no part of the sketch.
    """
    by = [c for c in ("label", "day") if c in found.columns]
    wide = (F.col("phys_hi") - F.col("phys_lo")) * MARGIN
    of = sensors.where("phys_hi > phys_lo").select(F.col("var_no").cast("int").alias("var_no"), "label", ((F.col("phys_hi") - F.col("phys_lo") + 2 * wide) / (1 << BITS)).alias("cell"), (F.col("phys_lo") - wide).alias("lo"), (F.col("phys_hi") + wide).alias("hi")).dropDuplicates(["var_no"])
    r = readings.where("item is not null and not isnan(item) and ts is not null and reading_id is not null").select("reading_id", F.col("var_no").cast("int").alias("var_no"), F.to_date("ts").alias("day"), "item").dropDuplicates(["reading_id"])
    # a hot label is summed in salts: the aggregates below are map-side combined
    r = lookup_join(r, of, ["var_no"]).drop("var_no")
    joined = lookup_join(r, found.withColumnRenamed("n", "n_found"), by)
    names = [f"p{round(q * 100):02d}" for q in quantiles]
    # an answer's tolerance: a cell of the range, or what the stated error is at its distance beyond the range
    off = {p: F.when(F.abs(p) == float("inf"), 0.0).otherwise(F.greatest("cell", (F.col(p) - F.col("hi")) * 2 * TAIL_ERROR, (F.col("lo") - F.col(p)) * 2 * TAIL_ERROR)) for p in names}
    sums = [F.sum((F.col("item") < F.col(p) - off[p]).cast("long")).alias(f"lo_{p}") for p in names] + [F.sum((F.col("item") <= F.col(p) + off[p]).cast("long")).alias(f"hi_{p}") for p in names]
    total = joined.groupBy(*by).agg(F.count("*").alias("n"), F.max("n_found").alias("n_found"), *sums)
    ok = F.col("n") == F.col("n_found")
    for p, q in zip(names, quantiles):
        rank, slack = (F.col("n") - 1) * q, F.col("n") * RANK_ERROR + 1
        ok = ok & (F.col(f"lo_{p}") <= rank + slack) & (F.col(f"hi_{p}") >= rank + 1 - slack)
    return total.select(*by, "n", ok.alias("bounded"))
