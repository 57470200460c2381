"""Implausible spikes in measurements, judged against each source's own behaviour.

One shuffle brings each series (flight and sensor) together in time order and packs it into a compact row; every
later pass is a scan of those packed rows, without a shuffle of readings:

1. histograms of items and steps per source (tail and sensor), and the exact median step from the cells that hold it;
2. rounds of a robust autoregression of order one per source: fit, test for additive outliers, clean, fit again;
3. the tests: physical limits, stuck runs, and the autoregression's additive outliers and level shifts, verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.session import lookup_join, materialize, release

#: Sensors that rest by nature: their equal readings are no fault (for the last four only zeros).
RESTING, RESTING_AT_ZERO = ("PH", "WOW"), ("VIB_1", "VIB_2", "VIB_3", "VIB_4")
STUCK_RUN, SPIKE_RUN, SHIFT_RUN, STEPS = 6, 3, 3, 15.0
#: A residual beyond this many robust deviations is implausible; rounds of fitting at most (a round without news ends them).
NOMINATE, ROUNDS = 3.0, 3
#: A series longer than this is worked on in overlapping segments, so no task holds an unbounded series.
SEGMENT, HALO = 200_000, 16
NONE, LIMIT, STUCK, SPIKE, SHIFT = range(5)
KINDS = np.array(["", "limit", "stuck", "spike", "level_shift"], object)
_NO_KEY, _NO_TAIL = -(2**63), "\x00"

PACK = "flight_no long, var_no int, tail string, own_lo int, own_hi int, ids array<long>, items array<double>"


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (flight_no, var_no, tail, reading_id, item) to one row per series or segment; rows sent twice are dropped."""
    carry: pa.Table | None = None
    ctx = 0

    def emit(t: pa.Table, starts: np.ndarray, stops: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        at = pa.array(starts)
        end = int(stops[-1])
        offs = np.concatenate((starts, [end]))
        return pa.RecordBatch.from_arrays(
            [t["f"].take(at).combine_chunks(), t["v"].take(at).combine_chunks(), t["t"].take(at).combine_chunks(), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()),
             _lists(t["id"].to_numpy()[:end], offs, pa.int64()), _lists(t["x"].to_numpy()[:end], offs, pa.float64())],
            ["flight_no", "var_no", "tail", "own_lo", "own_hi", "ids", "items"],
        )

    for b in batches:
        t = pa.table(b.columns, ["f", "v", "t", "id", "x"])
        if carry is not None:
            t = pa.concat_tables([carry, t]).combine_chunks()
        if not t.num_rows:
            continue
        f, v, i = (t[c].to_numpy() for c in ("f", "v", "id"))
        same = (f[1:] == f[:-1]) & (v[1:] == v[:-1])
        twice = same & (i[1:] == i[:-1])
        if twice.any():
            t = t.filter(pa.array(np.concatenate(([True], ~twice))))
            f, v = t["f"].to_numpy(), t["v"].to_numpy()
            same = (f[1:] == f[:-1]) & (v[1:] == v[:-1])
        starts = np.concatenate(([0], np.flatnonzero(~same) + 1))
        if len(starts) > 1:
            stops = starts[1:]
            lo = np.zeros(len(stops), np.int32)
            lo[0] = ctx
            yield emit(t, starts[:-1], stops, lo, stops - starts[:-1])
            ctx = 0
        carry = t.slice(int(starts[-1]))
        n = carry.num_rows
        if n > SEGMENT:
            yield emit(carry, np.array([0]), np.array([n]), np.array([ctx]), np.array([n - HALO]))
            carry, ctx = carry.slice(n - 2 * HALO), HALO
        carry = carry.combine_chunks()
    if carry is not None and carry.num_rows:
        n = carry.num_rows
        yield emit(carry, np.array([0]), np.array([n]), np.array([ctx]), np.array([n]))


def pack_series(readings: DataFrame) -> DataFrame:
    """Rows of PACK from readings; null and NaN items are skipped, a reading_id sent twice counts once.

    Null flight_no, var_no or tail are values of their own; a null ts sorts first. Readings of one instant keep the
    order of their reading_id.
    """
    r = readings.select(
        F.coalesce(F.col("flight_no").cast("long"), F.lit(_NO_KEY)).alias("f"), F.coalesce(F.col("var_no").cast("int"), F.lit(-1)).alias("v"),
        F.coalesce("tail", F.lit(_NO_TAIL)).alias("t"), F.col("reading_id").cast("long").alias("id"), F.col("item").cast("double").alias("x"), "ts",
    ).where("x is not null and not isnan(x) and id is not null")
    return r.repartition("f", "v").sortWithinPartitions("f", "v", "ts", "id").drop("ts").mapInArrow(_pack, PACK)


class Flat:
    """The packed rows of a batch laid end to end."""

    def __init__(self, b: pa.RecordBatch):
        col = {n: b.column(k) for k, n in enumerate(b.schema.names)}
        items = col["items"]
        self.offs = items.offsets.to_numpy()
        base = self.offs[0]
        self.x = items.values.to_numpy()[base : self.offs[-1]]
        self.offs = self.offs - base
        lens = np.diff(self.offs)
        self.row = np.repeat(np.arange(b.num_rows), lens)
        self.pos = np.arange(len(self.x)) - self.offs[self.row]
        self.owned = (self.pos >= col["own_lo"].to_numpy()[self.row]) & (self.pos < col["own_hi"].to_numpy()[self.row])
        self.inner = self.pos > 0  # has a reading before it
        self.ids = col["ids"].values.to_numpy()[base : base + len(self.x)] if "ids" in col else None
        self.var = col["var_no"].to_numpy()
        self.col = col

    def steps(self) -> np.ndarray:
        d = np.zeros(len(self.x))
        with np.errstate(invalid="ignore"):
            d[1:] = np.abs(np.diff(self.x))
        d[~self.inner] = 0
        return d


def _cell(d: np.ndarray) -> np.ndarray:
    """The histogram cell of a number: its sign, exponent and first seven bits, monotone in the number."""
    c = np.abs(d).view(np.int64) >> 45
    return np.where(d < 0, -1 - c, c)


def _middle(cell: np.ndarray) -> np.ndarray:
    """The middle of each cell (nan for one below the lowest)."""
    c = np.where(cell < 0, -1 - cell, cell)
    return np.where(cell < 0, -1.0, 1.0) * np.where(c > 0, ((c << 45) + (1 << 44)).view(float), 0.0)


class Model:
    """The autoregression of each packed row in one round: its own location, and the coefficient and scale of its source."""

    def __init__(self, mu: np.ndarray, plus: np.ndarray, minus: np.ndarray, scale: np.ndarray):
        self.mu = mu
        with np.errstate(invalid="ignore", divide="ignore"):
            self.phi = np.clip(np.nan_to_num((plus**2 - minus**2) / (plus**2 + minus**2)), -0.9999, 0.9999)
        self.scale = 1.4826 * scale

    def residuals(self, x: np.ndarray, s: Flat) -> np.ndarray:
        m, p = self.mu[s.row], self.phi[s.row]
        e = np.zeros(len(x))
        with np.errstate(invalid="ignore"):
            e[1:] = (x[1:] - m[1:]) - p[1:] * (x[:-1] - m[1:])
        return np.where(s.inner, e, 0.0)


def _medians(v: np.ndarray, use: np.ndarray, s: Flat) -> tuple[np.ndarray, np.ndarray]:
    """The median of v over the readings in use of each packed row (nan where it has none), and their number."""
    v, row, n = v[use], s.row[use], len(s.var)
    v = v[np.lexsort((v, row))]
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    out, has = np.full(n, np.nan), count > 0
    out[has] = (v[first[has] + (count[has] - 1) // 2] + v[first[has] + count[has] // 2]) / 2
    return out, count


def _models(s: Flat) -> list[Model]:
    """The rounds fitted so far, from the column of their cells: three a round, of which the last may still lack some."""
    rounds = s.col["fits"]
    width = int(np.diff(rounds.offsets.to_numpy()).max(initial=0))
    flat = np.full((len(s.var), width + -width % 3), _NO_KEY)  # a source without any step has no fit
    flat[np.diff(rounds.offsets.to_numpy()) == width, :width] = rounds.flatten().to_numpy().reshape(-1, width) if width else 0
    mids, mu = np.where(flat == _NO_KEY, np.nan, _middle(flat)), _medians(s.x, np.isfinite(s.x), s)[0]
    return [Model(mu, *mids[:, k : k + 3].T) for k in range(0, mids.shape[1], 3)]


def _counter(kind: str):
    """A pass that gives, per source, weights by the cell of what is to get its median, and (what -1) how many readings are new.

    first: the steps (1), and each series' median sum (2) and difference (3) of neighbours about its location; scale: each
    series' median residual (4); again: 2 to 4 on the series as cleaned by all rounds so far, residuals with the last
    round's coefficient. A series weighs as much as it has readings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = Flat(b)
            tails = s.col["tail"].dictionary_encode()
            var, code = np.unique(s.var, return_inverse=True)
            key = tails.indices.to_numpy().astype(np.int64) * len(var) + code
            x, found = s.x, 0
            models = _models(s) if kind != "first" else []
            if kind == "again":
                x, _, found = clean(s, models)
            d = np.zeros(len(x))
            with np.errstate(invalid="ignore"):
                d[1:] = np.diff(x)
            d[~s.inner] = 0
            moved = s.owned & (d != 0) & np.isfinite(d)  # readings that repeat the one before say nothing of the scatter
            parts = [(1, key[s.row[moved]], np.abs(d[moved]), np.ones(int(moved.sum())))] if kind == "first" else []
            of_rows = []
            if kind != "scale":
                mu, around = _medians(s.x, np.isfinite(s.x), s)[0], np.zeros(len(x))
                with np.errstate(invalid="ignore"):
                    around[1:] = x[1:] + x[:-1] - 2 * mu[s.row[1:]]
                of_rows += [(2, around), (3, d)]
            if kind != "first":
                of_rows += [(4, models[-1].residuals(x, s))]
            for what, v in of_rows:
                v, n = _medians(np.abs(v), moved & np.isfinite(v), s)
                parts.append((what, key[n > 0], v[n > 0], n[n > 0]))
            # kind, source and cell in one number: cells are of 20 bits
            wide = len(tails.dictionary) * len(var)
            all_, back = np.unique(np.concatenate([((what * wide + k) << 20) + _cell(v) + (1 << 19) for what, k, v, _ in parts]), return_inverse=True)
            n = np.bincount(back, np.concatenate([w for *_, w in parts]), len(all_))
            at, cell = np.concatenate(((all_ >> 20) % wide, [0])), (all_ & ((1 << 20) - 1)) - (1 << 19)
            yield pa.RecordBatch.from_arrays(
                [tails.dictionary.take(pa.array(at // len(var))), pa.array(var[at % len(var)], pa.int32()), pa.array(np.concatenate(((all_ >> 20) // wide, [-1])), pa.int32()),
                 pa.array(np.concatenate((cell, [0]))), pa.array(np.concatenate((n, [found])).astype(np.int64))],
                ["tail", "var_no", "what", "cell", "n"],
            )

    return run


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact step counts within the cells that hold the median."""
    for b in batches:
        if not b.num_rows:
            continue
        s = Flat(b)
        d = s.steps()
        use = np.flatnonzero(s.owned & (d > 0) & np.isfinite(d))
        cell = _cell(d[use])
        keep = (cell == s.col["cell_a"].to_numpy()[s.row[use]]) | (cell == s.col["cell_b"].to_numpy()[s.row[use]])
        use = use[keep]
        yield pa.RecordBatch.from_arrays([s.col["tail"].take(pa.array(s.row[use])), s.col["var_no"].take(pa.array(s.row[use])), pa.array(cell[keep]), pa.array(d[use])], ["tail", "var_no", "cell", "d"])


def nominated(x: np.ndarray, s: Flat, m: Model, live: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """The additive outliers that the model nominates: (first reading, length, sign, whether they are plain).

    An outlier of k readings leaves the pattern 1, 1 - phi, ..., -phi in the residuals from its first reading to the one
    after it. Its size is estimated by least squares on that pattern, and implausible beyond NOMINATE robust deviations.
    The estimate hardly feels how far the series is from its location, which adds alike to all residuals. It is plain if
    the first and the last residual are implausible by themselves, in opposite directions.
    """
    e = m.residuals(x, s)
    p, bar, end = m.phi[s.row], NOMINATE * m.scale[s.row], s.offs[s.row + 1]
    big = np.abs(e) > bar
    patches = []
    with np.errstate(invalid="ignore"):
        for k in range(1, SPIKE_RUN + 1):
            i = np.flatnonzero(live & (np.arange(len(x)) + k < end))
            if not len(i):
                continue
            size, norm = e[i] - p[i] * e[i + k], 1 + p[i] ** 2 + (k - 1) * (1 - p[i]) ** 2
            for j in range(1, k):
                size = size + (1 - p[i]) * e[i + j]
            ok = np.abs(size) > bar[i] * np.sqrt(norm)
            i, size = i[ok], size[ok]
            patches.append((i, k, np.sign(size), big[i] & big[i + k] & (e[i] * e[i + k] < 0)))
    return patches


def shifted(x: np.ndarray, s: Flat, m: Model, live: np.ndarray) -> np.ndarray:
    """Where an innovation is implausible by itself or against the one before, which holds the same pull to the location."""
    e = m.residuals(x, s)
    bar = NOMINATE * m.scale[s.row]
    turn = np.zeros(len(x))
    with np.errstate(invalid="ignore"):
        turn[1:] = np.where(s.inner[:-1], np.abs(e[1:] - e[:-1]), 0) / 2**0.5
        return live & ((np.abs(e) > bar) | (turn > bar))


def clean(s: Flat, models: list[Model], live: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple], int]:
    """The series with each round's plain outliers replaced by what stands before them, all nominations, and how many readings the last round replaced."""
    x, outliers, found = s.x, [], 0
    live = s.inner if live is None else live
    gone = np.zeros(len(x), bool)
    for m in models:
        patches = nominated(x, s, m, live)
        before = gone.copy()
        for i, k, _, plain in patches:
            gone[(i[plain][:, None] + np.arange(k)).ravel()] = True
        outliers += patches
        found = int((gone & ~before & s.owned).sum())
        if (gone != before).any():
            last = np.maximum.accumulate(np.where(gone, -1, np.arange(len(x))))
            x = np.where(gone & (last >= s.offs[s.row]), s.x[np.maximum(last, 0)], s.x)
    return x, outliers, found


def judge(s: Flat, lo, hi, step, models: list[Model], rests, rests_zero) -> np.ndarray:
    """The kind of each reading; the parameters are arrays per packed row. The last round's model tests for level shifts.

    What the autoregression nominates is then verified on the readings themselves: an additive outlier must lie beyond
    both neighbours by more than STEPS usual steps; a level shift is the first of SHIFT_RUN readings that all lie beyond
    each of the SHIFT_RUN before it by as much, spikes left out and none of them off limits or stuck.
    """
    x, row, n = s.x, s.row, len(s.x)
    kind = np.zeros(n, np.int8)
    if not n:
        return kind
    with np.errstate(invalid="ignore"):
        limit = (x < lo[row]) | (x > hi[row])
        new = np.ones(n, bool)
        new[1:] = ~(s.inner[1:] & (x[1:] == x[:-1]))
        first = np.flatnonzero(new)
        length = np.diff(np.concatenate((first, [n])))
        stuck = np.repeat(length, length) >= STUCK_RUN
        stuck &= ~rests[row] & ~(rests_zero[row] & (x == 0))
        off = limit | stuck
        t, live = STEPS * step[row], s.inner & ~rests[row]
        spike, shift = np.zeros(n, bool), np.zeros(n, bool)
        _, outliers, _ = clean(s, models, live)
        for i, k, sign, _ in outliers:
            inside = i[:, None] + np.arange(-1, k + 1)
            v = sign[:, None] * x[inside]
            ok = (v[:, 1:-1].min(1) - np.maximum(v[:, 0], v[:, -1]) > t[i]) & ~off[inside].any(1)
            spike[inside[ok][:, 1:-1].ravel()] = True
        if models:
            kept = np.flatnonzero(~spike)
            last = np.maximum.accumulate(np.where(spike, -1, np.arange(n)))
            i = np.flatnonzero(shifted(np.where(spike & (last >= s.offs[row]), x[np.maximum(last, 0)], x), s, models[-1], live) & ~spike)
            i = np.searchsorted(kept, i)
            i = i[(i >= SHIFT_RUN) & (i + SHIFT_RUN <= len(kept))]
            inside = kept[i[:, None] + np.arange(-SHIFT_RUN, SHIFT_RUN)]
            v = x[inside]
            rise, fall = (g(v[:, SHIFT_RUN:]) - h(v[:, :SHIFT_RUN]) for g, h in ((lambda z: z.min(1), lambda z: z.max(1)), (lambda z: z.max(1), lambda z: z.min(1))))
            ok = ((rise > t[kept[i]]) | (-fall > t[kept[i]])) & ~off[inside].any(1) & (row[inside[:, 0]] == row[inside[:, -1]])
            shift[kept[i[ok]]] = True
    kind[shift], kind[spike], kind[stuck], kind[limit] = SHIFT, SPIKE, STUCK, LIMIT
    return kind


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        s = Flat(b)
        num = lambda c, null: pc.fill_null(s.col[c], null).to_numpy(zero_copy_only=False)
        label = pc.fill_null(s.col["label"], "")
        rests = pc.is_in(label, pa.array(RESTING)).to_numpy(zero_copy_only=False)
        zero = pc.is_in(label, pa.array(RESTING_AT_ZERO)).to_numpy(zero_copy_only=False)
        kind = judge(s, num("phys_lo", -np.inf), num("phys_hi", np.inf), num("step", np.inf), _models(s), rests, zero)
        at = np.flatnonzero((kind != NONE) & s.owned)
        yield pa.RecordBatch.from_arrays([pa.array(s.ids[at]), pa.array(KINDS[kind[at]], pa.string())], ["reading_id", "kind"])


def _median_cells(cells: DataFrame) -> DataFrame:
    """(tail, var_no, what, cell): the cell that holds the median of each kind of number."""
    by = W.partitionBy("tail", "var_no", "what")
    held = cells.where("what >= 0").select("*", F.sum("n").over(by.orderBy("cell")).alias("upto"), F.sum("n").over(by).alias("total"))
    half = F.floor((F.col("total") + 1) / 2)
    return held.where((F.col("upto") >= half) & (F.col("upto") - F.col("n") < half)).select("tail", "var_no", "what", "cell")


def _count(packed: DataFrame, kind: str, fits: DataFrame | None) -> DataFrame:
    """(tail, var_no, what, cell, n) over all of packed; see _counter()."""
    rows = packed.select("tail", "var_no", "own_lo", "own_hi", "items")
    rows = rows if fits is None else lookup_join(rows, fits, ["tail", "var_no"])
    got = rows.mapInArrow(_counter(kind), "tail string, var_no int, what int, cell long, n long")
    return materialize(got.groupBy("tail", "var_no", "what", "cell").agg(F.sum("n").alias("n")))


def fit_sources(packed: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, list[int]]:
    """(tail, var_no, fits), the first pass's cells, and the number of readings that each round but the last found to be outliers.

    Rounds of a robust autoregression of order one: each series has its own location (median); coefficient (from sums
    and differences of neighbours) and scale (absolute residuals) are those of the source: the weighted median over all its
    series of their medians. Outliers are tested and replaced, and both are fitted again on the cleaned series, until a round finds
    nothing new or `rounds` are done. They are kept as histogram cells, good to 1 in 128; fits holds those
    of each round.
    """
    first = _count(packed, "first", None)
    cell = lambda k: F.coalesce(F.max(F.when(F.col("what") == k, F.col("cell"))), F.lit(_NO_KEY))

    def extended(fits: DataFrame, counts: DataFrame, *whats: int) -> DataFrame:
        of = _median_cells(counts).groupBy("tail", "var_no").agg(F.array(*[cell(k) for k in whats]).alias("new"))
        none = F.array(*[F.lit(_NO_KEY)] * len(whats))
        return materialize(fits.join(of, ["tail", "var_no"], "left").select("tail", "var_no", F.concat("fits", F.coalesce("new", none)).alias("fits")))

    fits, found = materialize(_median_cells(first).groupBy("tail", "var_no").agg(F.array(cell(2), cell(3)).alias("fits"))), []
    scale = _count(packed, "scale", fits)
    fits = extended(fits, scale, 4)
    release(scale)
    while len(found) < rounds - 1:
        counts = _count(packed, "again", fits)
        found.append(counts.where("what = -1").agg(F.sum("n")).first()[0] or 0)
        if not found[-1]:
            break
        fits = extended(fits, counts, 2, 3, 4)
        release(counts)
    return fits, first, found


def source_profile(packed: DataFrame) -> DataFrame:
    """(tail, var_no, step, fits): the usual step (exact median of nonzero differences) and the rounds of the autoregression."""
    fits, cells, _ = fit_sources(packed)
    by = W.partitionBy("tail", "var_no")
    ranked = (
        cells.where("what = 1")
        .select("tail", "var_no", "cell", "n", F.sum("n").over(by.orderBy("cell")).alias("upto"), F.sum("n").over(by).alias("total"))
        .select("*", F.floor((F.col("total") + 1) / 2).alias("r1"), (F.floor(F.col("total") / 2) + 1).alias("r2"), (F.col("upto") - F.col("n")).alias("below"))
        .where("(below < r1 and r1 <= upto) or (below < r2 and r2 <= upto)")
    )
    cell_a_b = ranked.groupBy("tail", "var_no").agg(F.min("cell").alias("cell_a"), F.max("cell").alias("cell_b"))
    exact = lookup_join(packed.select("tail", "var_no", "own_lo", "own_hi", "items"), materialize(cell_a_b), ["tail", "var_no"]).mapInArrow(_refine, "tail string, var_no int, cell long, d double")
    counts = exact.groupBy("tail", "var_no", "cell", "d").agg(F.count("*").alias("c"))
    in_cell = W.partitionBy("tail", "var_no", "cell").orderBy("d")
    found = (
        counts.withColumn("hi", F.sum("c").over(in_cell))
        .join(ranked.select("tail", "var_no", "cell", "below", "r1", "r2"), ["tail", "var_no", "cell"])
        .select("tail", "var_no", "d", (F.col("below") + F.col("hi") - F.col("c")).alias("lo"), (F.col("below") + F.col("hi")).alias("hi"), "r1", "r2")
    )
    step = found.groupBy("tail", "var_no").agg(((F.max(F.expr("case when lo < r1 and r1 <= hi then d end")) + F.max(F.expr("case when lo < r2 and r2 <= hi then d end"))) / 2).alias("step"))
    return fits.join(step, ["tail", "var_no"], "left")


def flag_readings(readings: DataFrame, sensors: DataFrame, profile: bool = False) -> DataFrame:
    """(reading_id, kind) with kind limit, stuck, spike or level_shift; one row per flagged reading.

    limit and stuck go before spike and level_shift. A reading without limits (unknown var_no) is never a limit
    violation; a source without any nonzero step has no spikes. Empty tables give an empty result. Other columns of
    either table are not read.
    """
    packed = materialize(pack_series(readings))
    limits = sensors.select(F.coalesce(F.col("var_no").cast("int"), F.lit(-1)).alias("var_no"), "label", "phys_lo", "phys_hi").dropDuplicates(["var_no"])
    of = materialize(source_profile(packed))
    if profile:
        return of.join(limits, "var_no", "left")
    rows = lookup_join(lookup_join(packed, limits, ["var_no"], "left"), of, ["tail", "var_no"], "left")
    return rows.select("var_no", "own_lo", "own_hi", "ids", "items", "label", "phys_lo", "phys_hi", "step", F.coalesce("fits", F.array().cast("array<long>")).alias("fits")).mapInArrow(_flag, "reading_id long, kind string")


def implausible_readings(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """(reading_id): the readings that break a limit, belong to a stuck run or are spikes."""
    return flag_readings(readings, sensors).where("kind <> 'level_shift'").select("reading_id")
