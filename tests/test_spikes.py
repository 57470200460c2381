import datetime as dt

import numpy as np
import pyarrow as pa
import pytest

from skein.operators import spikes as S

SENSORS = [(1, "AOA1", -20.0, 35.0), (17, "PH", 1.0, 7.0), (24, "VIB_1", 0.0, 5.0)]
T0 = dt.datetime(2012, 1, 1)


def brute(series, step, lo, hi, label):
    """Positions flagged, by the definition."""
    n = len(series)
    bad = [not lo <= x <= hi for x in series]
    i = 0
    while i < n:
        j = i
        while j + 1 < n and series[j + 1] == series[i]:
            j += 1
        if j - i + 1 >= 6 and label not in S.RESTING and not (label in S.RESTING_AT_ZERO and series[i] == 0):
            bad[i : j + 1] = [True] * (j - i + 1)
        i = j + 1
    out = {k for k in range(n) if bad[k]}
    if label in S.RESTING:
        return out
    for k in (1, 2, 3):
        for a in range(1, n - k):
            run, ends = series[a : a + k], (series[a - 1], series[a + k])
            if any(bad[a - 1 : a + k + 1]):
                continue
            if min(run) - max(ends) > 15 * step or min(ends) - max(run) > 15 * step:
                out |= set(range(a, a + k))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "reading_id long, flight_no long, tail string, var_no int, label string, ts timestamp, item double, received_at timestamp, step double, ids int")


def tables(spark, series_by_key):
    rows, rid = [], 0
    for (flight, tail, var), xs in series_by_key.items():
        for i, x in enumerate(xs):
            rid += 1
            rows.append((rid, flight, tail, var, None, T0 + dt.timedelta(seconds=6 * i), x, None, 1.0, 1))
    return frame(spark, rows), spark.createDataFrame(SENSORS, "var_no int, label string, phys_lo double, phys_hi double"), rows


@pytest.mark.parametrize("segment", [200_000, 40])
def test_agrees_with_the_definition(spark, monkeypatch, segment):
    monkeypatch.setattr(S, "SEGMENT", segment)
    rng = np.random.default_rng(7)
    data = {}
    for flight in range(6):
        for var in (1, 17, 24):
            x = np.round(np.cumsum(rng.normal(0, 0.05, 300)) + (3 if var != 24 else 1), 3)
            x[rng.integers(0, 300, 12)] += rng.choice([-4, 4, 40], 12)
            at = int(rng.integers(5, 280))
            x[at : at + 8] = x[at]
            data[(flight, f"t{flight % 2}", var)] = [None if v % 0.1 < 0.002 else float(v) for v in x]
    df, sensors, rows = tables(spark, data)
    df = df.union(df.sample(0.1, seed=1))
    got = {r.reading_id for r in S.implausible_readings(df, sensors).collect()}
    steps = {}
    for (f, t, v), xs in data.items():
        y = np.array([x for x in xs if x is not None])
        steps.setdefault((t, v), []).append(np.abs(np.diff(y)))
    want, by = set(), {}
    for r in rows:
        if r[6] is not None:
            by.setdefault((r[1], r[2], r[3]), []).append((r[5], r[0], r[6]))
    limit = {v: (lab, lo, hi) for v, lab, lo, hi in SENSORS}
    for (f, t, v), rs in by.items():
        d = np.concatenate(steps[(t, v)])
        lab, lo, hi = limit[v]
        hit = brute([x for _, _, x in rs], float(np.median(d[d > 0])), lo, hi, lab)
        want |= {rs[k][1] for k in hit}
    assert got == want and len(want) > 50


def test_level_shift_is_no_spike(spark):
    x = [1.0, 1.01] * 10 + [9.0, 9.01] * 10
    df, sensors, _ = tables(spark, {(1, "a", 1): x})
    assert [r.kind for r in S.flag_readings(df, sensors).collect()] == ["level_shift"]


def test_spike_beside_a_shift(spark):
    """A spike just before a change of level is taken out before the level is judged."""
    x = [1.0, 1.01] * 10 + [30.0] + [9.0, 9.01] * 10
    df, sensors, _ = tables(spark, {(1, "a", 1): x})
    assert {(r.reading_id, r.kind) for r in S.flag_readings(df, sensors).collect()} == {(21, "spike"), (22, "level_shift")}


def test_table_edges(spark):
    """Empty tables, nulls and NaN in every column, unknown sensors, one reading, ties in ts."""
    df, sensors, rows = tables(spark, {(1, "a", 1): [1.0, float("nan"), None, 99.0], (None, None, 99): [5.0, 5.5], (2, None, None): [7.0]})
    assert {r.reading_id for r in S.implausible_readings(df, sensors).collect()} == {4}
    assert S.implausible_readings(df.limit(0), sensors).count() == 0
    assert S.implausible_readings(df, sensors.limit(0)).count() == 0
    tied = frame(spark, [(i, 1, "a", 1, None, None if i < 3 else T0, 2.0, None, 0.0, 0) for i in range(1, 8)] + [(None, 1, "a", 1, None, T0, 2.0, None, 0.0, 0)])
    assert {r.reading_id for r in S.implausible_readings(tied, sensors).collect()} == set(range(1, 8))


def packed_rows(series):
    """A batch of packed rows, as one Flat."""
    n = np.cumsum([0] + [len(x) for x in series])
    flat = np.concatenate(series)
    k = len(series)
    cols = [pa.array([1] * k, pa.int32()), pa.array([0] * k, pa.int32()), pa.array(np.diff(n), pa.int32()), pa.array(np.zeros(k, int)), S._lists(np.arange(len(flat)), n, pa.int64()), S._lists(flat, n, pa.float64())]
    return S.Flat(pa.RecordBatch.from_arrays(cols, ["var_no", "own_lo", "own_hi", "flight_no", "ids", "items"]))


def test_the_model_decides_what_is_nominated():
    """Nominations and results change with a wrong scale or coefficient; a good model misses no spike of the rule."""
    r = np.random.default_rng(3)
    x = [np.cumsum(r.normal(0, 1, 2000)) for _ in range(4)]
    for v in x:
        v[r.integers(5, 1990, 40)] += r.choice([-25, 25], 40)
    s = packed_rows(x)
    step = np.median(np.concatenate([np.abs(np.diff(v)) for v in x]))
    model = lambda phi, scale: S.Model(S._medians(s.x, np.isfinite(s.x), s)[0], *(np.full(4, z) for z in ((1 + phi) ** 0.5, (1 - phi) ** 0.5, scale / 1.4826)))
    named = lambda m: {(k, int(j)) for i, k, _, _ in S.nominated(s.x, s, m, s.inner) for j in i}
    n = len(x)
    kinds = lambda m: S.judge(s, np.full(n, -np.inf), np.full(n, np.inf), np.full(n, step), [m], np.zeros(n, bool), np.zeros(n, bool))
    good = model(0.995, 1.0)
    want = {k for v, at in zip(x, s.offs) for k in (int(at) + j for j in brute(list(v), step, -np.inf, np.inf, ""))}
    assert set(np.flatnonzero(kinds(good) == S.SPIKE).tolist()) == want and len(want) > 100
    assert len(named(good)) < 0.1 * 3 * len(s.x)
    for wrong in (model(-0.9, 1.0), model(0.995, 20.0), model(0.995, 0.05)):
        assert abs(len(named(wrong)) - len(named(good))) > 0.3 * len(named(good))
    assert (kinds(model(0.995, 20.0)) == S.SPIKE).sum() < 0.5 * len(want)
    assert not (kinds(model(0.995, np.nan)) == S.SPIKE).any()


def test_rounds_fit_the_source(spark):
    """Coefficient and scale of a known autoregression over flights of different level; later rounds find what is left."""
    r = np.random.default_rng(5)
    data = {}
    for flight in range(8):
        x, e = np.zeros(1500), r.normal(0, 0.1, 1500)
        for i in range(1, 1500):
            x[i] = 0.8 * x[i - 1] + e[i]
        x[r.integers(5, 1490, 10)] += 3.0
        data[(flight, "a", 1)] = [float(v) for v in x + flight]
    df, _, _ = tables(spark, data)
    fits, _, found = S.fit_sources(S.materialize(S.pack_series(df)), rounds=4)
    cells = np.array(fits.first().fits)
    p, m, e = S._middle(cells[-3:])
    last = S.Model(np.zeros(1), p, m, e)
    assert abs(last.phi - 0.8) < 0.05 and abs(last.scale - 0.1) < 0.01
    assert 75 <= found[0] <= 400 and found[1] < found[0] / 5
