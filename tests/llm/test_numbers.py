import datetime as dt
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import clusters, graph_index, neardup, neighbours, quantiles

T0 = dt.datetime(2012, 1, 1)


# percentiles
def test_ranks_and_merging():
    r = np.random.default_rng(1)
    for n in (1, 2, 50, 5000, 200_000):
        x = np.round(r.gamma(2, 90, n), 3)
        lo, hi = np.zeros(n), np.full(n, 950.0)
        code = quantiles.encode(x, lo, hi)
        half = n // 2
        a, b = (quantiles.build(c, np.zeros(len(c), int), 1)[0] for c in (code[:half], code[half:]))
        whole = quantiles.build(code, np.zeros(n, int), 1)[0]
        assert (a + b == whole).all()
        assert (quantiles.from_bytes(quantiles.to_bytes(whole)) == whole).all()
        got = quantiles.decode(quantiles.quantile_codes(whole[None], np.array([n]), quantiles.QUANTILES)[0].astype(float), 0.0, 950.0)
        cell = 950 * 1.1 / 65536
        for v, q in zip(got, quantiles.QUANTILES):
            below, upto = (x < v - cell).sum(), (x <= v + cell).sum()
            assert below <= q * (n - 1) + 0.02 * n + 1 and upto >= q * (n - 1) + 1 - 0.02 * n - 1


def test_deletions_undo_additions():
    code = np.arange(0, 60000, 7)
    w = np.ones(len(code))
    full = quantiles.build(code, np.zeros(len(code), int), 1)
    gone = quantiles.build(code[::2], np.zeros(len(code[::2]), int), 1, -w[::2])
    assert (full + gone == quantiles.build(code[1::2], np.zeros(len(code[1::2]), int), 1)).all()


SENSORS = [(1, "A", 0.0, 10.0), (2, "B", 0.0, 10.0), (3, "C", 1.0, 1.0)]


def readings(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], "reading_id long, var_no int, ts timestamp, item double, label string, n int, sketch binary")


def test_percentile_edges(spark):
    """Copies count once; null, NaN and unusable rows do not; values beyond the range; empty tables; hot days in parts."""
    sensors = spark.createDataFrame(SENSORS, "var_no int, label string, phys_lo double, phys_hi double")
    rows = [(i, 1, T0, float(i % 10)) for i in range(200)] * 2 + [(900, 2, T0, 1e9), (901, 2, T0, float("nan")), (902, 2, T0, None), (903, None, T0, 1.0), (904, 2, None, 1.0), (None, 2, T0, 1.0), (905, 3, T0, 1.0), (906, 77, T0, 1.0), (907, 2, T0, float("-inf"))]
    df = readings(spark, rows)
    got = {r.label: r for r in quantiles.percentiles(df, sensors).collect()}
    assert set(got) == {"A", "B"} and got["A"].n == 200 and got["B"].n == 2
    assert abs(got["A"].p50 - 4.5) <= 0.6 and abs(got["B"].p95 - 10.5) < 1 or got["B"].p05 < 0
    parts = quantiles.answers(quantiles.merge(quantiles.daily_sketches(df, sensors), ["var_no", "day"]), sensors, quantiles.QUANTILES, ["var_no", "day"])
    assert {r.label: (r.n, r.p50) for r in parts.collect()} == {k: (r.n, r.p50) for k, r in got.items()}
    assert quantiles.percentiles(df.limit(0), sensors).count() == 0 and quantiles.percentiles(df, sensors.limit(0)).count() == 0


def test_days_add_up(spark):
    sensors = spark.createDataFrame(SENSORS, "var_no int, label string, phys_lo double, phys_hi double")
    r = np.random.default_rng(2)
    df = readings(spark, [(i, 1, T0 + dt.timedelta(days=i % 5), float(x)) for i, x in enumerate(r.uniform(0, 10, 3000))])
    one = quantiles.percentiles(df, sensors, per_day=False).first()
    assert one.n == 3000 and abs(one.p25 - 2.5) < 0.5 and abs(one.p75 - 7.5) < 0.5


def test_codes_beyond_the_range():
    """Every double has a cell, in order, and its middle is as near as stated."""
    r = np.random.default_rng(4)
    x = np.sort(np.concatenate([s * 10.0 ** r.uniform(-4, 308, 4000) for s in (1, -1)] + [r.uniform(-400, 1400, 4000), [np.inf, -np.inf, np.finfo(float).max, 997.5, -47.5, np.nextafter(997.5, 2e3)]]))
    lo, hi = np.zeros(len(x)), np.full(len(x), 950.0)
    code = quantiles.encode(x, lo, hi)
    back = quantiles.decode(code, lo, hi)
    ok = np.isfinite(x)
    assert (np.diff(code) >= 0).all() and (back[~ok] == x[~ok]).all()
    off = np.maximum(950 * 1.1 / 65536, np.maximum(x - 997.5, -47.5 - x) * 2.0**-11 * 1.001)
    assert (np.abs(back[ok] - x[ok]) <= off[ok]).all()
    w = np.ones(len(x), int)
    full, gone = (quantiles.tails_of(c, np.zeros(len(c), int), 1, v)[0] for c, v in ((code, w), (code[::2], -w[::2])))
    left = quantiles.tails_of(code[1::2], np.zeros(len(code[1::2]), int), 1)[0]
    assert all((a == b).all() for a, b in zip(quantiles.add_tails(full, gone), left))
    assert all((a == b).all() for a, b in zip(quantiles.tails_from_bytes(quantiles.tails_to_bytes(full)), full))


def test_percentiles_beyond_the_range(spark, monkeypatch):
    """Days with a tenth of the readings far out on either side, and wholly out; the check counts readings as they are."""
    sensors = spark.createDataFrame(SENSORS, "var_no int, label string, phys_lo double, phys_hi double")
    r = np.random.default_rng(3)
    x = [r.uniform(0, 10, 400), r.uniform(500, 900, 300), -(10.0 ** r.uniform(2, 9, 300))]
    x[0][:40], x[0][40:80] = r.uniform(-1700, -1600, 40), r.uniform(4200, 4300, 40)
    rows = [(1000 * k + i, 1, T0 + dt.timedelta(days=k), float(z)) for k, day in enumerate(x) for i, z in enumerate(day)]
    df = readings(spark, rows)
    for rows in (50, 10**6):
        monkeypatch.setattr(quantiles, "SLICE_ROWS", rows)
        found = quantiles.answers(quantiles.merge(quantiles.daily_sketches(df, sensors), ["var_no", "day"]), sensors, quantiles.QUANTILES, ["var_no", "day"])
        got = {row.day: row for row in found.collect()}
        for k, day in enumerate(x):
            one, v = got[(T0 + dt.timedelta(days=k)).date()], np.sort(day)
            for q in quantiles.QUANTILES:
                near = v[max(0, int(q * len(v) - 0.02 * len(v)) - 2) : int(q * len(v) + 0.02 * len(v)) + 3]
                p = one[f"p{round(q * 100):02d}"]
                assert near[0] - abs(near[0]) * 0.001 <= p + 0.01 and p - 0.01 <= near[-1] + abs(near[-1]) * 0.001
    assert all(row.bounded for row in quantiles.within_bounds(df, sensors, quantiles.percentiles(df, sensors)).collect())
    ends = quantiles.percentiles(df, sensors).withColumn("p05", F.greatest("p05", F.lit(-0.5)))
    assert not any(row.bounded for row in quantiles.within_bounds(df, sensors, ends).where("label = 'A' and day in ('2012-01-01', '2012-01-03')").collect())


def test_many_sparse_keys_take_bounded_memory():
    """20,000 sensor days of one reading each: sketches are held a few hundred at a time."""
    n = 20_000
    cols = [np.arange(n, dtype=np.int32) % 28, (np.arange(n) // 28).astype("datetime64[D]"), np.linspace(0, 900, n), np.ones(n), np.zeros(n), np.full(n, 950.0)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], list("vdxwlh"))
    tracemalloc.start()
    rows = sum(b.num_rows for b in quantiles._partials(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and most < 500e6


def test_exact_and_corrected_percentiles(spark):
    """Brackets from the sketches hold the exact values; deleted readings leave the sketch of the rest; repeats count once."""
    sensors = spark.createDataFrame(SENSORS, "var_no int, label string, phys_lo double, phys_hi double")
    r = np.random.default_rng(8)
    x = np.concatenate((np.round(r.normal(5, 2, 4000), 2), r.uniform(50, 90, 600)))
    rows = [(i, 1, T0 + dt.timedelta(days=i % 3), float(z)) for i, z in enumerate(x)]
    df = readings(spark, rows + rows[::5] + rows[::50])
    got = {z.q: z.value for z in quantiles.exact_percentiles(df, sensors).collect()}
    v = np.sort(x)
    assert got == {q: v[int(q * (len(v) - 1) + 1e-9)] for q in quantiles.QUANTILES}
    days = {(z.day, z.q): z.value for z in quantiles.exact_percentiles(df, sensors, per_day=True).collect()}
    one = np.sort(x[1::3])
    assert days[(T0 + dt.timedelta(days=1)).date(), 0.5] == one[int(0.5 * (len(one) - 1))] and len(days) == 15
    left = quantiles.merge(quantiles.without(quantiles.daily_sketches(df, sensors), df.where("item > 40"), sensors), ["var_no"]).first()
    want = quantiles.merge(quantiles.daily_sketches(df.where("item <= 40"), sensors), ["var_no"]).first()
    assert left.n == want.n == 4000 and (quantiles.from_bytes(left.sketch) == quantiles.from_bytes(want.sketch)).all() and left.tails == want.tails


# near-duplicates
def text_records(seed=1, n=60):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        base = [f"{r.uniform(0, 100):.2f}" for _ in range(r.randrange(30, 80))]
        out.append(base)
        for _ in range(r.randrange(4)):
            c = list(base)
            for _ in range(r.randrange(4)):
                k = r.randrange(len(c))
                op = r.randrange(4)
                if op == 0:
                    c[k] = f"{r.uniform(0, 100):.2f}"
                elif op == 1:
                    del c[k]
                elif op == 2:
                    c.insert(k, "7.77")
                else:
                    c[k] = f"{float(c[k]):.4e}"
            out.append(c)
    return [(i, r.choice([" ", "  ", "\t"]).join(c)) for i, c in enumerate(out)]


def brute_pairs(rows, s=0.6):
    sets = {}
    for i, t in rows:
        v = [float(x) for x in (t or "").split()]
        sets[i] = {tuple(v[k : k + 3]) for k in range(len(v) - 2)}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= s * len(sets[a] | sets[b])}


def records(spark, rows):
    return spark.createDataFrame([(i, t, 1, [2]) for i, t in rows], "rec_id long, raw_vals string, n int, runs array<int>")


@pytest.mark.parametrize("crowd", [400, 1])
def test_pairs_agree_with_all_sets(spark, crowd):
    """Also when every shared anchor counts as crowded, so that all pairs come the exact way."""
    rows = text_records()
    got = [tuple(r) for r in neardup.similar_pairs(records(spark, rows), crowd=crowd).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)


def test_common_header_and_copies(spark):
    """A run that stands in a third of all records, and a text that is a third of all records."""
    r = random.Random(3)
    head = "0 0 0 0 1 2 3 4 5 6"
    rows = [(i, head + " " + " ".join(f"{r.random():.3f}" for _ in range(40))) for i in range(60)] + [(100 + i, head + " 9 8 7 6.0") for i in range(40)] + [(200, head + " 9 8 7 6 5")]
    got = {tuple(x) for x in neardup.similar_pairs(records(spark, rows), crowd=8).collect()}
    assert got == brute_pairs(rows)
    groups = {x.rec_id: x for x in neardup.similar_groups(records(spark, rows), crowd=8).collect()}
    assert len(groups) == len(rows) and groups[120].class_id == 100 and groups[120].n_links == 40 and groups[200].group_id == 100 and groups[5].n_links == 0


def test_hot_keys_are_parted(spark, monkeypatch):
    """A class of copies and a run shared by all, in parts of seven members: the pairs are the same."""
    r = random.Random(9)
    shared = " ".join(f"{r.random():.3f}" for _ in range(30))
    rows = [(i, shared) for i in range(0, 60, 2)] + [(i, shared + f" {i}.5 {i}.25") for i in range(1, 40, 2)] + [(100 + i, text) for i, (_, text) in enumerate(text_records(n=10))]
    whole = {tuple(x) for x in neardup.similar_pairs(records(spark, rows)).collect()}
    monkeypatch.setattr(neardup._in_parts, "__defaults__", (7,))
    monkeypatch.setattr(neardup, "PART", 7)
    for crowd in (400, 3):
        got = [tuple(x) for x in neardup.similar_pairs(records(spark, rows), crowd=crowd).collect()]
        assert len(got) == len(set(got)) and set(got) == whole == brute_pairs(rows)


def test_an_anchor_over_several_batches():
    """Candidates and crowded anchors do not depend on how rows are batched."""
    r = np.random.default_rng(2)
    anchor = np.sort(np.concatenate((r.integers(-50, 50, 400), np.full(60, 7))))
    rec = np.arange(len(anchor)) % 97
    order = np.lexsort((rec, anchor))
    cols = [anchor[order], rec[order], np.full(len(anchor), 9, np.int32), r.integers(0, 2**62, len(anchor)) * 0, np.zeros(len(anchor), np.int64)]
    t = pa.table([pa.array(c) for c in cols], ["anchor", "rec_id", "n", "sketch_a", "sketch_b"])
    want = None
    for rows in (1000, 64, 11, 3, 1):
        got = {(x["a"], x["b"]) for b in neardup._meet(0.6, 20)(iter(t.to_batches(rows))) for x in b.to_pylist()}
        want = want or got
        assert got == want
    crowded = {a for a, b in want if b is None}
    assert crowded == set(rec[order][np.isin(cols[0], [x for x, n in zip(*np.unique(anchor, return_counts=True)) if n > 20])].tolist())


def test_record_edges(spark):
    """Null, empty, short and very long texts, odd words, repeated ids, and an empty table."""
    long = " ".join(str(i % 1000) for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "1 2"), (4, "1 2 3"), (5, " 1.0 2e0\t+3 "), (6, long), (7, long + " 1"), (8, "a b nan"), (9, "A b nan"), (4, "1 2 3"), (None, "1 2 3"), (10, "-0 0 0.0"), (11, "0 -0.0 0")]
    got = {tuple(x) for x in neardup.similar_pairs(records(spark, rows)).collect()}
    assert got == {(4, 5), (6, 7), (8, 9), (10, 11)}
    assert neardup.similar_pairs(records(spark, [])).count() == 0 and neardup.similar_groups(records(spark, [])).count() == 0


# nearest neighbours
def families(seed, n, dim=64, spread=0.2):
    r = np.random.default_rng(seed)
    base = r.normal(0, 1.4, (max(1, n // 12), dim))
    return base[r.integers(0, len(base), n)] + r.normal(0, spread, (n, dim))


def test_graph_recall_and_flat_form():
    v = families(1, 3000)
    g = graph_index.Graph.build(v)
    rows, _ = g.search(v[:500], 6)
    d = (v[:500] ** 2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * v[:500] @ v.T
    true = np.argsort(d, axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(rows, true)]) > 0.98
    again, _ = graph_index.Graph.from_flat(v, *g.flat()).search(v[:500], 6)
    assert (again == rows).all()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "item long, vals array<double>, id string, d double")


def brute_near(rows, k):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows])
    out = {}
    for i, x in rows:
        d = np.sqrt(((v - np.array(x)) ** 2).sum(1))
        o = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[i] = [int(ids[j]) for j in o]
    return out


@pytest.mark.parametrize("shard_rows", [8000, 150])
def test_neighbours_of_every_item(spark, shard_rows):
    """In one shard and in many; copies are told apart by item, nearest first."""
    v = families(4, 900)
    rows = [(int(i) * 3, [float(z) for z in x]) for i, x in enumerate(v)] + [(5000 + i, [float(z) for z in v[7]]) for i in range(9)]
    want = brute_near(rows, 5)
    got = {}
    for r in neighbours.nearest(vectors(spark, rows), shard_rows=shard_rows).orderBy("item", "rank").collect():
        got.setdefault(r["item"], []).append(r.neighbour)
    assert set(got) == set(want)
    hits = sum(len(set(got[i]) & set(want[i])) for i in want) / (5 * len(want))
    assert hits > 0.99 and got[5003] == want[5003] == [21, 5000, 5001, 5002, 5004]


def test_vector_edges(spark):
    """Unusable vectors, repeated items, fewer than five others, and an empty table."""
    one = [1.0] * 64
    rows = [(1, one), (1, one), (2, [0.0] * 64), (3, None), (4, [1.0] * 63), (5, [*one[:-1], float("nan")]), (6, [*one[:-1], None]), (None, one), (7, [*one[:-1], float("inf")])]
    assert {tuple(r) for r in neighbours.nearest_pairs(vectors(spark, rows)).collect()} == {(1, 2)}
    assert neighbours.nearest(vectors(spark, [])).count() == 0


# clusters
def mats(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "mat_id long, mat array<double>, size int, cluster_id string")


def brute_sets(rows, s=0.85):
    ids = [i for i, _ in rows]
    v = np.array([x for _, x in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    like = v @ v.T >= s
    out = set()
    for k in range(len(ids)):
        m = frozenset(np.flatnonzero(like[k]).tolist())
        if len(m) > 1 and all(frozenset(np.flatnonzero(like[j]).tolist()) == m for j in m):
            out |= {(ids[j], min(ids[x] for x in m)) for j in m}
    return out


def matrix_rows(seed, n, groups, noise):
    r = np.random.default_rng(seed)
    base = r.uniform(0, 1, (groups, 378)) * (r.random((groups, 378)) < 0.4)
    return [(i + 1, [float(z) for z in np.abs(base[g] + r.normal(0, noise, 378) * (base[g] > 0))]) for i, g in enumerate(r.integers(0, groups, n))]


@pytest.mark.parametrize("bucket", [1000, 20])
def test_sets_of_alike_matrices(spark, bucket):
    """Also with buckets parted, and with chains that are alike in part only."""
    rows = matrix_rows(5, 220, 30, 0.08)
    r = np.random.default_rng(6)
    a = np.array(rows[0][1])
    b = np.where(r.random(378) < 0.25, r.random(378), a)  # between two groups: links what is not all alike
    rows += [(900, [float(z) for z in b])]
    got = {tuple(x) for x in clusters.alike_sets(mats(spark, rows), bucket=bucket).collect()}
    assert got == brute_sets(rows) and got
    copies = rows + [(2000 + i, rows[3][1]) for i in range(50)] + [(3000 + i, [float(k == 5) for k in range(378)]) for i in range(4)]
    assert {tuple(x) for x in clusters.alike_sets(mats(spark, copies), bucket=bucket).collect()} == brute_sets(copies)
    blocks = {tuple(x) for x in clusters.alike_sets(mats(spark, rows), rows=3).collect()}
    assert blocks == got


def beside_a_cluster(seed, hot, pairs):
    """Unit vectors: one cluster of all alike, and lone pairs at cosine 0.86 that lean towards it."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(r.normal(size=(1, 378)))
    off = r.normal(size=(2, pairs, 378))
    off -= (off @ base.T) * base
    one = 0.77 * base + np.sqrt(1 - 0.77**2) * unit(off[0])
    cross = unit(off[1] - (off[1] * one).sum(1, keepdims=True) * one)
    two = 0.86 * one + np.sqrt(1 - 0.86**2) * cross
    v = np.concatenate((unit(base + 0.015 * r.normal(size=(hot, 378))), one, two))
    return [(i + 1, [float(z) for z in x]) for i, x in enumerate(v)]


def test_no_pair_is_missed_beside_a_cluster(spark):
    """Lone pairs near the threshold, of which tables of sign bits lose a part."""
    rows = beside_a_cluster(11, 200, 150)
    want = brute_sets(rows)
    assert len(want) > 400
    for bucket in (4000, 90):
        assert {tuple(x) for x in clusters.alike_sets(mats(spark, rows), bucket=bucket).collect()} == want


def test_forest_of_a_large_cluster_is_exact(spark):
    """Links and core distances of a cluster of several blocks, against all pairs."""
    rows = beside_a_cluster(12, 300, 40)
    v = np.array([x for _, x in rows])
    w = 1 - (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    np.fill_diagonal(w, np.inf)
    core = np.sort(w, axis=1)[:, 1]
    core = np.where(core <= 0.4, core, 0.4)
    reach = np.where(w <= 0.4, np.maximum(w, np.maximum(core[:, None], core[None])), np.inf)
    a, b = clusters._tree(reach)
    want = np.sort(reach[a, b][np.isfinite(reach[a, b])])
    for bucket in (4000, 60):
        _, _, tree = clusters.forest_of(mats(spark, rows), "mat_id", "mat", 378, 3, bucket=bucket)
        got = np.sort([x.w for x in tree.collect()])
        assert len(got) == len(want) and np.abs(got - want).max() < 1e-5


def test_density_clusters_find_the_groups(spark):
    rows = matrix_rows(7, 160, 12, 0.05)
    r = np.random.default_rng(7)
    r.uniform(0, 1, (12, 378)), r.random((12, 378))
    truth = brute_sets(rows)
    got = clusters.density_clusters(mats(spark, rows), min_cluster=4).collect()
    label = {x.mat_id: x.cluster_id for x in got}
    where = dict(truth)
    # a density cluster never mixes groups
    for c in set(label.values()):
        assert len({where.get(i) for i in label if label[i] == c}) == 1
    assert all(1 <= x.exemplar_rank <= 3 for x in got if x.exemplar_rank) and len(label) > 100
    sizes = {}
    for x in got:
        sizes.setdefault(x.cluster_id, []).append(x)
    assert all(len(v) == v[0]["size"] and {y.exemplar_rank for y in v if y.exemplar_rank} == {1, 2, 3} for v in sizes.values())


def test_spanning_forest(spark):
    r = np.random.default_rng(3)
    edges = {(int(max(a, b)), int(min(a, b))): float(np.round(r.random(), 1)) for a, b in r.integers(0, 60, (150, 2)) if a != b}
    got = clusters.boruvka(spark.createDataFrame([(u, v, w) for (u, v), w in edges.items()], "u long, v long, w double")).collect()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    total = n = 0
    for (u, v), w in sorted(edges.items(), key=lambda e: e[1]):
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
            total, n = total + w, n + 1
    assert len(got) == n and abs(sum(x.w for x in got) - total) < 1e-9
    assert all(find(x.u) == x.comp for x in got)


def test_matrix_edges(spark):
    """Null, all-zero and unusable vectors, repeated ids, a lone record, and an empty table."""
    a = [float(i % 5) for i in range(378)]
    rows = [(1, a), (2, [2 * x for x in a]), (2, [2 * x for x in a]), (3, None), (4, [0.0] * 378), (5, a[:-1]), (6, [*a[:-1], float("nan")]), (7, [*a[:-1], None]), (8, [float(i % 7 == 0) for i in range(378)]), (None, a), (9, [1e300 * x for x in a])]
    assert {tuple(x) for x in clusters.alike_sets(mats(spark, rows)).collect()} == {(1, 1), (2, 1), (9, 1)}
    assert clusters.alike_sets(mats(spark, [])).count() == 0 and clusters.density_clusters(mats(spark, [])).count() == 0
