import itertools
import random

import pandas as pd
import pytest

from skein.config import BREAKPOINTS, ClipConfig, SaxConfig, ShingleConfig
from skein.functions import batched, encode, families, hashing, similarity
from skein.operators import network, stats
from skein.sources import series as src
from skein.sources import sinks
from skein.streaming import pairs

TOY = ["1.1 2.2 -3.3 -4.4 -5.5 -6.6 -7.7 8.88 9.0 10", "-1.1 -2.2 -3.3 -4.4 5.5 6.6 7.7 8.88 9.0 10", "1.1 2.2 -3.3 -4.4 -5.5 -6.6 -7.7 8.88 9.0 10"]


@pytest.fixture(scope="module")
def toy(spark):
    return src.parse_series(spark.createDataFrame(list(enumerate(TOY, 1)), "id long, t string"), "id", "t")


def codes_of(df):
    return {(r.item, r.table_id): r.code for r in df.collect()}


def test_clip_golden(toy):
    cfg = ClipConfig(6, 2.0, [0, 1, 3], 3, 0.1)
    enc = toy.select("item", encode.clip("vals", cfg).alias("enc"))
    got = {r.item: r.enc for r in enc.collect()}
    assert got[1] == [0, 1, 0, 0, 0, 0] and got[2] == [0, 0, 0, 0, 1, 1] and got[3] == got[1]
    codes = hashing.substring_codes(enc, cfg.offsets, cfg.code_len)
    assert codes_of(codes) == {(1, 1): 10, (1, 2): 100, (1, 3): 0, (2, 1): 0, (2, 2): 0, (2, 3): 11, (3, 1): 10, (3, 2): 100, (3, 3): 0}
    sims = network.verify(network.candidate_pairs(codes), enc, lambda a, b: similarity.run_length(a, b, 0.1)).collect()
    assert [(r.id1, r.id2, round(r.sim, 6)) for r in sims] == [(1, 3, 7.71561)]


def test_sax_golden(toy):
    cfg = SaxConfig(9, 4.5, 0.1, 2, 3, [0, 1, 2], 2)
    enc = toy.select("item", encode.sax("vals", cfg).alias("enc"))
    got = {r.item: r.enc for r in enc.collect()}
    assert got == {1: [0, 0, 0, 0], 2: [0, 0, 2, 2], 3: [0, 0, 0, 0]}
    assert codes_of(hashing.substring_codes(enc, cfg.offsets, cfg.code_len)) == {(1, 1): 0, (1, 2): 0, (1, 3): 0, (2, 1): 0, (2, 2): 2, (2, 3): 22, (3, 1): 0, (3, 2): 0, (3, 3): 0}
    sims = network.verify(network.candidate_pairs(hashing.substring_codes(enc, cfg.offsets, cfg.code_len)), enc, lambda a, b: similarity.mindist(a, b, cfg))
    assert {(r.id1, r.id2): round(r.sim, 6) for r in sims.collect()} == {(1, 2): 1.72, (1, 3): 0.0, (2, 3): 1.72}
    exact = SaxConfig(9, 4.5, 0.1, 2, 3, [0, 1, 2], 2, exact_ratio=True)
    one = enc.alias("a").join(enc.alias("b"), on=None, how="cross").where("a.item = 1 and b.item = 2").select(similarity.mindist("a.enc", "b.enc", exact).alias("d")).first()
    assert round(one.d, 3) == 1.824


def test_shingles_of_equal_series_agree(toy):
    cfg = ShingleConfig(9, families.projection(3, 1), 1, 2, 1, families.draws(5, 2, 1))
    sets = toy.select("item", encode.shingles(encode.sketch("vals", cfg), cfg).alias("grams"))
    counted = sets.select("item", encode.shingle_counts("grams", cfg).alias("counts"))
    assert all(sum(r["counts"]) == cfg.shingles for r in counted.collect())
    codes = codes_of(hashing.draw_codes(counted, cfg))
    assert all(codes.get((1, t)) == codes.get((3, t)) for t in range(1, 6))
    enc = sets.select("item", "grams")
    sims = {(r.id1, r.id2): r.sim for r in network.verify(network.candidate_pairs(hashing.draw_codes(counted, cfg)), enc, similarity.jaccard, "grams").collect()}
    assert not sims or sims.get((1, 3), 1.0) == 1.0


def test_batched_shingles_are_those_of_the_expressions(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5]) * r.random() for _ in range(20)]) for i in range(50)] + [(90, [1.0] * 19), (91, None), (92, [None] * 20), (93, [0.0] * 25)]
    series = spark.createDataFrame(rows, "item long, vals array<double>")
    cfg = ShingleConfig(20, [0.5, -0.25, -0.25], 2, 3, 2, families.draws(4, 3, 7))
    got = batched.shingle_encoding(series, cfg)
    use = series.where("size(vals) >= 20 and item <> 92")
    grams = use.select("item", encode.shingles(encode.sketch("vals", cfg), cfg).alias("grams"))
    assert {x.item: x.enc for x in got.collect()} == {x.item: sorted(set(x.grams)) for x in grams.collect()}
    codes = hashing.draw_codes(grams.select("item", encode.shingle_counts("grams", cfg).alias("counts")), cfg)
    assert {(x.item, t): c for x in got.collect() for t, c in enumerate(x.codes, 1) if c is not None} == codes_of(codes)
    assert batched.shingle_encoding(series.limit(0), cfg).count() == 0


def test_every_bucket_gives_all_its_pairs(spark):
    """Several buckets in one table, hot ones among them: no bucket loses pairs."""
    rows = [(i, 1, i % 3) for i in range(60)] + [(i, 2, 0) for i in range(9)]
    codes = spark.createDataFrame(rows, "item long, table_id int, code long")
    want = {(t, c, a, b) for (t, c) in {(r[1], r[2]) for r in rows} for a, b in itertools.combinations(sorted(r[0] for r in rows if r[1:] == (t, c)), 2)}
    for hot in (1000, 4):
        got = [tuple(r) for r in network.candidate_pairs(codes, hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_run_length_at_growth_zero(spark):
    df = spark.createDataFrame([([0, 1, 1, 0], [0, 1, 0, 0])], "a array<int>, b array<int>")
    r = df.select(similarity.run_length("a", "b", 0.0).alias("x"), similarity.run_length("a", "b", 1.0).alias("y")).first()
    assert (r.x, r.y) == (3.0, 4.0)


def test_normalized_matrix(spark):
    one = network.normalized(spark.createDataFrame([(1, 3, 7.715611)], "id1 int, id2 int, sim double")).first()
    assert round(one.value, 7) == 0.9998704
    rows = [(1, 2, 0.5), (2, 3, 0.5), (1, 3, 1.0)]
    got = {(r.id1, r.id2): round(r.value, 7) for r in network.normalized(spark.createDataFrame(rows, "id1 int, id2 int, sim double")).collect()}
    assert got == {(1, 2): 0.4995005, (2, 3): 0.4995005, (1, 3): 0.9990010}
    cells = network.matrix(spark.createDataFrame(rows[:1], "id1 long, id2 long, sim double"), spark.createDataFrame([(1,), (2,), (3,)], "item long"))
    assert {(r.i, r.j): r.value for r in cells.collect()} == {(1, 1): 1.0, (2, 2): 1.0, (3, 3): 1.0, (1, 2): 0.5, (1, 3): None, (2, 3): None}


@pytest.mark.parametrize("bad", [dict(alphabet=2), dict(alphabet=11), dict(segment=0), dict(sd=0.0), dict(code_len=19), dict(offsets=[9])])
def test_sax_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        SaxConfig(**(dict(elements=20, mean=0.0, sd=1.0, segment=2, alphabet=4, offsets=[0], code_len=3) | bad))


def test_other_parameters_are_checked():
    with pytest.raises(ValueError):
        ClipConfig(6, 0.0, [4], 3)
    with pytest.raises(ValueError):
        families.offsets(9, 10, 3, 1)
    with pytest.raises(ValueError):
        ShingleConfig(9, [1.0] * 3, 1, 2, 0, [[0.5]])
    assert families.offsets(4, 30, 5, 3) == families.offsets(4, 30, 5, 3) and families.projection(4, 1) != families.projection(4, 2)
    assert len(families.draws(3, 4, 1)[0]) == 8 and sorted(BREAKPOINTS) == list(range(3, 11))


def test_series_lines(spark):
    rows = [(1, "1 2\t3"), (2, "1 x 3"), (3, None), (4, ""), (5, "nan 2"), (6, " 1e1  2 ")]
    df = spark.createDataFrame(rows, "id long, t string")
    assert {r.item: r.vals for r in src.parse_series(df, "id", "t").collect()} == {1: [1.0, 2.0, 3.0], 2: [1.0], 4: [], 5: [], 6: [10.0, 2.0]}
    assert {r.item: r.vals for r in src.parse_series(df, "id", "t", 1, 1).collect()} == {1: [2.0], 6: [2.0]}


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("\n".join(TOY) + "\n")
    assert [r.item for r in src.read_series_text(spark, str(tmp_path / "t.txt")).orderBy("item").collect()] == [1, 2, 3]
    (tmp_path / "u.txt").write_text("".join(f"{i} {i + 1}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # many splits of a file
    try:
        many = src.read_series_text(spark, str(tmp_path / "?.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {(r.file.rsplit("/", 1)[1], r.item): r.vals for r in many}
    assert len(many) == len(got) == 3003 and {i for f, i in got if f == "t.txt"} == {1, 2, 3}
    assert all(got["u.txt", i + 1] == [float(i), float(i + 1)] for i in range(3000))
    (tmp_path / "f1.evt").write_text("TS,A,B\n1,2,3\n2,4,6\n")
    wide = src.read_flights(spark, str(tmp_path / "*.evt"), ["TS", "A", "B"])
    long = stats.unpivot(wide, ["flight", "TS"], ["A", "B"]).withColumnRenamed("TS", "ts")
    assert {(r.flight, r.variable): r.vals for r in stats.transpose(long, ["ts"]).collect()} == {("f1.evt", "A"): [2.0, 4.0], ("f1.evt", "B"): [3.0, 6.0]}
    sinks.write_series(stats.transpose(long, ["ts"]), str(tmp_path / "out"), "raw")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    sinks.write_variables(long, str(tmp_path / "vars"))
    assert {(r.variable, r.value) for r in spark.read.parquet(str(tmp_path / "vars")).collect()} == {("A", 2.0), ("A", 4.0), ("B", 3.0), ("B", 6.0)}
    sinks.write_series_text(stats.transpose(long, ["ts"]), str(tmp_path / "txt"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "txt")).collect()) == ["2.0 4.0", "3.0 6.0"]
    codes = spark.createDataFrame([(1, 1, 5), (2, 1, 5)], "item long, table_id int, code long")
    lines = network.report_lines(spark.createDataFrame([(1, 2, 0.5)], "id1 long, id2 long, sim double"), network.buckets(codes), 3)
    sinks.write_report(lines, str(tmp_path / "rep"))
    back = src.read_report(spark, str(tmp_path / "rep"))
    assert sorted(r.line for r in back.collect()) == ["bucket 1 5 1 2", "hash code size is 3", "sim 1 2 0.500000"]
    assert [tuple(r) for r in network.parse_report(back).collect()] == [(1, 2, 0.5)]
    sinks.write_matrix(spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0), (1, 2, None)], "i long, j long, value double"), str(tmp_path / "m"), [1, 2])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "m")).collect()) == ["1,1.0,0.0", "2,0.0,1.0"]


def test_standardize_without_spread(spark):
    df = spark.createDataFrame([("f", "a", 1, 2.0), ("f", "a", 2, 2.0), ("f", "b", 1, 1.0), ("f", "b", 2, 3.0), ("g", "b", 1, None)], "flight string, variable string, ts long, value double")
    assert sorted((r.variable, r.value) for r in stats.standardize(df).where("value is not null").collect()) == [("b", -1.0), ("b", 1.0)]
    assert sorted((r.variable, r.ts, r.value) for r in stats.binarize(df).where("value is not null").collect()) == [("a", 1, 1), ("a", 2, 1), ("b", 1, 0), ("b", 2, 1)]


def test_reported_golden_pairs_stay_within_buckets(spark):
    """The pairs of a report are among all pairs of the buckets it lists."""
    lines = ["hash code size is 3", "bucket 3 10 1 3", "bucket 1 100 1 3", "bucket 2 0 1 3", "bucket 3 0 2", "sim 1 3 7.715611", "sim 1 3 7.715611", "sim 1 3 7.715611"]
    sims = network.parse_report(spark.createDataFrame([(x,) for x in lines], "line string"))
    held = network.parse_buckets(spark.createDataFrame([(x,) for x in [*lines, "bucket 1 x 9", "bucket"]], "line string"))
    assert sorted(map(tuple, held.collect())) == [(1, 100, 1), (1, 100, 3), (2, 0, 1), (2, 0, 3), (3, 0, 2), (3, 10, 1), (3, 10, 3)]
    implied = {(r.id1, r.id2): r.n_tables for r in network.collision_counts(network.candidate_pairs(held)).collect()}
    assert implied == {(1, 3): 3} and {(r.id1, r.id2) for r in sims.collect()} <= set(implied)
    assert sims.count() == 3 and [tuple(r) for r in network.deduplicate(sims).collect()] == [(1, 3, 7.715611)]


def test_sweep(spark, toy):
    from skein.plans.sweep import sweep

    configs = [ClipConfig(6, 2.0, [0, 1, 3], 3, 0.1), SaxConfig(9, 4.5, 0.1, 2, 3, [0, 1, 2], 2), ShingleConfig(9, families.projection(3, 1), 1, 2, 1, families.draws(5, 2, 1))]
    got = sweep(spark, toy, configs).orderBy("trial").collect()
    assert [(r.method, r.n_pairs) for r in got[:2]] == [("clip", 1), ("sax", 3)] and got[2].method == "shingle"


def test_flights_and_matrix_files(spark, tmp_path):
    """Every flight file under every setting; a report file to a matrix file, with distance 0 told from no comparison."""
    from skein.plans.sweep import report_to_matrix, sweep_flights

    r = random.Random(4)
    for name, n in (("f1", 30), ("f2", 24), ("short", 5)):
        base = [r.uniform(-1, 1) for _ in range(n)]
        rows = [f"{i},{x:.4f},{x + 0.001:.4f},{r.uniform(-1, 1):.4f},{'' if i == 2 else x}" for i, x in enumerate(base)]
        (tmp_path / f"{name}.evt").write_text("TS,A,B,C,D\n" + "\n".join(rows) + "\n")
    configs = [ClipConfig(20, 0.0, [0, 5], 6, 0.1), SaxConfig(20, 0.0, 0.6, 2, 4, [0, 4], 4)]
    got = {(x.flight, x.trial): (x.method, x.n_pairs) for x in sweep_flights(spark, str(tmp_path / "*.evt"), ["TS", "A", "B", "C", "D"], configs).collect()}
    assert set(got) == {(f, t) for f in ("f1.evt", "f2.evt", "short.evt") for t in (1, 2)}
    assert got["short.evt", 1] == ("clip", 0) and 1 <= got["f1.evt", 1][1] <= 3 and got["f2.evt", 2][0] == "sax"
    (tmp_path / "report.txt").write_text("hash code size is 3\nsim 1 2 0.0\nsim 2 1 0.0\nsim 1 3 2.999\nbucket 1 5 1 2\n")
    cells = {(x.i, x.j): (x.kind, x.value) for x in report_to_matrix(spark, str(tmp_path / "report.txt"), str(tmp_path / "m"), [1, 2, 3]).collect()}
    assert cells[1, 2] == ("compared", 0.0) and cells[2, 3] == ("not compared", None) and cells[3, 3] == ("self", 1.0)
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "m")).collect()) == ["1,1.0,0.0,2.999", "2,0.0,1.0,0.0", "3,2.999,0.0,1.0"]
    scaled = {(x.i, x.j): x.value for x in report_to_matrix(spark, str(tmp_path / "report.txt"), str(tmp_path / "n"), [1, 2, 3], scale=True).collect()}
    assert scaled[1, 3] == pytest.approx(2.999 / 3.0) and scaled[1, 2] == 0.0


class FakeState:
    """List state that lets members go after its time to live, counted in calls."""

    def __init__(self, ttl):
        self.ttl, self.now, self.rows = ttl, 0, []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter([r for r, t in self.rows if self.ttl is None or self.now - t < self.ttl])

    def appendList(self, rows):
        self.rows += [(r, self.now) for r in rows]


@pytest.mark.parametrize("ttl", [None, 1])
@pytest.mark.parametrize("most", [1, 10**6])
def test_stream_state(monkeypatch, ttl, most):
    """Pairs over several batches with repeats, nulls and small chunks; with an expiry early members are let go."""
    monkeypatch.setattr(pairs, "PAIRS", most)
    states = []

    class Handle:
        def getListState(self, name, schema, ttl_ms):
            states.append(FakeState(ttl_ms))
            return states[-1]

    p = pairs.PairEmitter(ttl)
    p.init(Handle())
    out = []
    for batch in ([[3, 1, 3, None]], [[2, 1], [5]]):
        got = [tuple(r) for f in p.handleInputRows((1, 7), (pd.DataFrame({"item": x}) for x in batch), None) for r in f.itertuples(index=False)]
        assert len(got) == len(set(got)) and all(x[:2] == (1, 7) for x in got)
        out.append({(a, b) for _, _, a, b in got})
        states[0].now += 1
    assert out[0] == {(1, 3)}
    assert out[1] == ({(1, 2), (2, 3), (1, 5), (3, 5), (2, 5)} if ttl is None else {(1, 2), (1, 5), (2, 5)})
