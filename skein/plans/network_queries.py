"""Queries of the similarity network and of the series statistics, each with SQL in another formulation.

The SQL works on exploded positions (gaps and islands, grouped sums) where the engine works on arrays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.config import BREAKPOINTS, ClipConfig, SaxConfig, ShingleConfig
from skein.functions import encode, families, hashing, similarity
from skein.operators import network, stats
from skein.operators.network import as_text
from skein.plans.sweep import codes_of, encoded, measure_of, network_of
from skein.session import app_dir, materialize, read_table
from skein.sources import series as src
from skein.streaming.pairs import pairs_available_now

CLIP = ClipConfig(elements=64, threshold=0.0, offsets=[0, 9, 19, 31, 46], code_len=5, growth=0.1)
SAX = SaxConfig(elements=40, mean=49.63, sd=49.10, segment=4, alphabet=5, offsets=[0, 3, 6], code_len=4)
_PROJ = [((37 * j + 11) % 101) / 101.0 - 0.5 for j in range(8)]
_DRAWS = [[16 * (((7919 * i + 104729 * j + 13) % 10007) / 10007.0) for j in range(8)] for i in range(5)]
SHINGLE = ShingleConfig(elements=64, projection=_PROJ, stride=2, shingle_bits=4, shingle_stride=1, draws=_DRAWS)

# the same encodings under hash families drawn from a seed
SEEDED_CLIP = ClipConfig(elements=64, threshold=0.0, offsets=families.offsets(6, 64, 6, 20), code_len=6, growth=0.1)
SEEDED_SHINGLE = ShingleConfig(elements=64, projection=families.projection(8, 20, "normal"), stride=2, shingle_bits=4, shingle_stride=1, draws=families.draws(4, 4, 20))


# sources and statistics
def scan_series_source(spark, d):
    """Series lines read as numbers up to the first word that is none."""
    s = src.parse_series(read_table(spark, d, "series_lines"), "rec_id", "raw_vals")
    return s.select("item", F.size("vals").alias("n_vals"), F.round(F.aggregate("vals", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def series_window(spark, d):
    """The window of 16 values from position 8; shorter series are left out."""
    s = src.parse_series(read_table(spark, d, "series_lines"), "rec_id", "raw_vals", 8, 24)
    return s.select("item", F.round(F.get("vals", F.lit(0)), 6).alias("first_val"), F.round(F.get("vals", F.lit(23)), 6).alias("last_val"))


def series_transpose(spark, d):
    """Each flight and variable as one ordered series."""
    t = stats.transpose(src.flights_events(spark, d), ["ts", "event_id"])
    return t.select("flight", "variable", F.size("vals").alias("n"), F.round(F.get("vals", F.lit(0)), 6).alias("first_val"), F.round(F.element_at("vals", -1), 6).alias("last_val"))


def series_extent(spark, d):
    """First and last time and length of each flight."""
    e = stats.flight_extent(src.flights_events(spark, d))
    return e.select("flight", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"), F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"), "n")


def variable_stats(spark, d):
    v = stats.variable_stats(src.flights_events(spark, d))
    return v.select("variable", "n", *(F.round(c, 6).alias(c) for c in ("mean", "minimum", "maximum", "sd")))


def standardize(spark, d):
    return stats.standardize(src.flights_events(spark, d)).select("event_id", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def binarize_mean(spark, d):
    return stats.binarize(src.flights_events(spark, d)).select("event_id", "value")


def series_normalize(spark, d):
    s = src.series_events(spark, d)
    return s.select("item", F.posexplode(encode.normalize("vals", SAX.mean, SAX.sd)).alias("pos", "z")).select("item", "pos", (F.round("z", 6) + F.lit(0.0)).alias("z"))


# binary clipping
def _clip(spark, d):
    return src.series_embeddings(spark, d).select("item", encode.clip("vals", CLIP).alias("enc"))


def _clip_codes(spark, d):
    return hashing.substring_codes(_clip(spark, d), CLIP.offsets, CLIP.code_len)


def _clip_sims(spark, d):
    return network_of(src.series_embeddings(spark, d), CLIP)


def abc_encode(spark, d):
    return _clip(spark, d).select("item", F.concat_ws("", F.col("enc").cast("array<string>")).alias("enc"))


def abc_codes(spark, d):
    return _clip_codes(spark, d)


def abc_buckets(spark, d):
    return network.buckets(_clip_codes(spark, d)).select("table_id", "code", "n", as_text("members").alias("members"))


def abc_candidate_pairs(spark, d):
    return network.candidate_pairs(_clip_codes(spark, d))


def pair_collision_count(spark, d):
    return network.collision_counts(network.candidate_pairs(_clip_codes(spark, d)))


def pair_dedup(spark, d):
    """The reported similarities of sim_pairs, one row per unordered pair."""
    p = read_table(spark, d, "sim_pairs").where("ind1 is not null and ind2 is not null")
    return network.deduplicate(p.select(F.col("ind1").alias("id1"), F.col("ind2").alias("id2"), "sim"))


def abc_similarity(spark, d):
    return _clip_sims(spark, d).select("id1", "id2", F.round("sim", 6).alias("sim"))


def _with_tables(series, cfg):
    """The network of series with the number of tables in which each pair collided."""
    enc = materialize(encoded(series, cfg))
    counted = network.collision_counts(network.candidate_pairs(codes_of(enc, cfg)))
    return network.verify(counted, enc, measure_of(cfg), keep=["n_tables"])


def similarity_network_abc(spark, d):
    """The network of the binary clips, with the number of tables in which each pair collided."""
    return _with_tables(src.series_embeddings(spark, d), CLIP).select("id1", "id2", "n_tables", F.round("sim", 6).alias("sim"))


# symbols
def _sax(spark, d):
    return src.series_events(spark, d).select("item", encode.sax("vals", SAX).alias("enc"))


def _sax_codes(spark, d):
    return hashing.substring_codes(_sax(spark, d), SAX.offsets, SAX.code_len)


def _sax_sims(spark, d):
    return network_of(src.series_events(spark, d), SAX)


def sax_paa(spark, d):
    s = src.series_events(spark, d)
    return s.select("item", F.posexplode(encode.segment_means(F.col("vals"), SAX)).alias("word", "mean")).select("item", "word", (F.round("mean", 6) + F.lit(0.0)).alias("mean"))


def sax_encode(spark, d):
    return _sax(spark, d).select("item", as_text("enc").alias("enc"))


def sax_distance_table(spark, d):
    """The distances of all pairs of symbols of every alphabet."""
    rows = [(n, i, j, x) for n, bp in BREAKPOINTS.items() for i, row in enumerate(similarity.distance_table(bp)) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "alphabet int, i int, j int, dist double").select("alphabet", "i", "j", F.round("dist", 6).alias("dist"))


def sax_codes(spark, d):
    return _sax_codes(spark, d)


def sax_buckets(spark, d):
    return network.buckets(_sax_codes(spark, d)).select("table_id", "code", "n", as_text("members").alias("members"))


def sax_candidate_pairs(spark, d):
    return network.candidate_pairs(_sax_codes(spark, d))


def sax_mindist(spark, d):
    return _sax_sims(spark, d).select("id1", "id2", F.round("sim", 6).alias("dist"))


def similarity_network_sax(spark, d):
    return _with_tables(src.series_events(spark, d), SAX).select("id1", "id2", "n_tables", F.round("sim", 6).alias("dist"))


# shingles
def _grams(spark, d):
    s = src.series_embeddings(spark, d).select("item", encode.sketch("vals", SHINGLE).alias("bits"))
    return s.select("item", encode.shingles("bits", SHINGLE).alias("grams"))


def _counted(spark, d):
    return _grams(spark, d).select("item", encode.shingle_counts("grams", SHINGLE).alias("counts"))


def _ssh_codes(spark, d):
    return codes_of(encoded(src.series_embeddings(spark, d), SHINGLE), SHINGLE)


def projection_dot(spark, d):
    s = src.series_embeddings(spark, d)
    return s.select("item", F.posexplode(encode.projections("vals", SHINGLE)).alias("pos", "dot")).select("item", "pos", (F.round("dot", 6) + F.lit(0.0)).alias("dot"))


def ssh_sketch(spark, d):
    s = src.series_embeddings(spark, d).select("item", encode.sketch("vals", SHINGLE).alias("bits"))
    return s.select("item", F.concat_ws("", F.col("bits").cast("array<string>")).alias("bits"))


def ssh_shingle(spark, d):
    return _counted(spark, d).select("item", as_text("counts").alias("counts"))


def ssh_minhash_codes(spark, d):
    return _ssh_codes(spark, d)


def ssh_buckets(spark, d):
    return network.buckets(_ssh_codes(spark, d)).select("table_id", "code", "n", as_text("members").alias("members"))


def ssh_candidate_pairs(spark, d):
    return network.candidate_pairs(_ssh_codes(spark, d))


def _ssh_sims(spark, d):
    return network_of(src.series_embeddings(spark, d), SHINGLE)


def ssh_jaccard(spark, d):
    return _ssh_sims(spark, d).select("id1", "id2", F.round("sim", 6).alias("sim"))


def similarity_network_ssh(spark, d):
    return _with_tables(src.series_embeddings(spark, d), SHINGLE).select("id1", "id2", "n_tables", F.round("sim", 6).alias("sim"))


def seeded_clip_codes(spark, d):
    """Codes at offsets drawn from a seed."""
    return hashing.substring_codes(src.series_embeddings(spark, d).select("item", encode.clip("vals", SEEDED_CLIP).alias("enc")), SEEDED_CLIP.offsets, SEEDED_CLIP.code_len)


def seeded_shingle_codes(spark, d):
    """Codes under a normal projection and draws from a seed."""
    return codes_of(encoded(src.series_embeddings(spark, d), SEEDED_SHINGLE), SEEDED_SHINGLE)


# matrices and reports
def _reported(spark, d):
    """Similarities of the sensors of each flight, from the reports: (flight_no, id1, id2, sim)."""
    p = read_table(spark, d, "sim_pairs").where("ind1 is not null and ind2 is not null and sim is not null")
    flight = lambda c: F.floor((F.col(c) - 1) / 28).cast("long") + 1
    one = network.deduplicate(p.select(F.col("ind1").alias("id1"), F.col("ind2").alias("id2"), "sim"))
    return one.where(flight("id1") == flight("id2")).select(flight("id1").alias("flight_no"), (F.pmod(F.col("id1") - 1, F.lit(28)) + 1).alias("id1"), (F.pmod(F.col("id2") - 1, F.lit(28)) + 1).alias("id2"), "sim")


def similarity_matrix(spark, d):
    """The 28 sensors' matrix: the largest similarity reported for each pair of sensors in any one flight."""
    best = network.deduplicate(_reported(spark, d).select("id1", "id2", "sim"))
    items = read_table(spark, d, "sensors").select(F.col("var_no").cast("long").alias("item"))
    return network.matrix(best, items).select("i", "j", "kind", F.round("value", 6).alias("value"))


def similarity_normalized(spark, d):
    return network.normalized(_clip_sims(spark, d)).select("id1", "id2", F.round("value", 6).alias("value"))


def report_lines(spark, d):
    enc = materialize(_sax(spark, d))
    codes = codes_of(enc, SAX)
    return network.report_lines(network.verify(network.candidate_pairs(codes), enc, measure_of(SAX)), network.buckets(codes), SAX.code_len)


def report_parse(spark, d):
    """Reports written from sim_pairs and read again."""
    p = read_table(spark, d, "sim_pairs").where("ind1 is not null and ind2 is not null and sim is not null")
    lines = p.select(F.format_string("sim %d %d %.6f", "ind1", "ind2", "sim").alias("line"))
    return network.parse_report(lines).select("id1", "id2", F.round("sim", 6).alias("sim"))


def report_buckets(spark, d):
    """The pairs that the bucket lines of a report imply, read back from its text."""
    codes = _sax_codes(spark, d)
    nothing = codes.select(F.col("item").alias("id1"), F.col("item").alias("id2"), F.lit(0.0).alias("sim")).limit(0)
    lines = network.report_lines(nothing, network.buckets(codes), SAX.code_len).select("line")
    return network.candidate_pairs(network.parse_buckets(lines))


def stream_candidate_pairs(spark, d):
    """The candidate pairs of the binary codes, met one by one in a stream."""
    base = f"{app_dir(spark)}/stream-{uuid.uuid4().hex}"
    codes = _clip_codes(spark, d)
    codes.write.parquet(f"{base}/codes")
    stream = spark.readStream.schema(codes.schema).parquet(f"{base}/codes")
    return pairs_available_now(stream, f"{base}/pairs", f"{base}/state")


QUERIES = {
    f.__name__: f
    for f in (
        similarity_network_abc, scan_series_source, series_window, series_transpose, series_extent, variable_stats, standardize, binarize_mean, series_normalize,
        abc_encode, abc_codes, abc_buckets, abc_candidate_pairs, pair_collision_count, pair_dedup, abc_similarity,
        sax_paa, sax_encode, sax_distance_table, sax_codes, sax_buckets, sax_candidate_pairs, sax_mindist, similarity_network_sax,
        projection_dot, ssh_sketch, ssh_shingle, ssh_minhash_codes, ssh_buckets, ssh_candidate_pairs, ssh_jaccard, similarity_network_ssh,
        seeded_clip_codes, seeded_shingle_codes,
        similarity_matrix, similarity_normalized, report_lines, report_parse, report_buckets, stream_candidate_pairs,
    )
}

# --- SQL ---
_LINES = r"""with w as (select rec_id item, list_transform(string_split_regex(trim(raw_vals, chr(32) || chr(9)), '[ \t]+'), lambda x: try_cast(x as double)) v from series_lines where raw_vals is not null),
b as (select item, v, list_position(list_transform(v, lambda x: coalesce(isfinite(x), false)), false) bad from w),
s as (select item, case when coalesce(bad, 0) > 0 then v[1:bad - 1] else v end v from b)
"""
_EV = """with f as (select event_type flight, user_id variable, ts, event_id, value from events),
st as (select variable, count(value) n, avg(value) mean, min(value) minimum, max(value) maximum, stddev_pop(value) sd from f group by 1)
"""
_EMB = """with e as (select vec_id item, unnest(range(0, 64)) pos, unnest(embedding)::double x from embeddings),
bit as (select item, pos, case when x >= 0 then 1 else 0 end b from e),
"""


def _code_sql(enc: str, offsets: list[int], code_len: int) -> str:
    """codes(item, table_id, code) from positions (item, pos, b) of enc."""
    starts = ", ".join(f"({t + 1}, {o})" for t, o in enumerate(offsets))
    return f"""codes as (select item, t.table_id::int table_id, sum(b * power(10, {code_len} - 1 - (pos - o)))::bigint code from {enc} join (values {starts}) t(table_id, o) on pos >= o and pos < o + {code_len} group by 1, 2),
pairs as (select a.table_id, a.code, a.item id1, b.item id2 from codes a join codes b on a.table_id = b.table_id and a.code = b.code and a.item < b.item),
cnt as (select id1, id2, count(*) n_tables from pairs group by 1, 2)
"""


_CLIP_SQL = _EMB + _code_sql("bit", CLIP.offsets, CLIP.code_len)
_CLIP_SIM = (
    _CLIP_SQL
    + f""", z as (select id1, id2, x.pos, x.b = y.b same from cnt join bit x on x.item = id1 join bit y on y.item = id2 and y.pos = x.pos),
isl as (select id1, id2, pos - row_number() over (partition by id1, id2 order by pos) isle from z where same),
runs as (select id1, id2, count(*) r from isl group by id1, id2, isle),
sims as (select id1, id2, n_tables, coalesce(sum((power({1 + CLIP.growth}, r) - 1) / {CLIP.growth}), 0) sim from cnt left join runs using (id1, id2) group by 1, 2, 3)
"""
)
_BP = ", ".join(f"({k}, {b})" for k, b in enumerate(SAX.breakpoints))
_SAX_SQL = f"""with o as (select user_id item, row_number() over (partition by user_id order by ts, event_id) - 1 pos, value, count(*) over (partition by user_id) c from events),
v as (select item, pos, (value - {SAX.mean}) / {SAX.sd:.2f} z from o where pos < {SAX.elements} and c >= {SAX.elements}),
paa as (select item, least(pos // {SAX.segment}, {SAX.words - 1}) pos, avg(z) a from v group by 1, 2),
bp(k, x) as (values {_BP}),
sym as (select item, pos, (select count(*) from bp where x < a) b from paa),
""" + _code_sql("sym", SAX.offsets, SAX.code_len)
_DIST = "case when abs(x.b - y.b) <= 1 then 0 else (select h.x - l.x from bp h, bp l where h.k = greatest(x.b, y.b) - 1 and l.k = least(x.b, y.b)) end"
_SAX_SIM = (
    _SAX_SQL
    + f""", dd as (select i b1, j b2, case when abs(i - j) <= 1 then 0 else h.x - l.x end dist from range({SAX.alphabet}) a(i), range({SAX.alphabet}) c(j), bp h, bp l where h.k = greatest(greatest(i, j) - 1, 0) and l.k = least(least(i, j), {SAX.alphabet - 2})),
sims as (select id1, id2, n_tables, sqrt({SAX.elements} // {SAX.words}) * sqrt(sum(dist * dist)) sim from cnt join sym x on x.item = id1 join sym y on y.item = id2 and x.pos = y.pos join dd on b1 = x.b and b2 = y.b group by 1, 2, 3)
"""
)


def _ssh_sql(cfg: ShingleConfig) -> str:
    drawn = ", ".join(f"({t + 1}, {j}, {x!r})" for t, row in enumerate(cfg.draws) for j, x in enumerate(row))
    return f"""with e as (select vec_id item, list_transform(embedding, lambda x: x::double) v from embeddings),
p as (select item, i pos, list_reduce(list_prepend(0.0::double, list_transform(range(0, {len(cfg.projection)}), lambda j: ([{", ".join(repr(v) for v in cfg.projection)}])[j + 1]::double * v[i * {cfg.stride} + j + 1])), lambda a, b: a + b) dot from e, range({cfg.bits}) t(i)),
bit as (select item, pos, case when dot >= 0 then 1 else 0 end b from p),
gram as (select x.item, x.pos, sum(y.b * power(2, {cfg.shingle_bits} - 1 - (y.pos - x.pos)))::int g from bit x join bit y on x.item = y.item and y.pos between x.pos and x.pos + {cfg.shingle_bits - 1} where x.pos <= {cfg.bits - cfg.shingle_bits} group by 1, 2),
cn as (select item, g, count(*) c from gram group by 1, 2),
dr(table_id, j, x) as (values {drawn}),
codes as (select item, table_id::int table_id, min(j)::bigint code from cn join dr on g = floor(x)::int where x - floor(x) < c / {float(cfg.shingles)} group by 1, 2),
pairs as (select a.table_id, a.code, a.item id1, b.item id2 from codes a join codes b on a.table_id = b.table_id and a.code = b.code and a.item < b.item),
cnt as (select id1, id2, count(*) n_tables from pairs group by 1, 2)
"""


_SSH_SQL = _ssh_sql(SHINGLE)
_SSH_SIM = (
    _SSH_SQL
    + """, sz as (select item, count(*) n from cn group by 1),
com as (select id1, id2, count(*) k from cnt join cn x on x.item = id1 join cn y on y.item = id2 and x.g = y.g group by 1, 2),
sims as (select c.id1, c.id2, n_tables, coalesce(k, 0) / (a.n + b.n - coalesce(k, 0)) sim from cnt c join sz a on a.item = c.id1 join sz b on b.item = c.id2 left join com on com.id1 = c.id1 and com.id2 = c.id2)
"""
)
_BUCKETS = "select table_id, code, count(*) n, string_agg(item, ',' order by item) members from codes group by 1, 2"
_PAIRS = "select table_id, code, id1, id2 from pairs"
_SP = """with p as (select least(ind1, ind2) id1, greatest(ind1, ind2) id2, max(sim) sim from sim_pairs where ind1 <> ind2 group by 1, 2)
"""

SQL = {
    "scan_series_source": _LINES + "select item, len(v)::int n_vals, round(coalesce(list_sum(v), 0), 4) total from s",
    "series_window": _LINES + "select item, round(v[9], 6) first_val, round(v[32], 6) last_val from s where len(v) >= 32",
    "series_transpose": _EV + "select flight, variable, count(*)::int n, round(arg_min(value, (ts, event_id)), 6) first_val, round(arg_max(value, (ts, event_id)), 6) last_val from f group by 1, 2",
    "series_extent": _EV + "select flight, strftime(min(ts), '%Y-%m-%d %H:%M:%S') first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') last_ts, count(*) n from f group by 1",
    "variable_stats": _EV + "select variable, n, round(mean, 6) mean, round(minimum, 6) minimum, round(maximum, 6) maximum, round(sd, 6) sd from st",
    "standardize": _EV + "select event_id, round((value - mean) / sd, 6) + 0.0 as value from f join st using (variable)",
    "binarize_mean": _EV + "select event_id, case when value >= mean then 1 else 0 end as value from f join st using (variable)",
    "series_normalize": _SAX_SQL + "select item, pos::int pos, round(z, 6) + 0.0 z from v",
    "abc_encode": _CLIP_SQL + "select item, string_agg(b, '' order by pos) enc from bit group by 1",
    "abc_codes": _CLIP_SQL + "select item, table_id, code from codes",
    "abc_buckets": _CLIP_SQL + _BUCKETS,
    "abc_candidate_pairs": _CLIP_SQL + _PAIRS,
    "pair_collision_count": _CLIP_SQL + "select id1, id2, n_tables from cnt",
    "pair_dedup": _SP + "select id1, id2, sim from p",
    "abc_similarity": _CLIP_SIM + "select id1, id2, round(sim, 6) sim from sims",
    "similarity_network_abc": _CLIP_SIM + "select id1, id2, n_tables, round(sim, 6) sim from sims",
    "sax_paa": _SAX_SQL + "select item, pos::int word, round(a, 6) + 0.0 mean from paa",
    "sax_encode": _SAX_SQL + "select item, string_agg(b, ',' order by pos) enc from sym group by 1",
    "sax_distance_table": "with b(a, k, x) as (values "
    + ", ".join(f"({n}, {k}, {x})" for n, bp in BREAKPOINTS.items() for k, x in enumerate(bp))
    + ") select a::int alphabet, i::int i, j::int j, round(case when abs(i - j) <= 1 then 0 else (select x from b h where h.a = n.a and h.k = greatest(i, j) - 1) - (select x from b l where l.a = n.a and l.k = least(i, j)) end, 6)::double dist from (select distinct a from b) n, range(10) r(i), range(10) q(j) where i < a and j < a",
    "sax_codes": _SAX_SQL + "select item, table_id, code from codes",
    "sax_buckets": _SAX_SQL + _BUCKETS,
    "sax_candidate_pairs": _SAX_SQL + _PAIRS,
    "sax_mindist": _SAX_SIM + "select id1, id2, round(sim, 6) dist from sims",
    "similarity_network_sax": _SAX_SIM + "select id1, id2, n_tables, round(sim, 6) dist from sims",
    "projection_dot": _SSH_SQL + "select item, pos::int pos, round(dot, 6) + 0.0 dot from p",
    "ssh_sketch": _SSH_SQL + "select item, string_agg(b, '' order by pos) bits from bit group by 1",
    "ssh_shingle": _SSH_SQL + f"select item, string_agg(coalesce(c, 0), ',' order by k) counts from (select item, k from e, range({SHINGLE.kinds}) t(k)) left join (select item, g k, c from cn) using (item, k) group by 1",
    "ssh_minhash_codes": _SSH_SQL + "select item, table_id, code from codes",
    "ssh_buckets": _SSH_SQL + _BUCKETS,
    "ssh_candidate_pairs": _SSH_SQL + _PAIRS,
    "ssh_jaccard": _SSH_SIM + "select id1, id2, round(sim, 6) sim from sims",
    "similarity_network_ssh": _SSH_SIM + "select id1, id2, n_tables, round(sim, 6) sim from sims",
    "seeded_clip_codes": _EMB + _code_sql("bit", SEEDED_CLIP.offsets, SEEDED_CLIP.code_len) + "select item, table_id, code from codes",
    "seeded_shingle_codes": _ssh_sql(SEEDED_SHINGLE) + "select item, table_id, code from codes",
    "similarity_matrix": _SP
    + ", q as (select (id1 - 1) % 28 + 1 a, (id2 - 1) % 28 + 1 b, sim from p where (id1 - 1) // 28 = (id2 - 1) // 28 and sim is not null), m as (select least(a, b) i, greatest(a, b) j, max(sim) s from q where a <> b group by 1, 2) "
    "select x.var_no::bigint i, y.var_no::bigint j, case when x.var_no = y.var_no then 'self' when s is null then 'not compared' else 'compared' end kind, case when x.var_no = y.var_no then 1.0::double else round(s, 6) end as value from sensors x join sensors y on x.var_no <= y.var_no left join m on m.i = x.var_no and m.j = y.var_no",
    "similarity_normalized": _CLIP_SIM + "select id1, id2, round(sim / (greatest((select max(sim) from sims), 1) + 0.001), 6) as value from sims",
    "report_lines": _SAX_SIM
    + f"select 0 kind, 'hash code size is {SAX.code_len}' line union all select 1, format('sim {{}} {{}} {{:.6f}}', id1, id2, sim) from sims union all select 2, 'bucket ' || table_id || ' ' || code || ' ' || string_agg(item, ' ' order by item) from codes group by table_id, code",
    "report_parse": "select ind1 id1, ind2 id2, round(sim, 6) sim from sim_pairs where ind1 is not null and ind2 is not null and sim is not null",
    "report_buckets": _SAX_SQL + _PAIRS,
    "stream_candidate_pairs": _CLIP_SQL + _PAIRS,
}
