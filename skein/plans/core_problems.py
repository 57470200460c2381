"""Queries of the general operators (problems 2 and 3) and their SQL."""

from pyspark.sql import functions as F

from skein.operators import rawlines, spikes
from skein.session import materialize, read_table

_PARSED = r"""with r as (select line_id, regexp_replace(coalesce(raw_line, ''), '\r$', '') s, raw_line is null nul from flight_lines),
q as (select *, regexp_full_match(s, '(?s)("([^"]|"")*"|[^",][^",]*|)(,("([^"]|"")*"|[^",][^",]*|))*') okq,
  1 + length(regexp_replace(s, '"([^"]|"")*"', '', 'g')) - length(replace(regexp_replace(s, '"([^"]|"")*"', '', 'g'), ',', '')) k,
  list_transform(string_split(replace(regexp_replace(s, '"(([^"]|"")*)"', '\1', 'g'), '""', '"'), ','), lambda x: trim(x, chr(32) || chr(9))) p from r),
v as (select line_id, p, case when not okq then 'quoting' when nul or k <> 29 then 'column_count' when len(p) <> 29
  or not list_bool_and(list_transform(p, lambda x: regexp_full_match(x, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') and coalesce(isfinite(try_cast(ltrim(x, '+') as double)), false)))
  then 'invalid_value' end reason from q)
"""

_SPIKES = """with d as (select distinct on (reading_id) reading_id, flight_no, tail, var_no, ts, item from readings where item is not null and not isnan(item)),
o as (select *, row_number() over w i, lag(item) over w p from d window w as (partition by flight_no, var_no order by ts, reading_id)),
g as (select *, sum(case when item = p then 0 else 1 end) over (partition by flight_no, var_no order by i) run from o),
u as (select tail, var_no, median(abs(item - p)) step from o where p is not null and item <> p group by all),
l as (select g.*, step, s.label, (item < phys_lo or item > phys_hi) is true lim,
   (count(*) over (partition by flight_no, g.var_no, run) >= 6 and s.label not in ('PH', 'WOW') and not (s.label like 'VIB%' and item = 0)) is true stuck
   from g join sensors s using (var_no) left join u using (tail, var_no)),
k as (select *, lim or stuck bad from l),
n as (select *, label not in ('PH', 'WOW') spiky, 15 * step t, lag(item, 1) over w m1, lag(item, 2) over w m2, lag(item, 3) over w m3, lead(item, 1) over w p1, lead(item, 2) over w p2, lead(item, 3) over w p3,
   lag(bad, 1) over w bm1, lag(bad, 2) over w bm2, lag(bad, 3) over w bm3, lead(bad, 1) over w bp1, lead(bad, 2) over w bp2, lead(bad, 3) over w bp3
   from k window w as (partition by flight_no, var_no order by i)),
c as (select reading_id, lim, stuck, spiky and not bad and (
   (not bm1 and not bp1 and (item - greatest(m1, p1) > t or least(m1, p1) - item > t))
or (not bm1 and not bp1 and not bp2 and p2 is not null and (least(item, p1) - greatest(m1, p2) > t or least(m1, p2) - greatest(item, p1) > t))
or (not bm1 and not bm2 and not bp1 and m2 is not null and (least(item, m1) - greatest(m2, p1) > t or least(m2, p1) - greatest(item, m1) > t))
or (not bm1 and not bp1 and not bp2 and not bp3 and p3 is not null and (least(item, p1, p2) - greatest(m1, p3) > t or least(m1, p3) - greatest(item, p1, p2) > t))
or (not bm1 and not bm2 and not bp1 and not bp2 and m2 is not null and p2 is not null and (least(m1, item, p1) - greatest(m2, p2) > t or least(m2, p2) - greatest(m1, item, p1) > t))
or (not bm1 and not bm2 and not bm3 and not bp1 and m3 is not null and (least(m2, m1, item) - greatest(m3, p1) > t or least(m3, p1) - greatest(m2, m1, item) > t))) spike from n)
"""  # fmt: skip


def p2_found(spark, d):
    """Lines that cannot be parsed, with the first reason that holds."""
    return rawlines.rejected_rows(rawlines.parse_lines(read_table(spark, d, "flight_lines"))).select("line_id", "reason")


def p2_rows(spark, d):
    """The good lines as typed rows of the flight table."""
    return rawlines.typed_rows(rawlines.parse_lines(read_table(spark, d, "flight_lines")))


def p2_reasons(spark, d):
    """How many lines each reason rejected; 'ok' for the good ones."""
    parsed = rawlines.parse_lines(read_table(spark, d, "flight_lines"))
    return parsed.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def p3_found(spark, d):
    """Readings that break a limit, are stuck or are spikes."""
    return spikes.implausible_readings(read_table(spark, d, "readings"), read_table(spark, d, "sensors"))


def p3_kinds(spark, d):
    """Flagged readings by sensor and kind (limit before stuck before spike)."""
    flags = materialize(spikes.flag_readings(read_table(spark, d, "readings"), read_table(spark, d, "sensors")).where("kind <> 'level_shift'"))
    return flags.groupBy("kind").agg(F.count("*").alias("n"), F.sum("reading_id").alias("id_sum"))


def p3_usual_steps(spark, d):
    """The usual step of each tail and sensor."""
    of = spikes.flag_readings(read_table(spark, d, "readings"), read_table(spark, d, "sensors"), profile=True)
    return of.where("step is not null").select("tail", "var_no", F.round("step", 9).alias("step"))


QUERIES = {f.__name__: f for f in (p2_found, p2_rows, p2_reasons, p3_found, p3_kinds, p3_usual_steps)}
SQL = {
    "p2_found": _PARSED + "select line_id, reason from v where reason is not null",
    "p2_rows": _PARSED + "select line_id, " + ", ".join(f'cast(p[{i + 1}] as double) as "{c}"' for i, c in enumerate(rawlines.FLIGHT_COLUMNS)) + " from v where reason is null",
    "p2_reasons": _PARSED + "select coalesce(reason, 'ok') reason, count(*) n from v group by 1",
    "p3_found": _SPIKES + "select reading_id from c where lim or stuck or spike",
    "p3_kinds": _SPIKES + "select case when lim then 'limit' when stuck then 'stuck' else 'spike' end kind, count(*) n, cast(sum(reading_id) as bigint) id_sum from c where lim or stuck or spike group by 1",
    "p3_usual_steps": _SPIKES + "select tail, var_no, round(step, 9) step from u where step is not null",
}
