"""Queries of the pair, vector and number problems (1, 4, 5, 6 and 7) and their SQL."""

from pyspark.sql import functions as F

from skein.llm import clusters, components, neardup, neighbours, quantiles
from skein.session import materialize, read_table

_GROUPS = """with recursive e as (select distinct ind1 a, ind2 b from sim_pairs where ind1 <> ind2 union select distinct ind2, ind1 from sim_pairs where ind1 <> ind2),
items as (select ind1 item from sim_pairs where ind1 is not null union select ind2 from sim_pairs where ind2 is not null),
r(item, root) as (select item, item from items union select e.b, r.root from r join e on e.a = r.item where r.root < e.b),
g as (select item, min(root) group_item from r group by item)
"""

_ALIKE = """with m as (select mat_id, mat from matrices where mat is not null and len(mat) = 378 and list_bool_or(list_transform(mat, lambda x: x <> 0))),
e as (select a.mat_id a, b.mat_id b from m a join m b on a.mat_id <> b.mat_id where list_cosine_similarity(a.mat, b.mat) >= 0.85),
s as (select a, list_sort(list_append(list(b), a)) k from e group by a),
c as (select k, count(*) n from s group by k)
select a mat_id, k[1] cluster_mat from s join c using (k) where n = len(k)"""

_NEAREST = """with v as (select item, any_value(vals) v from series where vals is not null and len(vals) = 64
  and not list_bool_or(list_transform(vals, lambda x: x is null or isnan(x))) group by item),
n as (select a.item a, b.item b, row_number() over (partition by a.item order by list_distance(a.v, b.v), b.item) r from v a join v b on a.item <> b.item)
"""

_COUNTED = """with d as (select distinct on (reading_id) var_no, ts, item from readings where item is not null and not isnan(item) and ts is not null)
"""

_SIMILAR = """with v as (select rec_id, list_transform(string_split_regex(trim(raw_vals, chr(32) || chr(9)), '[ \\t]+'), lambda x: cast(x as double) + 0.0) v from series_lines where raw_vals is not null and trim(raw_vals, chr(32) || chr(9)) <> ''),
g as (select distinct rec_id, unnest(list_transform(range(1, len(v) - 1), lambda i: {'x': v[i], 'y': v[i + 1], 'z': v[i + 2]})) g from v where len(v) >= 3),
n as (select rec_id, count(*) n from g group by 1),
p as (select a.rec_id a, b.rec_id b, count(*) c from g a join g b on a.g = b.g and a.rec_id < b.rec_id group by all),
s as (select p.a, p.b from p join n x on x.rec_id = p.a join n y on y.rec_id = p.b where c >= 0.6 * (x.n + y.n - c) - 1e-9)
"""


def p1_found(spark, d):
    """The group of each item of sim_pairs."""
    return components.group_items(read_table(spark, d, "sim_pairs"))


def p1_group_sizes(spark, d):
    """How many groups there are of each size."""
    groups = materialize(components.group_items(read_table(spark, d, "sim_pairs")))
    return groups.groupBy("group_item").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def p4_found(spark, d):
    """Sets of matrices that are all alike and alike to none outside."""
    return clusters.alike_sets(read_table(spark, d, "matrices"))


def p4_clusters(spark, d):
    """The density clusters of the matrices, with size, persistence and exemplars."""
    return clusters.density_clusters(read_table(spark, d, "matrices"))


def p4_separated(spark, d):
    """The alike sets of three or more as the density clusters see them: each member with its density cluster's least such member, and their number.

    A set that the clusters split, merge with another or lose members of comes out otherwise than in p4_found.
    """
    table = read_table(spark, d, "matrices")
    sets = clusters.alike_sets(table)
    large = sets.groupBy("cluster_mat").agg(F.count("*").alias("k")).where(F.col("k") >= clusters.MIN_CLUSTER)
    seen = materialize(clusters.density_clusters(table).join(sets.join(large, "cluster_mat"), "mat_id").select("mat_id", "cluster_id"))
    return seen.join(seen.groupBy("cluster_id").agg(F.min("mat_id").alias("group_mat"), F.count("*").alias("n")), "cluster_id").select("mat_id", "group_mat", "n")


def p5_found(spark, d):
    """Pairs of items of which one is among the 5 nearest of the other."""
    return neighbours.nearest_pairs(read_table(spark, d, "series"))


def p5_neighbours(spark, d):
    """The 5 nearest other items of every item, in order."""
    return neighbours.nearest(read_table(spark, d, "series")).select("item", "neighbour", F.col("rank").cast("long").alias("rank"))


def p6_daily_percentiles(spark, d):
    """Percentiles of item for each sensor label and day."""
    return quantiles.percentiles(read_table(spark, d, "readings"), read_table(spark, d, "sensors"))


def p6_percentiles(spark, d):
    """Percentiles of item for each sensor label, merged from the sketches of the days."""
    return quantiles.percentiles(read_table(spark, d, "readings"), read_table(spark, d, "sensors"), per_day=False)


def p6_counted(spark, d):
    """How many readings stand behind each label's percentiles, and whether all of those are within the stated error."""
    readings, sensors = read_table(spark, d, "readings"), read_table(spark, d, "sensors")
    return quantiles.within_bounds(readings, sensors, materialize(quantiles.percentiles(readings, sensors, per_day=False)))


def p6_daily_counted(spark, d):
    """The same for each label and day."""
    readings, sensors = read_table(spark, d, "readings"), read_table(spark, d, "sensors")
    return quantiles.within_bounds(readings, sensors, materialize(quantiles.percentiles(readings, sensors))).withColumn("day", F.col("day").cast("string"))


def p6_exact(spark, d):
    """The exact percentiles of each label, for which the sketches' stated error is the bracket."""
    return quantiles.exact_percentiles(read_table(spark, d, "readings"), read_table(spark, d, "sensors"))


def p6_corrected(spark, d):
    """The same once readings beyond their sensor's limits are deleted from the sketches: counted against the readings left."""
    readings, sensors = read_table(spark, d, "readings"), read_table(spark, d, "sensors")
    limits = sensors.select(F.col("var_no"), "phys_lo", "phys_hi")
    marked = readings.join(F.broadcast(limits), "var_no")  # 28 rows by definition
    gone, left = marked.where("item < phys_lo or item > phys_hi"), marked.where("item between phys_lo and phys_hi")
    found = materialize(quantiles.answers(quantiles.merge(quantiles.without(quantiles.daily_sketches(readings, sensors), gone, sensors), ["var_no"]), sensors, quantiles.QUANTILES, ["var_no"]))
    return quantiles.within_bounds(left, sensors, found)


def p7_found(spark, d):
    """Pairs of records whose runs of three values share at least 0.6 of their union."""
    return neardup.similar_pairs(read_table(spark, d, "series_lines"))


def p7_groups(spark, d):
    """The group and the number of links of every record."""
    return neardup.similar_groups(read_table(spark, d, "series_lines")).select("rec_id", "group_id", "n_links")


_OWN = (p1_found, p1_group_sizes, p4_found, p4_clusters, p4_separated, p5_found, p5_neighbours, p6_daily_percentiles, p6_percentiles, p6_counted, p6_daily_counted, p6_exact, p6_corrected, p7_found, p7_groups)
QUERIES = {f.__name__: f for f in _OWN}
SQL = {
    "p1_found": _GROUPS + "select item, group_item from g",
    "p1_group_sizes": _GROUPS + "select size, count(*) n_groups from (select group_item, count(*) size from g group by 1) group by 1",
    "p4_found": _ALIKE,
    "p4_separated": "with f as (" + _ALIKE + ") select mat_id, cluster_mat group_mat, n from (select *, count(*) over (partition by cluster_mat) n from f) where n >= 3",
    "p5_found": _NEAREST + "select distinct least(a, b) item_a, greatest(a, b) item_b from n where r <= 5",
    "p5_neighbours": _NEAREST + "select a item, b neighbour, r rank from n where r <= 5",
    "p6_counted": _COUNTED + "select label, count(*) n, true bounded from d join sensors using (var_no) group by 1",
    "p6_daily_counted": _COUNTED + "select label, strftime(ts, '%Y-%m-%d') as day, count(*) n, true bounded from d join sensors using (var_no) group by 1, 2",
    "p6_exact": _COUNTED + "select label, unnest([0.05, 0.25, 0.5, 0.75, 0.95])::double q, unnest(list_transform([0.05, 0.25, 0.5, 0.75, 0.95], lambda q: x[cast(floor(q * (len(x) - 1) + 1e-9) as bigint) + 1])) as value from (select label, list_sort(list(item)) x from d join sensors using (var_no) group by label)",
    "p6_corrected": _COUNTED + "select label, count(*) n, true bounded from d join sensors using (var_no) where item between phys_lo and phys_hi group by 1",
    "p7_found": _SIMILAR + "select a rec_a, b rec_b from s",
    "p7_groups": _SIMILAR.replace("with v", "with recursive v", 1) + """, e as (select a, b from s union select b, a from s),
r(rec_id, root) as (select rec_id, rec_id from n union select e.b, r.root from r join e on e.a = r.rec_id where r.root < e.b)
select rec_id, min(root) group_id, (select count(*) from e where e.a = r.rec_id) n_links from r group by rec_id""",
}
