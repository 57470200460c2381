"""Buckets, candidate pairs, verified similarities, matrices and reports of a similarity network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bucket with more members than this is met part by part, so that no task sees a whole hot bucket.
HOT_BUCKET = 20_000


def buckets(codes: DataFrame) -> DataFrame:
    """(table_id, code, n, members): members in ascending order."""
    return codes.groupBy("table_id", "code").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("item")).alias("members"))


def candidate_pairs(codes: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(table_id, code, id1, id2): every pair id1 < id2 of a bucket, once per table in which it collides.

    A bucket beyond hot_bucket is parted by item; each pair of parts is joined by a task of its own.
    """
    key = ["table_id", "code"]
    hot = codes.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > hot_bucket).select(*key, F.ceil(F.col("n") / hot_bucket).cast("int").alias("parts"))
    c = codes.select(*key, "item").join(hot, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("p", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
    left = c.select(*key, F.col("item").alias("x"), F.col("p").alias("i"), F.explode(F.sequence(F.col("p"), F.col("parts") - 1)).alias("j"))
    right = c.select(*key, F.col("item").alias("y"), F.explode(F.sequence(F.lit(0), F.col("p"))).alias("i"), F.col("p").alias("j"))
    met = left.join(right, [*key, "i", "j"]).where("(i = j and x < y) or (i < j and x <> y)")
    return met.select(*key, F.least("x", "y").alias("id1"), F.greatest("x", "y").alias("id2"))


def collision_counts(pairs: DataFrame) -> DataFrame:
    """(id1, id2, n_tables): in how many tables each pair collides."""
    return pairs.groupBy("id1", "id2").agg(F.count("*").alias("n_tables"))


def verify(pairs: DataFrame, encoded: DataFrame, measure, enc: str = "enc", keep: list[str] | None = None) -> DataFrame:
    """(id1, id2, [keep...,] sim): each distinct pair once, with its encodings fetched by id and measured.

    With `keep` the pairs are distinct already and bring those columns along.
    """
    one = pairs.select("id1", "id2").distinct() if keep is None else pairs.select("id1", "id2", *keep)
    a = encoded.select(F.col("item").alias("id1"), F.col(enc).alias("enc1"))
    b = encoded.select(F.col("item").alias("id2"), F.col(enc).alias("enc2"))
    return one.join(a, "id1").join(b, "id2").select("id1", "id2", *(keep or []), measure("enc1", "enc2").alias("sim"))


def matrix(sims: DataFrame, items: DataFrame) -> DataFrame:
    """(i, j, kind, value): the cells i <= j of the matrix of the given items; diagonal 1, null where a pair was not compared.

    kind is self, compared or not compared, so that a compared pair of distance or similarity 0 is told from no comparison.

    items is a bounded set (the variables of one flight), whose square is the size of the result by definition.
    """
    one = items.select(F.col("item").alias("i"))
    cells = one.join(items.select(F.col("item").alias("j")), F.col("i") <= F.col("j"))
    known = sims.select(F.col("id1").alias("i"), F.col("id2").alias("j"), F.col("sim"))
    self_ = F.col("i") == F.col("j")
    kind = F.when(self_, "self").when(F.col("sim").isNull(), "not compared").otherwise("compared")
    return cells.join(known, ["i", "j"], "left").select("i", "j", kind.alias("kind"), F.when(self_, 1.0).otherwise(F.col("sim")).alias("value"))


def normalized(sims: DataFrame) -> DataFrame:
    """(id1, id2, value): similarities scaled into (0, 1) by the largest one, at least 1, plus 0.001.

    The largest comes from a scalar subquery: pairs are not brought together to find it.
    """
    top = sims.agg((F.greatest(F.max("sim"), F.lit(1.0)) + 0.001).alias("top"))
    return sims.select("id1", "id2", (F.col("sim") / top.scalar()).alias("value"))


def report_lines(sims: DataFrame, held: DataFrame, code_len: int) -> DataFrame:
    """(kind, line): the header, a line per pair and a line per bucket; kind 0, 1, 2 orders them."""
    head = sims.sparkSession.range(1).select(F.lit(0).alias("kind"), F.lit(f"hash code size is {code_len}").alias("line"))
    pair = sims.select(F.lit(1).alias("kind"), F.format_string("sim %d %d %.6f", "id1", "id2", "sim").alias("line"))
    bucket = held.select(F.lit(2).alias("kind"), F.concat_ws(" ", F.lit("bucket"), F.col("table_id").cast("string"), F.col("code").cast("string"), F.concat_ws(" ", F.col("members").cast("array<string>"))).alias("line"))
    return head.unionByName(pair).unionByName(bucket)


def parse_report(lines: DataFrame, line: str = "line") -> DataFrame:
    """(id1, id2, sim) of the sim lines of a report; other lines, and sim lines without three numbers, are passed over."""
    p = F.split(F.trim(F.col(line)), r"\s+")
    at = lambda k, t: F.get(p, F.lit(k)).try_cast(t)
    return lines.where(F.col(line).startswith("sim")).select(at(1, "long").alias("id1"), at(2, "long").alias("id2"), at(3, "double").alias("sim")).where("id1 is not null and id2 is not null and sim is not null")


def parse_buckets(lines: DataFrame, line: str = "line") -> DataFrame:
    """(table_id, code, item) of the bucket lines of a report, one row per member; other lines, and words that are no number, are passed over."""
    p = F.split(F.trim(F.col(line)), r"\s+")
    at = lambda k, t: F.get(p, F.lit(k)).try_cast(t)
    members = F.transform(F.slice(p, F.lit(4), F.greatest(F.size(p) - 3, F.lit(0))), lambda w: w.try_cast("long"))
    rows = lines.where(F.col(line).startswith("bucket")).select(at(1, "int").alias("table_id"), at(2, "long").alias("code"), F.explode(members).alias("item"))
    return rows.where("table_id is not null and code is not null and item is not null")


def deduplicate(sims: DataFrame) -> DataFrame:
    """(id1, id2, sim): one row per unordered pair of different items; repeated pairs carry one value, of which the largest is kept."""
    return sims.where("id1 <> id2").groupBy(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).agg(F.max("sim").alias("sim"))


def as_text(values: Column | str) -> Column:
    """An array as comma-separated text."""
    return F.concat_ws(",", (F.col(values) if isinstance(values, str) else values).cast("array<string>"))
