"""Near-duplicate records with small edits: fingerprints covered by anchor points.

A record is its set of runs of k consecutive values. Its fingerprint is a vector of min-hashes. Tables of three
coordinates form a space in which the words of a parity code (any two coordinates determine the third) are the
anchors: the code covers the space with radius one, and a vector lies within that radius of exactly the three anchors
that its pairs of coordinates determine. Each fingerprint is replicated to all of them. Two fingerprints within distance
one in some table share an anchor there for certain: by the triangle inequality alone that would take radius plus
threshold, two, which is every anchor that shares one coordinate; as any two coordinates determine a word of this code,
the radius is enough. At an anchor fingerprints are compared bit by bit; survivors are verified on the sets themselves.
With ten tables a pair at similarity 0.6 is beyond distance one in all of them with a probability of 3 in 100,000.

Records that share a crowded anchor are also joined by an exact way (a prefix filter over rare runs first), which
then replaces that anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.components import star_labels
from skein.llm.tokens import Slice, mix, span_hash
from skein.session import lookup_join, materialize, release, row_count

TABLES, RUN, SIMILARITY = 10, 3, 0.6
#: Bits of the comparison at an anchor, and how many may differ: five deviations above the mean of 0.2 at 0.6.
SKETCH_BITS, SKETCH_LIMIT = 128, 49
#: An anchor with more fingerprints than this is crowded.
CROWD = 400
#: Members of a key that one task joins with one another.
PART = 2_000
SIGN = "rec_id long, n int, key_a long, key_b long, sketch_a long, sketch_b long, runs array<long>, anchors array<long>"


def value_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The values of all texts as hashes of the numbers they write, and the number of values of each text.

    Values are parted by white space. Two spellings of one number are the same value; a word that is no finite number
    is a value of its own.
    """
    words = [t.split() for t in texts]
    count = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    odd: list[int] = []
    try:
        v = np.array(flat, dtype="U").astype(np.float64) if flat else np.zeros(0)
    except ValueError:
        v = np.zeros(len(flat))
        for i, x in enumerate(flat):
            try:
                v[i] = float(x)
            except ValueError:
                odd.append(i)
    odd += np.flatnonzero(~np.isfinite(v)).tolist()
    h = mix((v + 0.0).view(np.uint64) + np.uint64(0x1234567))
    for i in odd:
        s = Slice([flat[i].lower()])
        h[i] = span_hash(s.units, np.array([0]), np.array([len(s.units)]))[0] ^ np.uint64(0x5555)
    return h, count


def run_sets(h: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of k values of each text, ascending within it, and their number."""
    doc = np.repeat(np.arange(len(count)), count)
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(count), np.int64)
    ok = doc[:n] == doc[k - 1 :]
    with np.errstate(over="ignore"):
        g = h[:n].copy()
        for j in range(1, k):
            g = mix(g * np.uint64(3) + h[j : n + j])
    g, d = g[ok], doc[:n][ok]
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    one = np.ones(len(g), bool)
    one[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[one], d[one]
    return g, np.bincount(d, minlength=len(count))


def fingerprints(g: np.ndarray, n: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts with runs: anchors (3 per table), sketches (2 words), and a key of the whole set (2 words)."""
    has = n > 0
    first = (np.cumsum(n) - n)[has]
    anchors = np.zeros((int(has.sum()), 3 * tables), np.uint64)
    sketch = np.zeros((len(anchors), 2), np.uint64)
    if not len(anchors):
        return anchors, sketch, sketch.copy()
    with np.errstate(over="ignore"):
        least = lambda c: np.minimum.reduceat(mix(g ^ mix(np.full(1, c, np.uint64))), first)
        for t in range(tables):
            x, y, z = (least(3 * t + j + 1) for j in range(3))
            for j, (a, b) in enumerate(((x, y), (x, z), (y, z))):
                # a pair of coordinates names the anchor whose third coordinate the parity determines
                anchors[:, 3 * t + j] = mix(a + mix(b + np.uint64(97 * t + j)))
        for bit in range(SKETCH_BITS):
            sketch[:, bit // 64] |= (mix(least(1000 + bit)) & np.uint64(1)) << np.uint64(bit % 64)
        key = np.stack([np.add.reduceat(mix(g + np.uint64(c)), first) for c in (11, 23)], 1)
    return anchors, sketch, key


def signatures(records: DataFrame, id_col: str, text_col: str, tables: int = TABLES, k: int = RUN) -> DataFrame:
    """Rows of SIGN for every record that has at least one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                h, count = value_hashes(b.column(1).to_pylist())
                g, n = run_sets(h, count, k)
                anchors, sketch, key = fingerprints(g, n, tables)
                has = pa.array(np.flatnonzero(n > 0))
                n = n[n > 0]
                m = len(n)
                i64 = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
                runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), i64(g))
                spots = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * 3 * tables, pa.int32()), i64(anchors.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(has), pa.array(n, pa.int32()), i64(key[:, 0]), i64(key[:, 1]), i64(sketch[:, 0]), i64(sketch[:, 1]), runs, spots],
                    ["rec_id", "n", "key_a", "key_b", "sketch_a", "sketch_b", "runs", "anchors"],
                )

    return records.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).cast("string").alias("t")).where("t is not null and rec_id is not null").mapInArrow(run, SIGN)


def _fits(similarity: float) -> str:
    return f"least(a.n, b.n) >= {similarity} * greatest(a.n, b.n) - 1e-9"


def _meet(similarity: float, crowd: int):
    """Of rows (anchor, rec_id, n, sketch_a, sketch_b) sorted by anchor and rec_id: candidates (a, b), and (a, null) for records of a crowded anchor."""

    def compare(t: pa.Table) -> pa.RecordBatch:
        anchor, rec, n, sa, sb = (t.column(k).to_numpy() for k in range(5))
        sa, sb = sa.view(np.uint64), sb.view(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        size = np.diff(np.concatenate((first, [len(anchor)])))
        full = np.repeat(size > crowd, size)
        left = np.repeat(first + size, size) - np.arange(len(anchor)) - 1  # partners that come later at the same anchor
        left[full] = 0
        out = []
        live, d = np.flatnonzero(left > 0), 1
        while len(live):
            i, j = live, live + d
            lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            apart = np.bitwise_count(sa[i] ^ sa[j]).astype(np.int64) + np.bitwise_count(sb[i] ^ sb[j])
            ok = (lo >= similarity * hi - 1e-9) & (apart <= SKETCH_LIMIT) & (rec[i] != rec[j])
            out.append((rec[i[ok]], rec[j[ok]]))
            d += 1
            live = live[left[live] >= d]
        a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        pairs = np.unique(np.stack((a, b)), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        alone = np.unique(rec[full])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate((pairs[0], alone))), pa.array(np.concatenate((pairs[1], alone)), mask=np.arange(pairs.shape[1] + len(alone)) >= pairs.shape[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, crowded = None, None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([carry, t]).combine_chunks() if carry is not None else t
            if not t.num_rows:
                continue
            anchor = t.column(0).to_numpy()
            if crowded is not None and anchor[0] != crowded:
                crowded = None
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if crowded is not None:  # its first rows were passed on: the rest of it is as crowded
                more = int(np.searchsorted(anchor, crowded, "right"))
                own = np.unique(t.column(1).to_numpy()[:more])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.int64())], ["a", "b"])
                t, cut = t.slice(more), max(0, cut - more)
            if cut:
                yield compare(t.slice(0, cut).combine_chunks())
            carry = t.slice(cut)
            if carry.num_rows > crowd:
                crowded = int(carry.column(0)[0].as_py())
                yield compare(carry.combine_chunks())
                carry = None
        if carry is not None and carry.num_rows:
            yield compare(carry.combine_chunks())

    return run


def class_pairs(classes: DataFrame, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """(a, b): ids a < b of the distinct sets that share at least `similarity` of their union."""
    spots = classes.select(F.explode("anchors").alias("anchor"), "rec_id", "n", "sketch_a", "sketch_b")
    met = materialize(spots.repartition("anchor").sortWithinPartitions("anchor", "rec_id").mapInArrow(_meet(similarity, crowd), "a long, b long").distinct())
    cand = met.where("b is not null")
    crowded = met.where("b is null").select(F.col("a").alias("rec_id"))
    if crowded.limit(1).count():
        cand = cand.union(_prefix_pairs(classes.select("rec_id", "n", "runs").join(crowded, "rec_id"), similarity)).distinct()
    cand = materialize(cand)
    # only sets that some candidate needs travel to it
    needed = materialize(cand.select(F.explode(F.array("a", "b")).alias("rec_id")).distinct())
    sets = lookup_join(classes.select("rec_id", "n", "runs"), needed, ["rec_id"], "left_semi")
    both = cand.join(sets.select(F.col("rec_id").alias("a"), F.col("n").alias("na"), F.col("runs").alias("ra")), "a").join(sets.select(F.col("rec_id").alias("b"), F.col("n").alias("nb"), F.col("runs").alias("rb")), "b")
    shared = F.size(F.array_intersect("ra", "rb"))
    found = materialize(both.where(shared >= similarity * (F.col("na") + F.col("nb") - shared) - 1e-9).select("a", "b"))
    release(met, cand, needed)
    return found


def _prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Candidates among sets by the prefix filter: similar sets share one of their rarest n - ceil(similarity n) + 1 runs."""
    runs = sets.select("rec_id", "n", F.explode("runs").alias("run"))
    df = runs.groupBy("run").agg(F.count("*").alias("df")).where("df > 1")
    ranked = runs.join(df, "run", "left").withColumn("r", F.row_number().over(W.partitionBy("rec_id").orderBy(F.coalesce("df", F.lit(1)), "run")))
    kept = materialize(ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).where("df > 1").select("rec_id", "n", "run", "r", "df"))
    # of the runs a pair shares the prefix positions also bound the overlap that is left
    left, right = _in_parts(kept, "run", F.col("df"), "rec_id")
    met = left.alias("a").join(right.alias("b"), F.expr(f"a.run = b.run and a.i = b.i and a.j = b.j and (a.i < a.j or a.rec_id < b.rec_id) and {_fits(similarity)} and 1 + least(a.n - a.r, b.n - b.r) >= {similarity} / (1 + {similarity}) * (a.n + b.n) - least(a.r, b.r) + 1 - 1e-9"))
    return met.select(F.least("a.rec_id", "b.rec_id").alias("a"), F.greatest("a.rec_id", "b.rec_id").alias("b"))


def _in_parts(rows: DataFrame, key: str, size, member: str, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of the members of a key with one another: a large key is parted, and each pair of parts (i <= j) is a key of its own.

    Within a part (i = j) a pair of members meets in both orders, between parts in one.
    """
    r = rows.withColumn("parts", F.ceil(size / part).cast("int")).withColumn("p", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
    left = r.withColumn("i", F.col("p")).withColumn("j", F.explode(F.sequence(F.col("p"), F.col("parts") - 1)))
    right = r.withColumn("j", F.col("p")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p"))))
    return left.drop("parts", "p"), right.drop("parts", "p")


def _signed(records: DataFrame, id_col: str, text_col: str, tables: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all records (a repeated id counts once), (key_a, key_b, head, copies) of the distinct sets, and the signatures of their heads.

    Only ids and keys are shuffled: signatures of repeated ids and of copies are taken out by the list of them.
    """
    rows = records.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).cast("string").alias("t"))
    twice = materialize(rows.groupBy("rec_id").agg(F.count("*").alias("c")).where("c > 1 and rec_id is not null").select("rec_id"))
    if row_count(twice):
        again = lookup_join(rows, twice, ["rec_id"], "left_semi").groupBy("rec_id").agg(F.min("t").alias("t"))
        rows = lookup_join(rows, twice, ["rec_id"], "left_anti").union(again)
    signed = materialize(signatures(rows, "rec_id", "t", tables))
    classes = materialize(signed.groupBy("key_a", "key_b").agg(F.min("rec_id").alias("head"), F.count("*").alias("copies")))
    more = materialize(signed.select("rec_id", "key_a", "key_b").join(classes.where("copies > 1"), ["key_a", "key_b"]).where("rec_id <> head").select("rec_id"))
    heads = lookup_join(signed, more, ["rec_id"], "left_anti")
    return signed, classes, heads


def similar_pairs(records: DataFrame, similarity: float = SIMILARITY, id_col: str = "rec_id", text_col: str = "raw_vals", tables: int = TABLES, crowd: int = CROWD) -> DataFrame:
    """(rec_a, rec_b): all pairs rec_a < rec_b of records whose sets of runs share at least `similarity` of their union.

    Records with equal sets are one class while pairs are searched and are told apart only in the result; a class of many
    copies is expanded part by part. Null and empty texts, and texts of fewer than three values, have no runs and are in
    no pair. Repeated ids count once (the least text); other columns are not read. An empty table gives no rows.
    """
    signed, classes, heads = _signed(records, id_col, text_col, tables)
    pairs = class_pairs(heads, similarity, crowd)
    member = materialize(signed.select("key_a", "key_b", F.col("rec_id").alias("m")).join(classes.where("copies > 1"), ["key_a", "key_b"]).select("head", "copies", "m"))
    left, right = _in_parts(member, "head", F.col("copies"), "m")
    same = left.alias("a").join(right.alias("b"), F.expr("a.head = b.head and a.i = b.i and a.j = b.j and (a.i < a.j or a.m < b.m)")).select(F.least("a.m", "b.m").alias("rec_a"), F.greatest("a.m", "b.m").alias("rec_b"))
    out = pairs.select(F.col("a").alias("rec_a"), F.col("b").alias("rec_b"))
    # members take the place of their heads, a part of a class at a time
    salted = member.select("head", "m", F.pmod(F.xxhash64("m"), F.ceil(F.col("copies") / PART)).cast("int").alias("s"))
    parts = materialize(classes.where("copies > 1").select("head", F.ceil(F.col("copies") / PART).cast("int").alias("parts")))
    for end in ("rec_a", "rec_b"):
        spread = lookup_join(out.withColumn("head", F.col(end)), parts, ["head"], "left").withColumn("s", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
        out = spread.join(salted, ["head", "s"], "left").withColumn(end, F.coalesce("m", end)).select("rec_a", "rec_b")
    return same.union(out.select(F.least("rec_a", "rec_b").alias("rec_a"), F.greatest("rec_a", "rec_b").alias("rec_b")))


def similar_groups(records: DataFrame, similarity: float = SIMILARITY, id_col: str = "rec_id", text_col: str = "raw_vals", tables: int = TABLES, crowd: int = CROWD) -> DataFrame:
    """(rec_id, class_id, group_id, n_links): one row per record that has runs.

    class_id is the least record with the same set; group_id the least record linked directly or indirectly; n_links
    how many other records it is similar to, copies included. No pairs of copies are made.
    """
    signed, classes, heads = _signed(records, id_col, text_col, tables)
    pairs = class_pairs(heads, similarity, crowd)
    labels = star_labels(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    size = classes.select(F.col("head").alias("rec_id"), "copies")
    ends = pairs.select(F.col("a").alias("at"), F.col("b").alias("rec_id")).union(pairs.select(F.col("b").alias("at"), F.col("a").alias("rec_id")))
    links = ends.join(size, "rec_id").groupBy("at").agg(F.sum("copies").alias("l")).withColumnRenamed("at", "head")
    of = classes.join(labels.select(F.col("u").alias("head"), F.col("v").alias("root")), "head", "left").join(links, "head", "left")
    of = of.select("key_a", "key_b", F.col("head").alias("class_id"), F.coalesce("root", "head").alias("group_id"), (F.coalesce("l", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("rec_id", "key_a", "key_b").join(of, ["key_a", "key_b"]).select("rec_id", "class_id", "group_id", "n_links")
