"""Most similar vectors for every vector: a navigable small-world graph per shard, shard results merged.

Shards are cells of coarse centroids (fitted on a bounded sample; every vector is indexed), and crowded cells are split
further. A vector searches its own shard first; the distance it finds bounds how far a better one can be, and it then
visits, of the other cells that reach within that distance of it, the few nearest. So the work for a vector does not grow
with the number of shards.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.graph_index import SEARCH_BEAM, Graph
from skein.session import lookup_join, materialize, release, row_count

#: Vectors of a shard; rows of the sample that centroids are fitted on, at least and at most; queries that one task puts to a shard.
SHARD_ROWS, FIT_ROWS, MOST_FIT_ROWS, CHUNK_QUERIES = 8_000, 20_000, 100_000, 8_000
#: Cells at most, which bounds what every task needs to know of them; beyond that cells hold several shards each.
MAX_CELLS = 10_000
#: Other cells that a vector visits at most: recall lost by it is measured in README. One that found fewer than k visits all.
PROBES = 4
#: Candidates of each shard that are measured exactly.
SPARE = 5
INDEX = "shard long, ids array<long>, vecs array<double>, rows array<int>, shape array<int>, links array<int>"


def usable_vectors(table: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v): one row per id with dim finite values; of repeated ids the least vector counts."""
    good = F.expr(f"size(v) = {dim} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null").where(good).groupBy("id").agg(F.min("v").alias("v"))


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Lloyd's k-means on the sample."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        at = ((c * c).sum(1)[None] - 2 * sample @ c.T).argmin(1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _parts(batches, rows: int = 2_000):
    """Batches in parts that stay small when compared with every centroid."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _vectors(col, dim: int) -> np.ndarray:
    return np.asarray(np.concatenate(col.to_list()) if len(col) else np.zeros(0), float).reshape(-1, dim)


def _exact(q: np.ndarray, rows: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    d = ((q[:, None, :] - vecs[np.maximum(rows, 0)]) ** 2).sum(2)
    return np.sqrt(np.where(rows >= 0, d, np.inf))


def nearest(table: DataFrame, k: int = 5, id_col: str = "item", vec_col: str = "vals", dim: int = 64, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM, probes: int = PROBES) -> DataFrame:
    """(item, neighbour, distance, rank): the k nearest other items of every usable item, by Euclidean distance.

    At equal distance the smaller item comes first. Items with equal vectors share one place in the index and are told
    apart only in the result, so that any number of copies is searched once. Vectors that are null, not dim long, or
    hold a null, NaN or infinity take no part; an item counts once. With k or fewer other items all of them come out.
    An empty table gives no rows; other columns are not read.
    """
    spark = table.sparkSession
    items = materialize(usable_vectors(table, id_col, vec_col, dim).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v")))
    order = W.partitionBy("k1", "k2").orderBy("id")
    # the k + 1 least items of each class are all that any answer can use
    few = materialize(items.select("k1", "k2", "id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1))
    heads = materialize(items.join(few.where("r = 1").select("id"), "id").select("id", "v"))
    n = row_count(heads)
    cells = min(MAX_CELLS, max(1, math.ceil(n / shard_rows)))
    sample = np.array([r["v"] for r in heads.orderBy(F.xxhash64("id"), "id").limit(min(MOST_FIT_ROWS, max(FIT_ROWS, 10 * cells))).select("v").collect()], float).reshape(-1, dim)
    cent = fit_centroids(sample, cells) if len(sample) else np.zeros((1, dim))
    c2 = (cent * cent).sum(1)

    def cell_of(batches):
        for b in _parts(batches):
            if b.num_rows:
                v = b.column(1).flatten().to_numpy().reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((c2[None] - 2 * v @ cent.T).argmin(1).astype(np.int32))], ["id", "v", "cell"])

    placed = materialize(heads.mapInArrow(cell_of, "id long, v array<double>, cell int"))
    parts = {r["cell"]: max(1, math.ceil(r["c"] / (1.5 * shard_rows))) for r in placed.groupBy("cell").agg(F.count("*").alias("c")).collect()}  # one row per centroid
    splits = spark.createDataFrame([(c, p) for c, p in parts.items()] or [(0, 1)], "cell int, parts int")
    sharded = placed.join(F.broadcast(splits), "cell").select("id", "v", "cell", (F.col("cell").cast("long") * 1_000_000 + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("shard"))

    def build(key, pdf):
        v = _vectors(pdf["v"], dim)
        g = Graph.build(v)
        rows, shape, links = g.flat()
        return pd.DataFrame({"shard": [key[0]], "ids": [pdf["id"].to_numpy()], "vecs": [v.ravel()], "rows": [rows], "shape": [shape], "links": [links]})

    index = materialize(sharded.groupBy("shard").applyInPandas(build, INDEX))
    pair = "q long, hit long, d double"

    def look(ix: pd.Series, q: np.ndarray, qid: np.ndarray) -> pd.DataFrame:
        v = np.asarray(ix["vecs"], float).reshape(-1, dim)
        ids = np.asarray(ix["ids"])
        g = Graph.from_flat(v, np.asarray(ix["rows"]), np.asarray(ix["shape"]), np.asarray(ix["links"]))
        rows, _ = g.search(q, k + 1 + SPARE, beam)
        d = np.concatenate([_exact(q[i : i + 1000], rows[i : i + 1000], v) for i in range(0, len(q), 1000)]) if len(q) else np.zeros((0, k + 1 + SPARE))
        hit = np.where(rows >= 0, ids[np.maximum(rows, 0)], -1)
        d[hit == qid[:, None]] = np.inf  # itself
        o = np.lexsort((hit, d), axis=1)[:, :k]
        d, hit = np.take_along_axis(d, o, 1), np.take_along_axis(hit, o, 1)
        r, c = np.nonzero(np.isfinite(d))
        return pd.DataFrame({"q": qid[r], "hit": hit[r, c], "d": d[r, c]})

    def home(batches):
        for pdf in batches:
            for _, ix in pdf.iterrows():
                yield look(ix, np.asarray(ix["vecs"], float).reshape(-1, dim), np.asarray(ix["ids"]))

    # one index row at a time: a row holds a whole shard
    first = materialize(index.repartition("shard").mapInPandas(home, pair))
    reach = first.groupBy("q").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("u"))

    def visits(batches):
        for b in _parts(batches):
            v = b.column(1).flatten().to_numpy().reshape(-1, dim)
            cell, shard, u = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            d2 = np.maximum((v * v).sum(1)[:, None] + c2[None] - 2 * v @ cent.T, 0)
            own = d2[np.arange(len(v)), cell]
            # no vector of another cell is nearer than the plane midway between the two centroids
            gap = np.sqrt(np.maximum(c2[cell][:, None] + c2[None] - 2 * cent[cell] @ cent.T, 1e-18))
            far = (d2 - own[:, None]) / (2 * gap)
            far[np.arange(len(v)), cell] = -np.inf
            d2[far > u[:, None] + 1e-9] = np.inf
            d2[np.arange(len(v)), cell] = -1.0
            if probes + 1 < len(cent):
                bound = np.partition(d2, probes, axis=1)[:, probes]
                d2[(d2 > bound[:, None]) & np.isfinite(u)[:, None]] = np.inf
            r, c = np.nonzero(np.isfinite(d2))
            n_parts = np.array([parts.get(x, 0) for x in range(len(cent))])[c]
            r, c, sub = np.repeat(r, n_parts), np.repeat(c, n_parts), np.concatenate([np.arange(x) for x in n_parts.tolist()] or [np.zeros(0)]).astype(np.int64)
            to = c.astype(np.int64) * 1_000_000 + sub
            ok = to != shard[r]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r[ok])), b.column(1).take(pa.array(r[ok])), pa.array(to[ok])], ["q", "v", "shard"])

    calls = materialize(sharded.join(reach, F.col("id") == F.col("q"), "left").select("id", "v", "cell", "shard", F.coalesce("u", F.lit(float("inf"))).alias("u")).mapInArrow(visits, "q long, v array<double>, shard long"))
    calls_ = calls
    load = calls.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("chunks"))
    calls = lookup_join(calls, load, ["shard"]).withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int"))
    copies = index.join(load, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def away(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"q": np.zeros(0, np.int64), "hit": np.zeros(0, np.int64), "d": np.zeros(0)})
        return look(right.iloc[0], _vectors(left["v"], dim), left["q"].to_numpy())

    second = calls.select("shard", "chunk", "q", "v").groupBy("shard", "chunk").cogroup(copies.drop("chunks").groupBy("shard", "chunk")).applyInPandas(away, pair)
    by_class = materialize(first.union(second).withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("d", "hit"))).where(F.col("r") <= k).select("q", "hit", "d"))
    release(heads, placed, index, first, calls_)
    # from classes back to items
    member = items.select("k1", "k2", F.col("id").alias("item"))
    head = few.where("r = 1").select("k1", "k2", F.col("id").alias("head"))
    same = member.join(few.select("k1", "k2", F.col("id").alias("neighbour")), ["k1", "k2"]).where("item <> neighbour").select("item", "neighbour", F.lit(0.0).alias("distance"))
    listed = few.join(head, ["k1", "k2"]).select(F.col("head").alias("hit"), F.col("id").alias("neighbour"))
    other = member.join(head, ["k1", "k2"]).join(by_class, F.col("head") == F.col("q")).select("item", "hit", "d").join(listed, "hit").select("item", "neighbour", F.col("d").alias("distance"))
    best = same.union(other).withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy("distance", "neighbour")))
    return best.where(F.col("rank") <= k).select("item", "neighbour", "distance", "rank")


def nearest_pairs(table: DataFrame, k: int = 5, **how) -> DataFrame:
    """(item_a, item_b): distinct pairs item_a < item_b of which one is among the k nearest of the other."""
    near = nearest(table, k, **how)
    return near.select(F.least("item", "neighbour").alias("item_a"), F.greatest("item", "neighbour").alias("item_b")).distinct()
