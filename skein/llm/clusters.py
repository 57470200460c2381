"""Grouping records into similarity clusters by hierarchical density clustering.

1. Neighbour graph: the records are parted into blocks of even size, and every block meets itself and every other, so
   that every pair is compared once. Each meeting gives its minimum spanning tree, and the nearest of each record. A
   minimum spanning tree of the whole lies within the union of these trees, so no meeting has to emit its pairs.
2. A distributed Boruvka minimum spanning forest of that graph under mutual reachability.
3. Per tree: the condensed hierarchy, stability-based selection and each record's persistence in its cluster.
4. Exact clusters at a fixed similarity are cut from the forest and then checked against the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.components import star_labels
from skein.session import materialize, release, row_count

#: Records of a block. A vector goes to as many meetings as there are blocks; a meeting holds two matrices of this size.
BLOCK = 4_000
#: Edges below this cosine are left out: trees at that level are the roots of the hierarchy.
FLOOR = 0.6
#: Records, itself included, within a record's core distance; records that make up a density cluster.
MIN_POINTS, MIN_CLUSTER = 3, 3
#: Comparisons of blocks are in single precision: distances are off by less than this.
SLACK = 2e-6


def usable(table: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v): unit vectors. Vectors that are null, all 0, not dim long or hold a null, NaN or infinity take no part."""
    ok = F.expr(f"size(v) = {dim} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    one = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null").where(ok).groupBy("id").agg(F.min("v").alias("v"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy().reshape(b.num_rows, dim)
                v = v / np.abs(v).max(1, keepdims=True)
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dim, pa.int32()), pa.array(v.ravel()))], ["id", "v"])

    return one.mapInArrow(unit, "id long, v array<double>")


def _tree(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prim's minimum spanning tree of a dense distance matrix: (from, to) in order of joining."""
    n = len(w)
    near, src = w[0].copy(), np.zeros(n, np.int64)
    out = np.zeros(n, bool)
    out[0] = True
    a, b = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64)
    near[0] = np.inf
    for i in range(n - 1):
        j = int(near.argmin())
        a[i], b[i] = src[j], j
        out[j] = True
        near[j] = np.inf
        closer = (w[j] < near) & ~out
        near[closer], src[closer] = w[j][closer], j
    return a, b


def _cross_tree(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same between two sets: rows are points 0 to len(w) - 1, columns the points after them."""
    p, n = len(w), sum(w.shape)
    turned = np.ascontiguousarray(w.T)
    near, src = np.full(n, np.inf, w.dtype), np.zeros(n, np.int64)
    near[p:] = w[0]
    out = np.zeros(n, bool)
    out[0] = True
    a, b = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64)
    for i in range(n - 1):
        j = int(near.argmin())
        a[i], b[i] = src[j], j
        out[j] = True
        near[j] = np.inf
        row, side = (w[j], slice(p, n)) if j < p else (turned[j - p], slice(0, p))
        closer = (row < near[side]) & ~out[side]
        near[side][closer] = row[closer]
        src[side][closer] = j
    return a, b


def neighbour_edges(vecs: DataFrame, dim: int, bucket: int = BLOCK, floor: float = FLOOR, nearest: int = 1) -> DataFrame:
    """(u, v, w): distinct edges u > v of cosine distance w at most 1 - floor: trees of all blocks of `bucket` records with one another, and each record's nearest."""
    blocks = max(1, -(-row_count(vecs) // bucket))
    k = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    met = vecs.select("id", F.col("v").cast("array<float>").alias("v"), k.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"))
    work = met.select(F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "id", "v")

    def compare(key, t):
        i, j = (x.as_py() for x in key)
        ids, v = t["id"].to_numpy(), t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        own = t["k"].to_numpy() == i
        if len(ids) < 2 or (i != j and own.all() == own.any()):  # a block without records: nothing to compare
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "w": pa.array([], pa.float64())})
        who = np.concatenate((ids[own], ids[~own]))
        x = v[own]
        w = x @ (x if i == j else v[~own]).T
        np.maximum(np.subtract(1, w, out=w), 0, out=w)
        if i == j:
            np.fill_diagonal(w, np.inf)
        a, b = _tree(w) if i == j else _cross_tree(w)
        d = w[np.minimum(a, b), np.maximum(a, b) - (0 if i == j else len(w))]
        ends = [(a, b, d)]
        if nearest > 1:  # the trees hold everyone's nearest; further ones are added for the core distances
            for m, first, other in [(w, 0, 0)] if i == j else [(w, 0, len(w)), (w.T, len(w), 0)]:
                few = min(nearest, m.shape[1] - (i == j))
                b = np.argpartition(m, few - 1, axis=1)[:, :few]
                a = np.repeat(np.arange(len(m)), few)
                ends.append((a + first, b.ravel() + other, m[a, b.ravel()]))
        a, b, d = (np.concatenate(e) for e in zip(*ends))
        ok = d <= 1 - floor
        a, b = who[a[ok]], who[b[ok]]
        return pa.table({"u": np.maximum(a, b), "v": np.minimum(a, b), "w": d[ok].astype(np.float64)})

    return work.groupBy("i", "j").applyInArrow(compare, "u long, v long, w double").groupBy("u", "v").agg(F.min("w").alias("w"))


def boruvka(edges: DataFrame) -> DataFrame:
    """(u, v, w, comp): the minimum spanning forest of distinct edges u > v, and the least id of each edge's tree.

    In every round each tree picks its least outgoing edge (ties by u and v, so that no cycle can form) and trees that
    picked one another merge; trees at least halve in number.
    """
    now = materialize(edges.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")))
    forest: list[DataFrame] = []
    merges: list[DataFrame] = []
    while row_count(now):
        e = F.struct("w", "u", "v", "cu", "cv")
        least = now.select(F.explode(F.array("cu", "cv")).alias("c"), e.alias("e")).groupBy("c").agg(F.min("e").alias("e"))
        picked = materialize(least.select("e.*").distinct())
        forest.append(picked.select("u", "v", "w"))
        merged = star_labels(picked.select(F.greatest("cu", "cv").alias("u"), F.least("cu", "cv").alias("v")).distinct())
        merges.append(merged)
        after = materialize(_moved(_moved(now, "cu", merged), "cv", merged).where("cu <> cv"))
        release(now)
        now = after
    if not forest:
        return edges.sparkSession.createDataFrame([], "u long, v long, w double, comp long")
    tree = forest[0]
    for f in forest[1:]:
        tree = tree.union(f)
    tree = tree.withColumn("comp", F.col("u"))
    for merged in merges:
        tree = _moved(tree, "comp", merged)
    return tree.select("u", "v", "w", "comp")


def _moved(table: DataFrame, col: str, merged: DataFrame) -> DataFrame:
    """Column col replaced by the tree it went over to in a round."""
    to = merged.select(F.col("u").alias(col), F.col("v").alias("_root"))
    return table.join(to, col, "left").withColumn(col, F.coalesce("_root", col)).drop("_root")


class _Union:
    def __init__(self, n: int):
        self.p = list(range(n))

    def find(self, i: int) -> int:
        while self.p[i] != i:
            self.p[i] = self.p[self.p[i]]
            i = self.p[i]
        return i


def condense(a: np.ndarray, b: np.ndarray, w: np.ndarray, copies: np.ndarray, min_cluster: int) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """Cluster (-1: none) and persistence of each point of one tree, and the clusters' stabilities; points stand for copies.

    The single-linkage hierarchy is condensed: a split counts only if both sides have min_cluster points, else points
    fall out of their cluster at that density. A cluster is selected if it is more stable than its descendants together.
    """
    n = len(copies)
    order = np.argsort(w, kind="stable")
    uf = _Union(n)
    node = list(range(n))
    left, right, height, size = [-1] * n, [-1] * n, [0.0] * n, copies.tolist()
    for i in order.tolist():
        x, y = uf.find(int(a[i])), uf.find(int(b[i]))
        if x == y:
            continue
        left.append(node[x])
        right.append(node[y])
        height.append(float(w[i]))
        size.append(size[node[x]] + size[node[y]])
        uf.p[y] = x
        node[x] = len(left) - 1
    lam = lambda h: 1.0 / max(h, 1e-6)
    root = len(left) - 1
    birth, stab, kids = {0: 1.0 / max(height[root], 1e-6) if n > 1 else 0.0}, {0: 0.0}, {0: []}
    point, out_at = np.full(n, 0), np.zeros(n)
    stack, last = [(root, 0)], 0

    def drop(at: int, c: int, level: float) -> None:
        todo = [at]
        while todo:
            x = todo.pop()
            if x < n:
                point[x], out_at[x] = c, level
                stab[c] += size[x] * (level - birth[c])
            else:
                todo += [left[x], right[x]]

    while stack:
        x, c = stack.pop()
        if x < n:  # copies stay together down to distance 0
            drop(x, c, lam(0.0) if size[x] >= min_cluster else birth[c])
            continue
        level = lam(height[x])
        big = [y for y in (left[x], right[x]) if size[y] >= min_cluster]
        if len(big) == 2 and size[x] > 2 * min_cluster - 1 and min(lam(height[y]) for y in big if y >= n or size[y] > 1) > level * (1 + 1e-9):
            for y in big:
                last += 1
                birth[last], stab[last], kids[last] = level, 0.0, []
                kids[c].append(last)
                stab[c] += size[y] * (level - birth[c])
                stack.append((y, last))
            continue
        rest = [y for y in (left[x], right[x]) if size[y] < min_cluster]
        for y in rest:
            drop(y, c, level)
        if len(big) == 2:  # ties: neither side is denser than their join
            stack += [(y, c) for y in big]
        elif big:
            stack.append((big[0], c))
    best, chosen = dict(stab), {}
    for c in range(last, -1, -1):
        below = sum(best[k] for k in kids[c])
        chosen[c] = not kids[c] or stab[c] >= below
        best[c] = max(stab[c], below)
    of = {}
    todo = [(0, -1)]
    while todo:
        c, up = todo.pop()
        own = up if up >= 0 else c if chosen[c] else -1
        of[c] = own
        todo += [(k, own) for k in kids[c]]
    label = np.array([of[c] for c in point.tolist()])
    return label, out_at, {c: stab[c] for c in set(label.tolist()) if c >= 0}


def forest_of(table: DataFrame, id_col: str, vec_col: str, dim: int, min_points: int, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, head) of all records, (id, v, copies) of the heads, and the heads' mutual-reachability spanning forest.

    Records with equal unit vectors are one point, whose head is the least of them: any number of copies is one row from
    here on. Copies do not count towards min_points. All three tables are written to the shared folder.
    """
    all_ = materialize(usable(table, id_col, vec_col, dim).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v")))
    classes = materialize(all_.groupBy("k1", "k2").agg(F.min("id").alias("head"), F.count("*").alias("copies")))
    members = materialize(all_.select("id", "k1", "k2").join(classes, ["k1", "k2"]).select("id", "head"))
    vecs = materialize(all_.select("id", "v").join(classes.select(F.col("head").alias("id"), "copies"), "id"))
    graph = materialize(neighbour_edges(vecs, dim, nearest=min_points - 1, **how))
    if min_points <= 2:
        # the core distance is that of the nearest neighbour, which no edge of a record can undercut
        tree = materialize(boruvka(graph))
        release(all_, classes, graph)
        return members, vecs, tree
    both = graph.select(F.inline(F.array(F.struct("u", "w"), F.struct(F.col("v").alias("u"), "w"))))
    rank = F.row_number().over(W.partitionBy("u").orderBy("w"))
    kept = both.withColumn("r", rank).where(F.col("r") <= min_points - 1)
    # a record with fewer neighbours than that has no core: the floor stands for it
    core = materialize(kept.groupBy("u").agg(F.when(F.count("*") == min_points - 1, F.max("w")).otherwise(1 - how.get("floor", FLOOR)).alias("core")))
    edges = graph.join(core, "u").join(core.select(F.col("u").alias("v"), F.col("core").alias("core_v")), "v")
    tree = materialize(boruvka(edges.select("u", "v", F.greatest("w", "core", "core_v").alias("w"))))
    release(all_, classes, graph, core)
    return members, vecs, tree


def density_clusters(table: DataFrame, id_col: str = "mat_id", vec_col: str = "mat", dim: int = 378, min_cluster: int = MIN_CLUSTER, min_points: int = MIN_POINTS, exemplars: int = 3, **how) -> DataFrame:
    """(id, cluster_id, size, persistence, exemplar_rank): one row per record in a cluster.

    cluster_id is the least id of its cluster; the most persistent members (ties: smaller id) have exemplar_rank 1 to
    `exemplars`, the others null. Links below the cosine `floor` (FLOOR unless given) are dropped: the hierarchy is a forest cut
    there, looser clusters do not come out, and a record with fewer than min_points - 1 neighbours within it has the core
    distance 1 - floor. Records that take no part (see usable()) or are alone are not listed.
    """
    members, vecs, tree = forest_of(table, id_col, vec_col, dim, min_points, **how)

    def run(key, t):
        u, v, w, cu, cv = (t[c].to_numpy() for c in ("u", "v", "w", "cu", "cv"))
        ids, first, at = np.unique(np.concatenate((u, v)), return_index=True, return_inverse=True)
        label, persist, _ = condense(at[: len(u)], at[len(u) :], w, np.concatenate((cu, cv))[first], min_cluster)
        least = pd.Series(ids).groupby(label).transform("min").to_numpy()
        ok = label >= 0
        return pa.table({"head": ids[ok], "cluster_id": least[ok], "persistence": persist[ok]})

    size = vecs.select("id", "copies")
    sized = tree.join(size.select(F.col("id").alias("u"), F.col("copies").alias("cu")), "u").join(size.select(F.col("id").alias("v"), F.col("copies").alias("cv")), "v")
    alone = size.where(F.col("copies") >= min_cluster).join(tree.select(F.explode(F.array("u", "v")).alias("id")), "id", "left_anti").select(F.col("id").alias("head"), F.col("id").alias("cluster_id"), F.lit(1e6).alias("persistence"))
    # a task holds the edges (three numbers a record) of one tree, which unlike records never share
    got = sized.groupBy("comp").applyInArrow(run, "head long, cluster_id long, persistence double")
    sizes = materialize(got.union(alone).join(members, "head").select("id", "cluster_id", "persistence"))
    counted = sizes.join(sizes.groupBy("cluster_id").agg(F.count("*").alias("size")), "cluster_id")
    rank = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("persistence"), "id"))
    return counted.withColumn("r", rank).select(F.col("id").alias(id_col), "cluster_id", "size", "persistence", F.when(F.col("r") <= exemplars, F.col("r")).alias("exemplar_rank"))


def _chunk_pairs(members: DataFrame, rows: int) -> DataFrame:
    """(c, i, j, id, v, side): the chunks of each cluster, each meeting each once."""
    parts = members.groupBy("c").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    m = members.join(parts, "c").withColumn("k", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return m.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("c", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "id", "v", "k")


def alike_sets(table: DataFrame, similarity: float = 0.85, id_col: str = "mat_id", vec_col: str = "mat", dim: int = 378, rows: int = 1_000, **how) -> DataFrame:
    """(id, cluster): the sets of two or more records that are all alike and alike to no record outside; cluster is the least id.

    Two records are alike if the cosine of their vectors is at least `similarity`. The sets are the trees of the
    spanning forest cut at that similarity, for which every pair of records is compared, so that no link outside is missed; in each, all members are then compared: a set whose members all lie within
    half the angle of their mean is settled at once; of any other the member farthest from the mean is compared with all, and
    only if it is like all of them the set is compared in blocks, in double precision. Nulls, all-zero and unusable
    vectors take no part; an id counts once. An empty table gives no rows.
    """
    # with two points mutual reachability is the distance itself, so the forest cut there has exactly the alike as trees
    members, vecs, tree = forest_of(table, id_col, vec_col, dim, 2, **{"floor": similarity - 2 * SLACK} | how)
    near = tree.where(F.col("w") <= 1 - similarity + SLACK).select("u", "v")
    label = star_labels(near)
    roots = label.select(F.col("v").alias("id"), F.col("v").alias("c")).distinct()
    of = materialize(label.select(F.col("u").alias("id"), F.col("v").alias("c")).union(roots))
    chunks = of.groupBy("c").agg(F.ceil(F.count("*") / rows).alias("parts"))
    full = of.join(vecs.select("id", "v"), "id").join(chunks, "c").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts"))).select("id", "c", "v", "salt")

    def add(key, t):
        v = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        return pa.table({"c": pa.array([key[0].as_py()], pa.int64()), "s": pa.array([v.sum(0).tolist()], pa.list_(pa.float64()))})

    sums = full.select("c", "salt", "v").groupBy("c", "salt").applyInArrow(add, "c long, s array<double>")
    centre = materialize(sums.select("c", F.posexplode("s").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x")).groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("s")))

    def angle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, s = (b.column(k).flatten().to_numpy().reshape(-1, dim) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((v * s).sum(1) / np.linalg.norm(s, axis=1))], ["id", "c", "cos"])

    def nearness(to: DataFrame) -> DataFrame:
        """The least cosine of each set's members to the set's vector s, and the member that has it."""
        got = full.join(to, "c").select("id", "c", "v", "s").mapInArrow(angle, "id long, c long, cos double")
        return got.groupBy("c").agg(F.min("cos").alias("cos"), F.min_by("id", "cos").alias("far"))

    half = float(np.cos(np.arccos(similarity) / 2))
    settled = materialize(nearness(centre).withColumn("sure", F.col("cos") >= half + 1e-9))
    # most sets that are not all alike end here: their member farthest from the mean is unlike some other
    far = settled.where("not sure").select("c", F.col("far").alias("id")).join(vecs.select("id", F.col("v").alias("s")), "id").select("c", "s")
    open_ = materialize(nearness(far).where(F.col("cos") >= similarity - 1e-9).select("c"))
    doubt = full.select("id", "c", "v").join(open_, "c", "left_semi")

    def block(key, t):
        v = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        return pa.table({"c": pa.array([key[0].as_py()], pa.int64()), "least": [float((v @ v.T).min())]})

    checked = _chunk_pairs(doubt, rows).groupBy("c", "i", "j").applyInArrow(block, "c long, least double").groupBy("c").agg(F.min("least").alias("least"))
    good = settled.where("sure").select("c").union(checked.where(F.col("least") >= similarity - 1e-9).select("c"))
    heads = of.join(good, "c", "left_semi").select(F.col("id").alias("head"), "c")
    # copies of a record that is alike to nothing else are a set of their own
    copies = vecs.where("copies > 1").select("id").join(of, "id", "left_anti").select(F.col("id").alias("head"), F.col("id").alias("c"))
    return members.join(heads.union(copies), "head").select(F.col("id").alias(id_col), F.col("c").alias("cluster_mat"))
