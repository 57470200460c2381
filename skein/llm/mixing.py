"""Mixing sources to target weights: token blocks, per-shard draws and keyed index permutations, joined by index.

Nothing moves but numbers: documents are counted where they are read, their token ranges are placed by two-level
prefix sums (no task sees a whole source), and every output slot finds its block by a pseudorandom permutation that is
computed, not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.tokens import count_tokens, counter, default_vocabulary, mix
from skein.session import lookup_join, materialize

BLOCK_TOKENS, SHARD_BLOCKS = 512, 64
#: Documents of one source are placed in groups of about this many, each ordered by one task.
GROUP_ROWS = 50_000
#: Output shards are numbered in runs of this many; slots are counted within a run, then over the runs.
RUN_SHARDS = 10_000


def token_sizes(documents: DataFrame, id_col: str, vocabulary: str, keep: list[str]) -> DataFrame:
    """(id, keep..., n_tokens): the size of each text under the vocabulary; null texts have size 0."""

    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(texts.fillna("").tolist(), vocabulary))

    return documents.select(id_col, *keep, size(F.col("text").cast("string")).alias("n_tokens"))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 (per element), by a four-round Feistel network with cycle walking."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            x, h, m, k = out[todo], half[todo], low[todo], key[todo]
            a, b = x >> h, x & m
            for r in range(4):
                a, b = b, a ^ (mix(b + k + np.uint64(r * 0x9E3779B97F4A7C15 & (2**64 - 1))) & m)
            out[todo] = (a << h) | b
            todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def shard_counts(shards: np.ndarray, shares: np.ndarray, blocks: np.ndarray, seed: int) -> np.ndarray:
    """Blocks of each source in each shard: a multinomial draw of the shard's slots at the target shares."""
    out = np.zeros((len(shards), len(shares)), np.int64)
    for i, (shard, n) in enumerate(zip(shards.tolist(), blocks.tolist())):
        out[i] = np.random.default_rng([seed, shard]).multinomial(n, shares)
    return out


def place_documents(sizes: DataFrame, block_tokens: int, seed: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(source, doc_id, first, n_tokens): each document's range in the token sequence of its source."""
    groups = max(1, -(-sizes.count() // group_rows))
    g = sizes.where("n_tokens > 0").withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("g", F.pmod(F.col("h"), F.lit(groups)))
    totals = g.groupBy("source", "g").agg(F.sum("n_tokens").alias("t"))
    base = totals.select("source", "g", (F.sum("t").over(W.partitionBy("source").orderBy("g")) - F.col("t")).alias("base"))
    inside = F.sum("n_tokens").over(W.partitionBy("source", "g").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    return g.withColumn("inside", inside).join(base, ["source", "g"]).select("source", "doc_id", (F.col("base") + F.col("inside")).alias("first"), "n_tokens")


def _plan(totals: dict[str, int], targets: list, block_tokens: int, total_tokens: int | None) -> list[dict]:
    """The sources that can be used, with share, blocks, repeats and cap, and the size at which draws are begun."""
    rows = [t for t in targets if t["source"] is not None and (t["target_share"] or 0) > 0 and totals.get(t["source"], 0) > 0 and (t["max_repeats"] or 0) > 0]
    weight = sum(t["target_share"] for t in rows)
    plan = [{"source": t["source"], "share": t["target_share"] / weight, "repeats": int(t["max_repeats"]), "blocks": -(-totals[t["source"]] // block_tokens)} for t in rows]
    plan = [p | {"cap": p["repeats"] * p["blocks"]} for p in plan]
    # four deviations of a source's draw beyond its cap: where the draws reach it is found from the draws themselves
    most = min(((p["cap"] + 4 * p["cap"] ** 0.5 + 4) / p["share"] for p in plan), default=0)
    size = int(most if total_tokens is None else min(most, total_tokens / block_tokens))
    return [p | {"size": size} for p in plan]


def _first_over(runs: DataFrame, plan: list[dict], by: str, before: dict[str, int]) -> tuple[int | None, dict[str, int]]:
    """The first value of column `by` at which some source's draws (source, by, t) pass its cap, and each source's draws before it."""
    cum = F.sum("t").over(W.partitionBy("source").orderBy(by))
    caps = F.create_map(*[F.lit(x) for p in plan for x in (p["source"], p["cap"] - before.get(p["source"], 0))])
    table = runs.withColumn("upto", cum)
    first = table.where(F.col("upto") > F.try_element_at(caps, F.col("source"))).agg(F.min(by)).first()[0]
    if first is None:
        return None, before
    own = {r["source"]: r["t"] for r in runs.where(F.col(by) < first).groupBy("source").agg(F.sum("t").alias("t")).collect()}  # a line per source
    return first, {p["source"]: before.get(p["source"], 0) + own.get(p["source"], 0) for p in plan}


def mix_sources(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, total_tokens: int | None = None, seed: int = 17) -> DataFrame:
    """(shard, slot, source, block, epoch, doc_id, from_token, n_tokens, at): the mix, as token ranges of documents from place `at` of their block.

    Each source's documents are packed into blocks of block_tokens (the last may be shorter). A shard has shard_blocks
    slots; each slot holds one block, made of the listed ranges. A block is used at most max_repeats times, once per
    epoch, so no token of a document is used more often. packed_blocks() turns the ranges into token ids. Without total_tokens the mix is as large as the caps allow: it ends
    with the last shard before the one whose draw would pass a source's cap, and every slot up to there is filled. Documents with a null or untargeted source, and null or empty texts, take no part; a target
    source without any tokens is left out and the other shares are scaled up. Repeated rows count each for themselves.
    Empty tables give no rows.
    """
    vocabulary = vocabulary or default_vocabulary()
    wanted = targets.select("source", "target_share", "max_repeats").collect()  # a line per source: a parameter, not data
    sizes = materialize(token_sizes(documents.where(F.col("source").isin([t["source"] for t in wanted if t["source"] is not None])), "doc_id", vocabulary, ["source"]))
    totals = {r["source"]: r["t"] for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    plan = _plan(totals, wanted, block_tokens, total_tokens)
    spark = documents.sparkSession
    n_blocks = plan[0]["size"] if plan else 0
    names, shares = [p["source"] for p in plan], np.array([p["share"] for p in plan])

    def draws(n_blocks: int) -> DataFrame:
        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                shard = b.column(0).to_numpy()
                left = np.minimum(shard_blocks, n_blocks - shard * shard_blocks)
                n = shard_counts(shard, shares, left, seed)
                first = np.cumsum(n, axis=1) - n
                k = len(names)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(shard, k)), pa.array(names * len(shard)), pa.array(n.ravel()), pa.array(first.ravel())], ["shard", "source", "n", "slot"])

        n_shards = -(-n_blocks // shard_blocks)
        return spark.range(0, n_shards, 1, max(1, min(1000, n_shards // 500 + 1))).mapInArrow(draw, "shard long, source string, n long, slot long").where("n > 0")

    if n_blocks:
        # the draws are fitted to the caps before any slot is mapped: first the run that passes one, then the shard in it
        all_ = draws(n_blocks).withColumn("run", F.expr(f"shard div {RUN_SHARDS}"))
        run, before = _first_over(materialize(all_.groupBy("source", "run").agg(F.sum("n").alias("t"))), plan, "run", {})
        if run is not None:
            shard, _ = _first_over(all_.where(F.col("run") == run).select("source", "shard", F.col("n").alias("t")), plan, "shard", before)
            n_blocks = shard * shard_blocks
        if not n_blocks:  # not even one shard of that size: the largest part of it that keeps the caps
            n = np.array([shard_counts(np.zeros(1, int), shares, np.array([k]), seed)[0] for k in range(shard_blocks + 1)])
            n_blocks = int(np.flatnonzero((n <= [p["cap"] for p in plan]).all(1)).max())
    counts = draws(n_blocks).withColumn("run", F.expr(f"shard div {RUN_SHARDS}"))
    runs = counts.groupBy("source", "run").agg(F.sum("n").alias("t"))
    base = runs.select("source", "run", (F.sum("t").over(W.partitionBy("source").orderBy("run")) - F.col("t")).alias("base"))
    inside = F.sum("n").over(W.partitionBy("source", "run").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    ordered = lookup_join(counts.withColumn("inside", inside), base, ["source", "run"]).select("shard", "source", "n", "slot", (F.col("base") + F.col("inside")).alias("at"))
    of = {p["source"]: (i, p["blocks"]) for i, p in enumerate(plan)}

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            info = np.array([of[s] for s in b.column(1).to_pylist()], np.int64).reshape(-1, 2)[row]
            j = b.column(4).to_numpy()[row] + within
            epoch = j // info[:, 1]
            key = mix((info[:, 0] * 1_000_003 + epoch * 7919 + seed).astype(np.uint64))
            block = permute(j % info[:, 1], info[:, 1], key)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array((b.column(3).to_numpy()[row] + within).astype(np.int32)), b.column(1).take(pa.array(row)), pa.array(block), pa.array(epoch.astype(np.int32))],
                ["shard", "slot", "source", "block", "epoch"],
            )

    drawn = ordered.mapInArrow(slots, "shard long, slot int, source string, block long, epoch int")
    docs = place_documents(sizes, block_tokens, seed)
    last = F.col("first") + F.col("n_tokens")
    pieces = (
        docs.withColumn("block", F.explode(F.sequence(F.expr(f"first div {block_tokens}"), F.expr(f"(first + n_tokens - 1) div {block_tokens}"))))
        .withColumn("lo", F.greatest("first", F.col("block") * block_tokens))
        .select("source", "block", "doc_id", (F.col("lo") - F.col("first")).alias("from_token"), (F.least(last, (F.col("block") + 1) * block_tokens) - F.col("lo")).alias("n_tokens"), (F.col("lo") - F.col("block") * block_tokens).alias("at"))
    )
    # the planner takes the drawn slots for few, as they come from a short range: both sides are shuffled
    return drawn.hint("merge").join(pieces, ["source", "block"]).select("shard", "slot", "source", "block", "epoch", "doc_id", "from_token", "n_tokens", "at")


def packed_blocks(mixed: DataFrame, documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(shard, slot, source, block, tokens): the slots of a mix as packed token ids, in order.

    A document goes once to its ranges and is encoded once, however many slots it fills; ids of documents must be unique.
    """
    vocabulary = vocabulary or default_vocabulary()
    where = F.struct("shard", "slot", "source", "block", "epoch", "from_token", "n_tokens", "at")
    own = mixed.groupBy("doc_id").agg(F.collect_list(where).alias("ranges"))  # no more than a document has blocks, times its uses
    wanted = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(own, "doc_id")
    schema = "shard long, slot int, source string, block long, at long, tokens array<int>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            out: list = []
            for text, ranges in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = c.encode(text)
                out += [(r["shard"], r["slot"], r["source"], r["block"], r["at"], ids[r["from_token"] : r["from_token"] + r["n_tokens"]]) for r in ranges]
            if out:
                cols = zip(*out)
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["shard", "slot", "source", "block", "at", "tokens"])

    cut = wanted.select("text", "ranges").mapInArrow(encode, schema)
    parts = F.array_sort(F.collect_list(F.struct("at", "tokens")))  # the ranges of one block
    return cut.groupBy("shard", "slot", "source", "block").agg(F.flatten(F.transform(parts, lambda x: x["tokens"])).alias("tokens"))


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_slots, most_uses): what the mix reached, for every target source."""
    mixed = materialize(mixed)
    use = mixed.groupBy("source", "doc_id", "from_token").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("n"))
    by = use.groupBy("source").agg(F.sum("n").alias("n_tokens"), F.max("uses").alias("most_uses"))
    slots = mixed.groupBy("source", "shard").agg(F.count_distinct("slot").alias("k")).groupBy("source").agg(F.sum("k").alias("n_slots"))
    total = F.sum("n_tokens").over(W.partitionBy())  # one row per source is left here
    got = by.withColumn("actual_share", F.col("n_tokens") / total).join(slots, "source")
    zero = lambda c, t: F.coalesce(c, F.lit(0).cast(t)).alias(c)
    return targets.select("source", "target_share").join(got, "source", "left").select("source", "target_share", zero("actual_share", "double"), zero("n_tokens", "long"), zero("n_slots", "long"), zero("most_uses", "long"))
