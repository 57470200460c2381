"""Incremental candidate pairs: the bucket join as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: Pairs that are put together at once.
PAIRS = 1_000_000


class PairEmitter(StatefulProcessor):
    """Keeps the members of one (table_id, code) bucket; each arrival is paired with all earlier members."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.members = handle.getListState("members", "item long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = np.fromiter((m[0] for m in self.members.get()), np.int64) if self.members.exists() else np.zeros(0, np.int64)
        for pdf in rows:
            fresh = np.setdiff1d(pdf["item"].dropna().to_numpy().astype(np.int64), held)
            # each arrival meets all earlier members, a bounded number of pairs at a time
            step = max(1, PAIRS // max(1, len(held) + len(fresh)))
            for i in range(0, len(fresh), step):
                new = fresh[i : i + step]
                a, b = np.repeat(new, len(held)), np.tile(held, len(new))
                j, k = np.triu_indices(len(new), 1)
                a, b = np.concatenate((a, new[j])), np.concatenate((b, new[k]))
                if len(a):
                    yield pd.DataFrame({"table_id": key[0], "code": key[1], "id1": np.minimum(a, b), "id2": np.maximum(a, b)})
                held = np.concatenate((held, new))
            if len(fresh):
                self.members.appendList([(int(x),) for x in fresh])

    def close(self) -> None:
        pass


def stream_pairs(codes: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(table_id, code, id1, id2) of a stream of codes (item, table_id, code); needs the RocksDB state store.

    Pairs are oriented id1 < id2, whatever the order of arrival, so the union of all batches is what candidate_pairs()
    gives for the whole. An item that arrives again in a bucket gives no new pairs. Members are kept for the life of the
    query, unless ttl_ms lets them go after that time.
    """
    return codes.groupBy("table_id", "code").transformWithStateInPandas(PairEmitter(ttl_ms), "table_id int, code long, id1 long, id2 long", "append", "none" if ttl_ms is None else "processingTime")


def pairs_available_now(codes: DataFrame, out_dir: str, checkpoint_dir: str) -> DataFrame:
    """Run the stream over everything that is there now, and read its sink."""
    spark = codes.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream_pairs(codes).writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema("table_id int, code long, id1 long, id2 long").parquet(out_dir)
