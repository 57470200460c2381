"""Evaluation texts leaking into training text: suffix arrays over shards of the corpus, searched by every test suffix.

Each slice of a partition is one shard. Its suffix array is sparse: a suffix can only match a test suffix for n words if
its first three words, and the three that end that stretch, occur as trigrams in the test set, so only such suffixes
are sorted; every other suffix would fall outside every search range. How far a match goes is found by doubling and
halving over prefix hashes, for all matches at once. The corpus is read and hashed once, whatever the size of the test
set, and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.tokens import Slice, _powers, mix, slices, span_hash, word_spans

#: Test items are searched in blocks of about this many characters; a shard meets one block after another.
BLOCK_CHARS = 2_000_000


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their text number, and their first and last units in the lower-cased texts."""
    s = Slice([t.lower() for t in texts])
    starts, ends, doc = word_spans(s)
    return span_hash(s.units, starts, ends), doc, starts - s.offs[doc], ends - s.offs[doc]


def _trigrams(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A key for the three words from each position (0 where fewer are left in its text)."""
    out = np.zeros(len(h), np.uint64)
    if len(h) >= 3:
        with np.errstate(over="ignore"):
            k = mix(h[:-2] * np.uint64(3) + mix(h[1:-1] * np.uint64(5) + mix(h[2:])))
        out[:-2] = np.where(doc[:-2] == doc[2:], k | np.uint64(1), 0)
    return out


def _keys(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n words from each position as one sortable byte string."""
    rows = h[at[:, None] + np.arange(n)].astype(">u8")
    return np.ascontiguousarray(rows).view(f"S{8 * n}").ravel()


def _prefixes(h: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the word hashes: equal stretches of words have equal differences, scaled alike."""
    out = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(h * _powers(len(h) + 1)[0][: len(h)], out=out[1:])
    return out


def _stretch(pre: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (pre[at + k] - pre[at]) * _powers(len(pre))[1][at]


def match_lengths(pre_a: np.ndarray, a: np.ndarray, pre_b: np.ndarray, b: np.ndarray, least: int, most: np.ndarray) -> np.ndarray:
    """How many words agree from a and from b on, between least (known to agree) and most."""
    lo, hi = np.full(len(a), least, np.int64), most.astype(np.int64)
    while (lo < hi).any():
        mid = np.minimum((lo + hi + 1) // 2, 2 * lo)  # doubling first: most matches are short
        mid = np.maximum(mid, np.minimum(lo + 1, hi))
        same = _stretch(pre_a, a, mid) == _stretch(pre_b, b, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


class Shard:
    """The words of a slice of the corpus."""

    def __init__(self, texts: list[str]):
        self.h, self.doc, self.first, self.last = words_of(texts)
        self.tri = _trigrams(self.h, self.doc)
        self.pre = _prefixes(self.h)
        self.end = np.searchsorted(self.doc, self.doc, "right")


class TestSet:
    """The suffixes of a block of test items."""

    def __init__(self, ids: list, texts: list[str], n: int):
        self.n, self.ids = n, ids
        self.h, self.doc, _, _ = words_of(texts)
        tri = _trigrams(self.h, self.doc)
        self.tri = np.unique(tri[tri != 0])
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.tri >> np.uint64(42)).astype(np.int64)] = True
        m = len(self.h) - n + 1
        at = np.arange(max(m, 0))
        self.at = at[self.doc[at] == self.doc[at + n - 1]] if m > 0 else at
        self.pre = _prefixes(self.h)
        self.begin, self.end = (np.searchsorted(self.doc, self.doc, side) for side in ("left", "right"))

    def search(self, c: Shard) -> tuple[np.ndarray, ...]:
        """(text, item, item_word, first unit, last unit, words) of each longest match that cannot be extended, as arrays."""
        n = self.n
        none = (np.zeros(0, np.int64),) * 6
        if len(c.h) < n or not len(self.at):
            return none
        may = np.flatnonzero(self.bits[(c.tri >> np.uint64(42)).astype(np.int64)] & (c.tri != 0))
        may = may[self.tri[np.minimum(np.searchsorted(self.tri, c.tri[may]), len(self.tri) - 1)] == c.tri[may]]
        known = np.zeros(len(c.h), bool)
        known[may] = True
        at = may[may + n <= len(c.h)]
        at = at[(c.doc[at] == c.doc[at + n - 1]) & known[at + n - 3]]
        if not len(at):
            return none
        keys = _keys(c.h, at, n)
        order = np.argsort(keys, kind="stable")  # the shard's suffix array
        keys, at = keys[order], at[order]
        wanted = _keys(self.h, self.at, n)
        lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        hits = hi - lo
        q = np.repeat(self.at, hits)
        p = at[np.repeat(lo - np.cumsum(hits) + hits, hits) + np.arange(int(hits.sum()))]
        # what goes on to the left is part of a match that begins earlier
        inner = (q > self.begin[q]) & (p > 0)
        inner &= (c.doc[np.maximum(p, 1) - 1] == c.doc[p]) & (self.h[np.maximum(q, 1) - 1] == c.h[np.maximum(p, 1) - 1])
        q, p = q[~inner], p[~inner]
        k = match_lengths(self.pre, q, c.pre, p, n, np.minimum(self.end[q] - q, c.end[p] - p))
        return c.doc[p], self.doc[q], q - self.begin[q], c.first[p], c.last[p + k - 1], k


def _units_of(text: str) -> np.ndarray | None:
    """For a text whose lower-cased form is longer, the place in it of each unit of that form."""
    low = text.lower()
    if len(low) == len(text):
        return None
    sizes = np.array([len(x.lower()) for x in text])
    return np.repeat(np.arange(len(text)), sizes)


def leaked_passages(documents: DataFrame, items: DataFrame, n_words: int = 12, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, item_word, start_char, end_char, n_words): the longest verbatim matches of n_words words or more.

    Words are the longest runs of a-z and 0-9 of the lower-cased text; offsets count in the text itself. A match is reported
    once, from its first word; a passage that stands several times gives several rows. Null and empty texts, and items
    of fewer than n_words words, match nothing. Repeated document rows report for themselves; other columns are not read.
    The items go to every task, block by block; documents are read once.
    """
    test = items.select(F.col(item_id).alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null and id is not null")
    schema = T.StructType([
        T.StructField(doc_id, documents.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType), T.StructField("item_word", T.IntegerType()),
        T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("n_words", T.IntegerType()),
    ])
    id_type = pa.int64() if isinstance(items.schema[item_id].dataType, T.LongType) else None
    blocks, ids, texts, size = [], [], [], 0
    send = documents.sparkSession.sparkContext.broadcast
    for r in test.toLocalIterator():  # the items, a part at a time; each full block leaves the driver as files
        ids.append(r["id"])
        texts.append(r["text"])
        size += len(r["text"])
        if size >= block_chars:
            blocks.append(send(TestSet(ids, texts, n_words)))
            ids, texts, size = [], [], 0
    if ids or not blocks:
        blocks.append(send(TestSet(ids, texts, n_words)))
    read = documents.select(F.col(doc_id), F.col(text).cast("string")).where(F.col(text).isNotNull())
    return read.mapInArrow(_searcher(blocks, id_type, schema.names), schema)


def _searcher(blocks: list, id_type, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in slices(b.column(1).to_pylist()):
                shard = Shard(texts)
                for block in blocks:
                    test = block.value
                    d, t, w, s, e, k = test.search(shard)
                    if not len(d):
                        continue
                    s, e = s.copy(), e.copy()
                    for x in np.unique(d).tolist():
                        units = _units_of(texts[x])
                        if units is not None:
                            s[d == x], e[d == x] = units[s[d == x]], units[e[d == x] - 1] + 1
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(i, j - i).take(pa.array(d)), pa.array([test.ids[x] for x in t.tolist()], id_type), pa.array(w, pa.int32()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(k, pa.int32())],
                        names,
                    )

    return run


def leaks(documents: DataFrame, items: DataFrame, n_words: int = 12) -> DataFrame:
    """(doc_id, item_id): distinct; each document that holds n_words or more consecutive words of an item."""
    return leaked_passages(documents, items, n_words).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame, n_words: int = 12) -> DataFrame:
    """The documents that hold no passage of any item."""
    return documents.join(leaks(documents, items, n_words).select("doc_id").distinct(), "doc_id", "left_anti")
