"""Splitting oversized texts at natural boundaries, by lexical cohesion.

Natural boundaries (sections, paragraphs, formula and sentence ends) part a text into units. The vocabulary of the
units before a boundary is compared with that of the units after it; a valley of that similarity marks a change of
topic. Each piece ends at the deepest valley within its size window, and the next one starts early enough to overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.tokens import LETTER, Slice, count_tokens, counter, default_vocabulary, pretokens, slices, span_hash

KINDS = ["end", "token", "sentence", "formula", "paragraph", "section"]
#: What the kind of a boundary adds to the depth of its valley.
BONUS = np.array([0.0, 0.0, 0.0, 0.1, 0.25, 0.5])
BOUNDARY = re.compile(r"(\\(?:sub)*section\b|\\chapter\b)|(\n[ \t\r]*\n\s*)|(?:(\\end\{[a-zA-Z*]+\}|\\\]|\$\$)|([.!?][)\]}\"']*(?=\s)))\s*")
#: Units on either side of a boundary that are compared, and dimensions of their hashed word vectors.
BLOCK_UNITS, DIMS = 6, 64
#: A piece is at least this part of the limit, if any boundary allows.
LEAST_FILL = 0.5


def _boundaries(text: str) -> tuple[list[int], list[int]]:
    at, kind = [], []
    for m in BOUNDARY.finditer(text):
        g = m.lastindex
        if g == 1:
            at.append(m.start())
            kind.append(5)
        else:
            at.append(m.end())
            kind.append(4 if g == 2 or text.count("\n", m.end(g), m.end()) > 1 else 3 if g == 3 else 2)
    return at, kind


def _cohesion(s: Slice, cuts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The depth of the valley at each cut; cuts are ascending units, doc their texts."""
    u = np.where((s.units >= 65) & (s.units <= 90), s.units + s.units.dtype.type(32), s.units)
    letter = (s.cls == LETTER).astype(np.int8)
    flips = np.diff(np.concatenate((letter, [0])).astype(np.int8), prepend=np.int8(0))
    a, b = np.flatnonzero(flips == 1), np.flatnonzero(flips == -1)
    long = b - a >= 4  # shorter words say little about the topic
    a, b = a[long], b[long]
    h = span_hash(u, a, b)
    edges = np.searchsorted(a, np.concatenate((cuts, [len(u)])))
    pre = np.zeros((len(cuts) + 1, DIMS), np.float32)
    unit = np.searchsorted(cuts, a, "right")
    filled = np.flatnonzero(np.diff(np.concatenate(([0], edges))) > 0)
    if len(a):
        # words are summed eight counters to a machine word, in runs short enough not to overflow a byte
        first = np.searchsorted(unit, filled)
        runs = np.unique(np.concatenate((first, np.arange(0, len(a), 200))))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
        ones = np.add.reduceat(bits, runs, axis=0).view(np.uint8).astype(np.float32)
        size = np.diff(np.concatenate((runs, [len(a)]))).astype(np.float32)
        np.add.at(pre, unit[runs], 2 * ones - size[:, None])
    cum = np.concatenate((np.zeros((1, DIMS), np.float32), np.cumsum(pre, axis=0, dtype=np.float64).astype(np.float32)))
    k = np.arange(len(cuts))
    lo, hi = np.searchsorted(doc, doc, "left"), np.searchsorted(doc, doc, "right")
    left = cum[k + 1] - cum[np.maximum(k + 1 - BLOCK_UNITS, lo)]
    right = cum[np.minimum(k + 1 + BLOCK_UNITS, hi + 1)] - cum[k + 1]
    norm = np.sqrt((left**2).sum(1) * (right**2).sum(1))
    sim = np.where(norm > 0, (left * right).sum(1) / np.maximum(norm, 1e-9), 0)
    peak_l, peak_r = sim.copy(), sim.copy()
    for d in range(1, BLOCK_UNITS + 1):
        same = doc[d:] == doc[:-d]
        peak_l[d:] = np.where(same, np.maximum(peak_l[d:], sim[:-d]), peak_l[d:])
        peak_r[:-d] = np.where(same, np.maximum(peak_r[:-d], sim[d:]), peak_r[:-d])
    return peak_l + peak_r - 2 * sim


def split_texts(texts: list[str], limit: int, overlap: int, vocabulary: str, careful: bool = False) -> list[tuple[int, int, int, int, int, int]]:
    """(text, piece, first unit, end unit, tokens, kind of the cut at its end), in order.

    Sizes are sums over pre-tokens, and every piece is counted by itself in the end. A text with a piece that is larger
    than its sum and so beyond the limit is split once more with each piece counted as it is cut (careful).
    """
    out = []
    c = counter(vocabulary)
    for i0, _, part in slices(texts):
        s = Slice(part)
        starts = pretokens(s)
        n = c.of(s, starts).astype(np.int64)
        big = np.flatnonzero(n > limit // 4)
        if len(big):  # a pre-token of many tokens is parted into short spans, each of at most its bytes in tokens
            step = max(1, limit // 32)
            ends = np.concatenate((starts[1:], [len(s.units)]))
            extra = [np.arange(a + step, b, step) for a, b in zip(starts[big].tolist(), ends[big].tolist())]
            starts = np.sort(np.concatenate((starts, *extra)))
            n = c.of(s, starts).astype(np.int64)
        cum = np.concatenate(([0], np.cumsum(n)))
        first = np.searchsorted(starts, s.offs)  # pre-token numbers at which texts begin
        sizes = cum[first[1:]] - cum[first[:-1]]
        long = np.flatnonzero(sizes > limit)
        at, kinds, docs = [], [], []
        for d in long.tolist():
            p, k = _boundaries(part[d])
            at.append(np.array(p, np.int64) + s.offs[d])
            kinds.append(np.array(k, np.int64))
            docs.append(np.full(len(p), d))
        spans: list[tuple[int, int, int, int]] = []
        if len(long):
            pos, kind, doc = (np.concatenate(x) for x in (at, kinds, docs))
            tok = np.searchsorted(starts, pos, "right") - 1  # a cut goes to the pre-token that holds it
            inside = (tok > first[doc]) & (tok < first[doc + 1])
            tok, kind, doc = tok[inside], kind[inside], doc[inside]
            order = np.lexsort((-kind, tok))
            tok, kind, doc = tok[order], kind[order], doc[order]
            one = np.concatenate(([True], tok[1:] != tok[:-1]))[: len(tok)]
            tok, kind, doc = tok[one], kind[one], doc[one]
            score = _cohesion(s, starts[tok], doc) + BONUS[kind] if len(tok) else np.zeros(0)
            where = cum[tok]
        for d in range(len(part)):
            if sizes[d] <= limit:
                if sizes[d]:
                    spans.append((d, int(s.offs[d]), int(s.offs[d + 1]), 0))
                continue
            a, end = int(first[d]), int(first[d + 1])
            cut = a
            while cum[end] - cum[a] > limit:
                lo, hi = np.searchsorted(where, [cum[a] + int(limit * LEAST_FILL), cum[a] + limit], "right")
                hi = min(hi, int(np.searchsorted(tok, end)))
                if hi > lo:
                    best = lo + int(np.argmax(score[lo:hi]))
                    cut, k = int(tok[best]), int(kind[best])
                else:
                    lo = int(np.searchsorted(tok, cut, "right"))
                    if hi > lo:  # only small pieces can end naturally
                        cut, k = int(tok[hi - 1]), int(kind[hi - 1])
                    else:
                        cut, k = max(a + 1, int(np.searchsorted(cum, cum[a] + limit, "right")) - 1), 1
                while careful:
                    text = s.joined[starts[a] : starts[cut]]
                    if cut == a + 1 or len(text) <= limit // 4 or count_tokens([text], vocabulary)[0] <= limit:
                        break
                    cut, k = cut - 1, 1
                spans.append((d, int(starts[a]), int(starts[cut]), k))
                a = max(a + 1, min(cut, int(np.searchsorted(cum, cum[cut] - overlap, "left"))))
            spans.append((d, int(starts[a]), int(s.offs[d + 1]), 0))
        tokens = count_tokens([s.joined[a:b] for _, a, b, _ in spans], vocabulary)
        over = {spans[i][0] for i in np.flatnonzero(tokens > limit).tolist()} if not careful else set()
        again = {d: split_texts([part[d]], limit, overlap, vocabulary, True) for d in over}
        no, before = 0, -1
        for (d, a, b, k), t in zip(spans, tokens.tolist()):
            if d in over:
                out.extend((i0 + d, *row[1:]) for row in again.pop(d, []))
                continue
            no = no + 1 if d == before else 0
            before = d
            out.append((i0 + d, no, a - int(s.offs[d]), b - int(s.offs[d]), t, k))
    return out


def split_documents(documents: DataFrame, limit: int = 512, overlap: int = 64, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(id, piece_no, start_char, end_char, n_tokens, cut[, text]): every text in ordered pieces of at most limit tokens.

    A text within the limit is one piece. Pieces run from start_char up to end_char (characters from 0); cut names the
    boundary at the end: section, paragraph, formula, sentence, token (no natural boundary fits) or end (of the text).
    Neighbours share up to overlap tokens, and no fewer than that less one pre-token; within a pre-token of more than
    a quarter of the limit (a number or word of hundreds of characters) that is counted over short spans and so is
    approximate. Null and empty texts give no piece; repeated rows are split each for themselves. Other columns are
    not read.
    """
    if not 0 <= overlap < limit * LEAST_FILL / 2 or limit < 32:
        raise ValueError("limit must be 32 or more and overlap less than a quarter of it")
    vocabulary = vocabulary or default_vocabulary()
    fields = [T.StructField(id_col, documents.schema[id_col].dataType), T.StructField("piece_no", T.IntegerType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("cut", T.StringType())]
    schema = T.StructType(fields + [T.StructField("text", T.StringType())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in slices(b.column(1).to_pylist()):
                rows = split_texts(texts, limit, overlap, vocabulary)
                if rows:
                    d, no, s, e, t, k = zip(*rows)
                    cols = [b.column(0).slice(i, j - i).take(pa.array(d)), pa.array(no, pa.int32()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(t, pa.int32()), pa.array([KINDS[x] for x in k])]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array([texts[x][a:z] for x, a, z in zip(d, s, e)], pa.string())] * with_text, schema.names)

    return documents.select(F.col(id_col), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).mapInArrow(run, schema)
