"""Rows that fail to parse: a quote-aware finite-state tokenizer over raw delimited records.

The records of a batch are laid end to end and cut into chunks of fixed width. Every chunk is run from every
possible state at once, which gives its transition function; composing those functions (a prefix scan in
log2(chunks) steps) gives each chunk's true start state, however long a record is. A second run from the true
states yields field boundaries, contents and the offset of the first error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of the flight table, in order.
FLIGHT_COLUMNS = [
    "FTIMESTAMP", "AOA1", "AOA2", "EGT_1", "EGT_2", "EGT_3", "EGT_4", "ELEV_1", "ELEV_2", "N1_1", "N1_2", "N1_3", "N1_4",
    "OIT_1", "OIT_2", "OIT_3", "OIT_4", "PH", "PT", "PTCH", "RUDD", "SAT", "TAS", "TAT", "VIB_1", "VIB_2", "VIB_3", "VIB_4", "WOW",
]

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

OTHER, COMMA, QUOTE, END, SKIP = range(5)
START, BARE, QUOTED, CLOSED, BAD = range(5)
#: NEXT[state, class]
NEXT = np.array(
    [
        [BARE, START, QUOTED, START, START],
        [BARE, START, BAD, START, BARE],
        [QUOTED, QUOTED, CLOSED, START, QUOTED],
        [BAD, START, QUOTED, START, CLOSED],
        [BAD, BAD, BAD, START, BAD],
    ],
    np.uint8,
)
_FLAT = NEXT.reshape(-1)
CHUNK = 128
#: Bytes tokenized at a time; bounds a worker's memory, not the length of a record.
SLICE_BYTES = 4 << 20


def states_before(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The automaton's state before each symbol, by composing the transition functions of fixed-width chunks."""
    n = len(classes)
    if n == 0:
        return np.zeros(0, np.uint8)
    c = -(-n // chunk)
    grid = np.full(c * chunk, SKIP, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(c, chunk).T)
    f = np.tile(np.arange(5, dtype=np.uint8), (c, 1))
    for k in range(chunk):
        f = _FLAT[f * np.uint8(5) + grid[k][:, None]]
    step = 1
    while step < c:  # inclusive prefix composition: f[i] becomes f[i] after f[i - step]
        f[step:] = np.take_along_axis(f[step:], f[:-step].copy(), axis=1)
        step *= 2
    state = np.zeros(c, np.uint8)
    state[1:] = f[:-1, START]
    out = np.empty((chunk, c), np.uint8)
    for k in range(chunk):
        out[k] = state
        state = _FLAT[state * np.uint8(5) + grid[k]]
    return out.T.reshape(-1)[:n]


def _tokenize(raw: pa.Array, n_fields: int) -> tuple[list, np.ndarray, np.ndarray, list]:
    """reason, error offset, field count and values of each record; raw has no nulls."""
    m = len(raw)
    raw = raw.cast(pa.large_string())
    offs = np.frombuffer(raw.buffers()[1], np.int64, m + 1, raw.offset * 8)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    ends = offs[1:] + np.arange(m)
    n = int(offs[-1]) + m
    is_end = np.zeros(n, bool)
    is_end[ends] = True
    text = np.zeros(n, np.uint8)
    text[~is_end] = data
    begins = offs[:-1] + np.arange(m)
    cls = np.zeros(n, np.uint8)
    cls[text == 0x2C], cls[text == 0x22] = COMMA, QUOTE
    cls[is_end] = END
    cr = ends[(ends > begins)] - 1
    cls[cr[text[cr] == 0x0D]] = SKIP
    st = states_before(cls)
    # quoting errors
    turns_bad = np.flatnonzero((st != BAD) & (cls != END) & (NEXT[st, cls] == BAD))
    offset = np.full(m, -1, np.int64)
    rec = np.searchsorted(ends, turns_bad)
    offset[rec[::-1]] = (turns_bad - begins[rec])[::-1]
    open_ = st[ends] == QUOTED
    offset[open_] = (ends - begins)[open_]
    quoting = offset >= 0
    # fields
    sep = ((cls == COMMA) & (st != QUOTED) & (st != BAD)) | is_end
    cuts = np.flatnonzero(sep)
    per = np.diff(np.concatenate(([0], np.searchsorted(cuts, ends, "right"))))
    good = ~quoting & (per == n_fields)
    wrong = ~quoting & (per != n_fields)
    first = np.concatenate(([0], np.cumsum(per)[:-1]))
    at = np.where(per > n_fields, cuts[np.minimum(first + n_fields - 1, len(cuts) - 1)] if len(cuts) else 0, ends)
    offset[wrong] = (at - begins)[wrong]
    reason: list = [None] * m
    for i in np.flatnonzero(quoting):
        reason[i] = "quoting"
    for i in np.flatnonzero(wrong):
        reason[i] = "column_count"
    vals: list = [None] * m
    rows = np.flatnonzero(good)
    if len(rows):
        live = np.repeat(good, ends + 1 - begins)
        keep = live & (((cls == OTHER)) | ((cls == COMMA) & (st == QUOTED)) | ((cls == QUOTE) & (st == CLOSED)))
        kept = np.concatenate(([0], np.cumsum(keep)))
        own = cuts[live[cuts]]
        lens = np.concatenate(([0], kept[own]))
        field = pa.LargeStringArray.from_buffers(len(own), pa.py_buffer(lens.astype(np.int64)), pa.py_buffer(text[keep].tobytes()))
        field = pc.utf8_trim(field, " \t")
        ok = pc.match_substring_regex(field, NUMBER).to_numpy(zero_copy_only=False)
        num = np.full(len(own), np.nan)
        num[ok] = [float(x) for x in (field if ok.all() else field.filter(pa.array(ok))).to_pylist()]
        fine = np.isfinite(num).reshape(-1, n_fields)
        num = num.reshape(-1, n_fields)
        starts = np.concatenate(([0], own[:-1] + 1)).reshape(-1, n_fields)
        starts[:, 0] = begins[rows]
        for i, r in enumerate(rows):
            if fine[i].all():
                vals[r] = num[i]
            else:
                reason[r] = "invalid_value"
                offset[r] = starts[i, int(np.argmin(fine[i]))] - begins[r]
    return reason, offset, per, vals


def parse_lines(df: DataFrame, id_col: str = "line_id", raw_col: str = "raw_line", n_fields: int = 29) -> DataFrame:
    """(id, reason, err_offset, n_found, vals): one row per record.

    reason is null for a good record, whose numbers are in vals; else the first of quoting, column_count and
    invalid_value that holds, with the byte offset of the error in the record. A null record has no fields and an
    empty one has a single empty field: both fail with column_count. Repeated rows are parsed each for itself; a
    null id passes through; other columns of df are not read. A record may be of any length.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("reason", T.StringType()), T.StructField("err_offset", T.LongType()),
        T.StructField("n_found", T.IntegerType()), T.StructField("vals", T.ArrayType(T.DoubleType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            cut = np.cumsum(size, dtype=np.int64) // SLICE_BYTES
            edges = [0, *(np.flatnonzero(np.diff(cut)) + 1), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if hi <= lo:
                    continue
                ids, raw = b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)
                null = raw.is_null().to_numpy(zero_copy_only=False)
                reason, off, per, vals = _tokenize(pc.fill_null(raw, ""), n_fields)
                per = np.where(null, 0, per)
                bad = [r is not None for r in reason]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(reason, pa.string()), pa.array(off, pa.int64(), mask=~np.array(bad, bool)), pa.array(per.astype(np.int32)), pa.array(vals, pa.list_(pa.float64()))],
                    [id_col, "reason", "err_offset", "n_found", "vals"],
                )

    return df.select(F.col(id_col), F.col(raw_col).cast("string")).mapInArrow(run, schema)


def typed_rows(parsed: DataFrame, id_col: str = "line_id", columns: list[str] = FLIGHT_COLUMNS) -> DataFrame:
    """The good records as typed columns."""
    return parsed.where(F.col("reason").isNull()).select(id_col, *(F.col("vals")[i].alias(c) for i, c in enumerate(columns)))


def rejected_rows(parsed: DataFrame, id_col: str = "line_id") -> DataFrame:
    """The failing records with their reason and offset."""
    return parsed.where(F.col("reason").isNotNull()).select(id_col, "reason", "err_offset", "n_found")
