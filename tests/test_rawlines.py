import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.operators import rawlines as R

ROW = "line_id long, raw_line string, reason string, vals int"


def brute(line, n):
    """The reason by reading one character at a time."""
    s = "" if line is None else line.removesuffix("\r")
    if line is None:
        return "column_count"
    fields, cur, state = [], "", "start"
    for ch in s + ",":
        if state == "quoted":
            if ch == '"':
                state = "closed"
            else:
                cur += ch
        elif ch == ",":
            fields.append(cur)
            cur, state = "", "start"
        elif ch == '"':
            if state == "start":
                state = "quoted"
            elif state == "closed":
                cur, state = cur + ch, "quoted"
            else:
                return "quoting"
        elif state == "closed":
            return "quoting"
        else:
            cur, state = cur + ch, "bare"
    if state != "start":
        return "quoting"
    if len(fields) != n:
        return "column_count"
    for f in fields:
        f = f.strip(" \t")
        if not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", f) or math.isinf(float(f)):
            return "invalid_value"
    return None


def reasons(lines, n, chunk=None):
    import pyarrow as pa

    return R._tokenize(pa.array(["" if x is None else x for x in lines]), n)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='1.,"e- \r\tx+é', max_size=12), min_size=1, max_size=6), st.integers(1, 3))
def test_agrees_with_a_reader_by_character(lines, n):
    reason, _, _, vals = reasons(lines, n)
    assert reason == [brute(x, n) for x in lines]
    assert [v is None for v in vals] == [r is not None for r in reason]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1000])
def test_chunks_compose(chunk):
    import numpy as np

    cls = np.random.default_rng(1).integers(0, 5, 500).astype(np.uint8)
    state, want = 0, []
    for c in cls:
        want.append(state)
        state = R.NEXT[state, c]
    assert R.states_before(cls, chunk).tolist() == [int(x) for x in want]


def test_offsets_and_values():
    reason, off, per, vals = reasons(['1,"2",+.5e1\r', '1,2,"3', "1,2", "1,2,3,4", "1,x,3", '1,2"3,4', "1,1e999,2", '" 1 ",2,3'], 3)
    assert reason == [None, "quoting", "column_count", "column_count", "invalid_value", "quoting", "invalid_value", None]
    assert off.tolist()[1:7] == [6, 3, 5, 2, 3, 2]
    assert vals[0].tolist() == [1.0, 2.0, 5.0] and vals[7].tolist() == [1.0, 2.0, 3.0]


def test_table_edges(spark):
    """Nulls, empty and very long lines, repeated rows, null ids and columns with clashing names."""
    long = ",".join(["1"] * 29)
    rows = [(1, None), (1, None), (None, long), (4, ""), (5, '"' + "7" * 300_000), (6, long.replace("1", '"1"', 1)), (7, "9" * 400 + "," + ",".join(["1"] * 28))]
    df = spark.createDataFrame([(i, s, "a", [1.0]) for i, s in rows], "line_id long, raw_line string, reason string, vals array<double>")
    got = sorted(((r.line_id, r.reason, r.err_offset) for r in R.parse_lines(df).collect()), key=str)
    assert got == sorted([(1, "column_count", 0)] * 2 + [(None, None, None), (4, "column_count", 0), (5, "quoting", 300_001), (6, None, None), (7, "invalid_value", 0)], key=str)
    assert R.typed_rows(R.parse_lines(df)).count() == 2
    assert R.rejected_rows(R.parse_lines(df.limit(0))).count() == 0
