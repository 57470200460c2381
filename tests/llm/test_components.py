import random

import pytest

from skein.llm import components as C

ROW = "ind1 long, ind2 long, item string, u int, v int"


def brute(pairs):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                root.setdefault(x, x)
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


def groups(spark, pairs, **how):
    df = spark.createDataFrame([(a, b, "x", 1, None) for a, b in pairs], ROW)
    rows = C.group_items(df, **how).collect()
    assert len(rows) == len({r["item"] for r in rows})
    return {r["item"]: r["group_item"] for r in rows}


def test_chain_star_and_cycle(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, 1000 + i) for i in range(80)]
    pairs = chain[::-1] + star + [(3, 2), (2, 5), (5, 3)]
    assert groups(spark, pairs) == brute(pairs)


@pytest.mark.parametrize("hot_edges", [5, 10**6])
def test_random_graphs(spark, hot_edges):
    """Also with joins salted for hot items."""
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(11, r.randrange(300, 900)) for _ in range(300)]
    assert groups(spark, pairs, hot_edges=hot_edges) == brute(pairs)


def test_table_edges(spark):
    """Nulls on either side, an item with itself, repeated and reversed rows, and an empty table."""
    pairs = [(1, None), (None, 2), (None, None), (4, 4), (5, 6), (6, 5), (5, 6), (-3, 5)]
    assert groups(spark, pairs) == {1: 1, 2: 2, 4: 4, 5: -3, 6: -3, -3: -3}
    assert groups(spark, []) == {}
