"""Properties of codes and similarities on random series."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.config import ClipConfig, SaxConfig
from skein.functions import encode, families, hashing, similarity
from skein.operators import network

VALUES = st.lists(st.floats(-5, 5, allow_nan=False).map(lambda x: round(x, 2)), min_size=12, max_size=12)


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "item long, vals array<double>")


@settings(max_examples=8, deadline=None)
@given(st.lists(VALUES, min_size=2, max_size=8))
def test_networks(make, rows):
    series = make([*rows, rows[0]])
    clip = ClipConfig(12, 0.5, families.offsets(3, 12, 4, 1), 4, 0.2)
    sax = SaxConfig(12, 0.0, 2.0, 3, 4, [0, 1], 2)
    twin = (0, len(rows))
    for enc, cfg, measure, best in (
        (series.select("item", encode.clip("vals", clip).alias("enc")), clip, lambda a, b: similarity.run_length(a, b, 0.2), (1.2**12 - 1) / 0.2),
        (series.select("item", encode.sax("vals", sax).alias("enc")), sax, lambda a, b: similarity.mindist(a, b, sax), 0.0),
    ):
        codes = hashing.substring_codes(enc, cfg.offsets, cfg.code_len)
        pairs = [tuple(r) for r in network.candidate_pairs(codes).collect()]
        assert sum(p[2:] == twin for p in pairs) == len(cfg.offsets)  # equal series share every code
        assert all(a < b for *_, a, b in pairs)
        sims = {(r.id1, r.id2): r.sim for r in network.verify(network.candidate_pairs(codes), enc, measure).collect()}
        assert set(sims) == {p[2:] for p in pairs} and abs(sims[twin] - best) < 1e-9
        assert max(sims.values()) <= best + 1e-9 if cfg is clip else min(sims.values()) >= best
        back = {(r.id1, r.id2): r.sim for r in network.verify(network.candidate_pairs(codes), enc, lambda a, b: measure(b, a)).collect()}
        assert all(abs(back[k] - v) < 1e-9 for k, v in sims.items())
