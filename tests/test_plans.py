"""The shape of plans: what is read, what runs in Python, what is shuffled."""

import re

import pytest

from skein.functions import encode, hashing
from skein.operators import network, stats
from skein.plans import network_queries as q
from skein.sources import series as src
from tests.compare import SF


def plan(df):
    return df._jdf.queryExecution().toString()


def read_columns(text):
    return {frozenset(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^>]*)", text)}


def test_the_clip_pipeline_stays_in_the_jvm(spark):
    codes = hashing.substring_codes(src.series_embeddings(spark, SF).select("item", encode.clip("vals", q.CLIP).alias("enc")), q.CLIP.offsets, q.CLIP.code_len)
    text = plan(network.candidate_pairs(codes))
    assert not re.search("Python|Arrow|Cartesian|NestedLoop", text)
    assert all("label" not in c for c in read_columns(text))


def test_statistics_read_what_they_need_and_combine_on_the_map_side(spark):
    text = plan(stats.variable_stats(src.flights_events(spark, SF)))
    assert read_columns(text) == {frozenset({"user_id", "value"})}
    assert "partial_avg" in text and text.split("Physical Plan")[1].count("Exchange") == 1


def test_filters_reach_the_scan(spark):
    text = plan(src.flights_events(spark, SF).where("flight = 'click'").select("value"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in text


def test_event_series_keep_only_the_head_of_a_user(spark):
    assert "WindowGroupLimit" in plan(src.series_events(spark, SF))


@pytest.mark.parametrize("name", ["abc_codes", "sax_codes", "ssh_sketch", "standardize", "binarize_mean", "series_window", "report_parse"])
def test_queries_without_python(spark, name):
    assert not re.search("Python|Pandas|MapInArrow", plan(q.QUERIES[name](spark, SF)))
