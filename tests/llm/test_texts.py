import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import leaks, mixing, pieces, tokens

VOCAB = tokens.default_vocabulary()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab '\n\t.,1sdré½tmlve ", max_size=30), min_size=1, max_size=5))
def test_token_counts_are_those_of_the_tokenizer(texts):
    enc = tokens.counter(VOCAB).encode
    assert tokens.count_tokens(texts, VOCAB).tolist() == [len(enc(t)) for t in texts]


def test_long_and_odd_texts():
    texts = ["a" * 5000, " " * 3000, "é" * 700 + "'s", "\U0001f600 x", "", "x" * 3_000_000 + " y"]
    enc = tokens.counter(VOCAB).encode
    assert tokens.count_tokens(texts[:5], VOCAB).tolist() == [len(enc(t)) for t in texts[:5]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB9 -.éK\n", max_size=20), min_size=1, max_size=5))
def test_words(texts):
    h, doc, first, last = leaks.words_of(texts)
    want = [(i, m.start(), m.end()) for i, t in enumerate(texts) for m in re.finditer(r"[a-z0-9]+", t.lower())]
    assert [(int(d), int(a), int(b)) for d, a, b in zip(doc, first, last)] == want
    spelled = [texts[d].lower()[a:b] for d, a, b in want]
    assert len(set(h.tolist())) == len(set(spelled))


def grams(t, n):
    w = re.findall(r"[a-z0-9]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, item_id int, words string")


def items_of(spark, items):
    return spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("block", [50, 10**6])
def test_leaks_agree_with_sets_of_grams(spark, block):
    r = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(words) for _ in range(30))) for i in range(20)]
    docs = []
    for d in range(60):
        t = [r.choice(words) for _ in range(80)]
        for _ in range(r.randrange(3)):
            src = r.choice(items)[1].split()
            a = r.randrange(20)
            at = r.randrange(60)
            t[at:at] = src[a : a + r.randrange(3, 12)]
        docs.append((d, ", ".join(t).upper()))
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_passages(frame(spark, docs), items_of(spark, items), 6, block_chars=block).select("doc_id", "item_id").collect()}
    assert got == {(d, i) for d, t in docs for i, u in items if grams(t, 6) & grams(u, 6)} and got


def test_longest_matches(spark):
    item = " ".join(f"t{i}" for i in range(30))
    doc = "start " + " ".join(f"T{i}" for i in range(5, 20)) + ". end " + " ".join(f"t{i}" for i in range(3))
    rows = leaks.leaked_passages(frame(spark, [(1, doc)]), items_of(spark, [(9, item)]), 12).collect()
    assert [(r.doc_id, r.item_id, r.item_word, r.start_char, r.n_words) for r in rows] == [(1, 9, 5, 6, 15)]


def test_leak_edges(spark):
    """Null, empty and very long texts, repeated rows, short items, and empty tables."""
    item = " ".join(f"t{i}" for i in range(12))
    long = "z " * 400_000 + item
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, item), (5, long), (6, item.replace("t5", "t 5"))]
    found = leaks.leaks(frame(spark, docs), items_of(spark, [(1, item), (2, None), (3, ""), (4, "t1 t2"), (None, item)]))
    assert sorted([tuple(r) for r in found.collect()], key=str) == [(3, 1), (5, 1), (None, 1)]
    assert leaks.without_leaks(frame(spark, docs), items_of(spark, [(1, item)])).where("doc_id is not null").count() == 3
    assert leaks.leaks(frame(spark, []), items_of(spark, [(1, item)])).count() == 0
    assert leaks.leaks(frame(spark, docs), items_of(spark, [])).count() == 0


def docs_of(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, 1) for i, s, t in rows], "doc_id long, source string, text string, n_tokens int, block int")


def test_permutation():
    for n in (1, 2, 3, 10, 1000):
        for key in (1, 99):
            p = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(p.tolist()) == list(range(n))


def test_mix_meets_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 40)
    monkeypatch.setattr(mixing, "RUN_SHARDS", 3)
    r = random.Random(2)
    text = lambda: " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(20, 300)))
    rows = [(i, ["big", "mid", "small"][0 if i % 3 else (1 if i % 2 else 2)], text()) for i in range(600)]
    rows += [(1000, None, text()), (1001, "other", text()), (1002, "big", None), (1003, "big", "")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.3, 3), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    docs = docs_of(spark, rows)
    mixed = mixing.mix_sources(docs, targets, block_tokens=64, shard_blocks=16).cache()
    got = {x.source: x for x in mixing.mix_report(mixed, targets).collect()}
    for s, share, cap in (("big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.3, 3)):
        assert abs(got[s].actual_share - share) < 0.02 and 1 <= got[s].most_uses <= cap
    assert got["gone"].n_tokens == 0
    # every slot is filled once, by one block of one source; pieces stay within their documents
    slots = mixed.groupBy("shard", "slot").agg({"source": "max", "block": "max", "n_tokens": "sum"}).collect()
    assert len(slots) == mixed.select("shard", "slot", "source", "block").distinct().count()
    assert max(x["sum(n_tokens)"] for x in slots) == 64
    size = dict(zip([i for i, _, t in rows], tokens.count_tokens([t or "" for _, _, t in rows], VOCAB).tolist()))
    uses = {}
    for x in mixed.collect():
        assert 0 <= x.from_token and x.from_token + x.n_tokens <= size[x.doc_id]
        for k in range(x.from_token, x.from_token + x.n_tokens):
            uses[x.doc_id, k] = uses.get((x.doc_id, k), 0) + 1
    assert max(uses.values()) <= 3


def test_packed_blocks_are_the_tokens(spark):
    """Blocks of a source in order are the tokens of its documents in their order, and every use of a block is the same."""
    r = random.Random(6)
    rows = [(i, "ab"[i % 2], " ".join(r.choice(["alpha", "beta,", "x1", "caf\u00e9"]) for _ in range(r.randrange(1, 90)))) for i in range(80)]
    docs = docs_of(spark, rows)
    targets = spark.createDataFrame([("a", 0.3, 3), ("b", 0.7, 3)], "source string, target_share double, max_repeats int")
    got = mixing.packed_blocks(mixing.mix_sources(docs, targets, block_tokens=32, shard_blocks=8), docs).collect()
    by: dict = {}
    for x in got:
        assert by.setdefault((x.source, x.block), list(x.tokens)) == list(x.tokens) and len(x.tokens) <= 32
    assert len({(x.shard, x.slot) for x in got}) == len(got)
    enc, size = tokens.counter(VOCAB).encode, {i: len(tokens.counter(VOCAB).encode(t)) for i, _, t in rows}
    sizes = spark.createDataFrame([(i, s, size[i]) for i, s, _ in rows], "doc_id long, source string, n_tokens long")
    places = mixing.place_documents(sizes, 32, 17).collect()
    text = {i: t for i, _, t in rows}
    for s in "ab":
        stream = [z for p in sorted((p for p in places if p.source == s), key=lambda p: p["first"]) for z in enc(text[p.doc_id])]
        blocks = {b: v for (q, b), v in by.items() if q == s}
        assert len(blocks) > 10 and all(v == stream[32 * b : 32 * b + 32] for b, v in blocks.items())


def test_draws_end_before_a_cap_is_passed(spark, monkeypatch):
    """50 seeds with a binding source of share 0.01: the draws up to the last shard keep every cap, one more would not."""
    plan = [{"source": "small", "share": 0.01, "repeats": 1, "blocks": 40, "cap": 40, "size": 7000}, {"source": "big", "share": 0.99, "repeats": 1, "blocks": 10**6, "cap": 10**6, "size": 7000}]
    shards, shares = np.arange(7000 // 16), np.array([0.01, 0.99])
    rows, want = [], {}
    for seed in range(50):
        n = mixing.shard_counts(shards, shares, np.full(len(shards), 16), seed)
        rows += [(seed, name, int(k), int(c)) for i, name in enumerate(("small", "big")) for k, c in enumerate(n[:, i])]
        want[seed] = int(np.argmax(np.cumsum(n[:, 0]) > 40))
    table = spark.createDataFrame(rows, "seed int, source string, shard long, t long").cache()
    for seed in range(0, 50, 7):
        assert mixing._first_over(table.where(f"seed = {seed}").drop("seed"), plan, "shard", {})[0] == want[seed]
    assert all(w > 100 for w in want.values())


@pytest.mark.parametrize("seed,runs", [(1, 10_000), (2, 7), (3, 10_000), (4, 1)])
def test_mix_leaves_no_slot_empty(spark, monkeypatch, seed, runs):
    """A small source binds: every slot is filled, no block is used too often, and the next shard would pass the cap."""
    monkeypatch.setattr(mixing, "RUN_SHARDS", runs)
    rows = [(1, "small", "x " * 320), (2, "big", "x " * 9000)]
    size = dict(zip(["small", "big"], tokens.count_tokens([t for _, _, t in rows], VOCAB).tolist()))
    targets = [{"source": "small", "target_share": 0.04, "max_repeats": 1}, {"source": "big", "target_share": 0.96, "max_repeats": 1}]
    plan = mixing._plan(size, targets, 8, None)
    mixed = mixing.mix_sources(docs_of(spark, rows), spark.createDataFrame([tuple(t.values()) for t in targets], "source string, target_share double, max_repeats int"), block_tokens=8, shard_blocks=16, seed=seed)
    got = mixed.collect()
    slots = sorted({(x.shard, x.slot) for x in got})
    n = len(slots) // 16
    assert n > 30 and slots == [(k // 16, k % 16) for k in range(16 * n)]
    shares, caps = np.array([p["share"] for p in plan]), np.array([p["cap"] for p in plan])
    used = np.cumsum(mixing.shard_counts(np.arange(n + 1), shares, np.full(n + 1, 16), seed), axis=0)
    assert (used[n - 1] <= caps).all() and (used[n] > caps).any()
    assert len({(x.source, x.block) for x in got}) == len(slots)


def test_mix_edges(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), (None, 0.2, 2), ("b", 0.5, None)], "source string, target_share double, max_repeats int")
    empty = docs_of(spark, [])
    assert mixing.mix_sources(empty, targets).count() == 0
    assert mixing.mix_sources(docs_of(spark, [(1, "a", "x " * 50_000), (1, "a", "x " * 50_000)]), targets.limit(0)).count() == 0
    one = mixing.mix_sources(docs_of(spark, [(1, "a", "x " * 50_000), (1, "a", "x " * 50_000), (2, "b", "y")]), targets)
    assert {x.source for x in one.collect()} == {"a"}


def latex(r, n):
    out = []
    for _ in range(n):
        words = " ".join(r.choice(["flow", "grid", "norm", "vortex", "kernel", "sample"]) for _ in range(r.randrange(4, 14)))
        out.append(words.capitalize() + r.choice([". ", ".\n", ".\n\n", ".\n\\section{Next}\n", "\n\\begin{equation}x^2\\end{equation}\n"]))
    return "".join(out)


def check_pieces(rows, texts, limit, overlap):
    enc = tokens.counter(VOCAB).encode
    by = {}
    for d, no, a, b, n, k in rows:
        by.setdefault(d, []).append((no, a, b, n, k))
    for d, t in enumerate(texts):
        got = by.get(d, [])
        if not t:
            assert not got
            continue
        assert [x[0] for x in got] == list(range(len(got)))
        assert got[0][1] == 0 and got[-1][2] == len(t)
        for (_, a, b, n, _), nxt in zip(got, [*got[1:], None]):
            assert n == len(enc(t[a:b])) <= limit
            if nxt:
                assert a < nxt[1] <= b < nxt[2]
                # what is counted over short spans of a giant pre-token is approximate
                assert len(enc(t[nxt[1] : b])) <= (2 * overlap if max(map(len, t.split()), default=0) > limit else overlap + 1)


@pytest.mark.parametrize("limit,overlap", [(32, 0), (64, 12), (200, 40)])
def test_pieces_cover_texts_under_the_limit(limit, overlap):
    r = random.Random(4)
    texts = [latex(r, n) for n in (0, 1, 3, 40, 200)] + ["x" * 4000, "é" * 900, "a b " * 900, "\n" * 700, "word. " * 5, "1234567890" * 100 + ". " + "y" * 500]
    rows = pieces.split_texts(texts, limit, overlap, VOCAB)
    check_pieces(rows, texts, limit, overlap)


def test_cuts_are_natural_where_possible():
    r = random.Random(8)
    rows = pieces.split_texts([latex(r, 300)], 128, 16, VOCAB)
    assert all(k >= 2 for *_, k in rows[:-1])


def test_a_change_of_topic_is_cut():
    a = "The vortex flow drives pressure along turbulent boundary layers. " * 14
    b = "Market prices follow investor demand under seasonal interest rates. " * 14
    rows = pieces.split_texts([a + b], 230, 0, VOCAB)
    assert any(abs(end - len(a)) <= 2 for _, _, _, end, _, _ in rows[:-1])


def test_piece_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "short", 1), (3, "short", 1), (None, "word. " * 2000, 1)], "doc_id long, text string, piece_no int")
    rows = pieces.split_documents(df, 64, 8).collect()
    assert [r.n_tokens for r in rows if r.doc_id == 3] == [1, 1] and all(r.n_tokens <= 64 for r in rows)
    assert all(("word. " * 2000)[r.start_char : r.end_char] == r.text for r in rows if r.doc_id is None)
    assert pieces.split_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.split_documents(df, 64, 40)
