"""Problems 8 and 9: equality with a public encoder, round trips, constraints."""

import os

import numpy as np
import pytest

from dialoom.llm import encode, pack

PATH = f"{encode.TOKENIZERS}/{encode.RANKS}"
needs_files = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")
TEXTS = ["", None, " ", "<|endoftext|> hi", "您好，请问一下  ", "😀 é\n\n x", "a" * 5000, " " * 3000 + "b", "don't 123\t\r\n", "﻿ab‍"]


@needs_files
def test_ids(spark):
    import tiktoken

    ranks = {v: k for k, v in encode.encoder(PATH).tokens.items()}
    other = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in encode.encode_texts(df).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == other.encode_ordinary(t or ""), t
        assert encode.encoder(PATH).decode(got[i]) == (t or "")
    assert {r.doc_id: r.n_tokens for r in encode.count_tokens(df).collect()} == {i: len(v) for i, v in got.items()}
    assert encode.encode_texts(df.where("false")).count() == 0


def check(rows, sizes, capacity, max_docs):
    bins, whole = {}, {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
        whole.setdefault(r.doc_id, []).append(r)
    for r in bins.values():
        assert sum(x.n_tokens for x in r) <= capacity and len(r) <= max_docs
    assert {d: sum(x.n_tokens for x in r) for d, r in whole.items()} == sizes
    for d, r in whole.items():
        assert len(r) == 1 or sizes[d] > capacity
        assert sorted(x.piece_no for x in r) == list(range(len(r)))
    return bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing(spark, monkeypatch, rule):
    monkeypatch.setattr(pack, "GROUP_ITEMS", 150)
    rng = np.random.default_rng(5)
    sizes = {i: int(n) for i, n in enumerate(np.r_[rng.integers(1, 90, 400), [0, 0, 100, 200, 250, 1001]])}
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes.items()], "doc_id long, n_tokens long, bin_id string")
    rows = pack.pack_sizes(df, {"small": 100, "large": 400}, max_docs=8, rule=rule).collect()
    for name, capacity in (("small", 100), ("large", 400)):
        bins = check([r for r in rows if r.pack_name == name], sizes, capacity, 8)
        assert len(bins) <= max(sum(sizes.values()) / capacity, len(sizes) / 8) * 1.15 + 3
    assert pack.pack_sizes(df.where("false"), {"small": 100}).count() == 0
    assert pack.pack_sizes(df, {}).count() == 0


def test_attention_cost_binds():
    where = pack.best_fit(np.array([50, 50, 10, 10]), 100, attention=0.3)
    cost = np.bincount(where, weights=np.array([50, 50, 10, 10.0]) ** 2)
    assert cost.max() <= 0.3 * 100**2 and len(set(where)) == 2


def test_limits_bind_at_the_defaults():
    rng = np.random.default_rng(3)
    sizes = np.r_[rng.integers(1200, 1900, 300), rng.integers(1, 300, 3000), np.full(600, 1)]
    own, free = pack.best_fit(sizes, 2048), pack.best_fit(sizes, 2048, 10**9, 1.0)
    assert (own != free).any()
    for where, most, share in ((own, pack.MAX_DOCS, pack.ATTENTION),):
        alone = np.bincount(where) == 1
        cost = np.bincount(where, weights=sizes.astype(float) ** 2) / 2048**2
        assert np.bincount(where).max() <= most and (cost[~alone] <= share + 1e-9).all() and np.bincount(where, weights=sizes).max() <= 2048
    assert (np.bincount(free, weights=sizes.astype(float) ** 2) / 2048**2).max() > pack.ATTENTION


def test_empty_items_fill_places():
    where = pack.best_fit(np.array([5, 0, 0, 5, 0, 0, 0]), 10, max_docs=3, attention=1.0)
    assert np.bincount(where).max() <= 3 and len(set(where)) == 3
    assert list(pack.best_fit(np.zeros(5, int), 10, max_docs=2)) == [0, 0, 1, 1, 2]
