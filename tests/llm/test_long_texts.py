"""Very long and monotonous texts take time in proportion to their length."""

import time

import numpy as np
import pytest

from dialoom.llm import copies, pairs, privacy, residue, spam
from dialoom.llm.forms import Fold

N = 60_000
TEXTS = ["a" * N, "A" * N, "1" * N, "好" * N, " " * N + "x", "x" + " " * N + "x", "\t\n" * N, "。" * N + "x", "(" * N + ")", "a@" * N, "a." * N, "#" * N, "{" * N, "好a1 " * N, "П" * N, "1-" * N, "aaab" * (N // 4) + "好", "Aa " * N, "aaa" * 40 + "好"]


@pytest.mark.parametrize("text", TEXTS, ids=lambda t: repr(t[:6]))
def test_long(text):
    sketch, ends = np.zeros(residue.BUCKETS, np.int8), np.zeros((3, pairs.ENDINGS), np.int32)
    tell = residue.Residue(sketch, ["amount"])
    model = pairs.Model(np.zeros((pairs.HASHED, 4), np.float32), np.zeros((len(pairs.WEIGHTS), 4)), np.full(4, 0.2))
    began = time.time()
    fold = Fold({})
    shown = fold(text)
    tell.kind(text)
    privacy.Finder(privacy.Disclosure({})).spans(shown)
    pairs.Judge(model, ends, tell).defects([("你好，净重多少？", text)])
    spam.other_share(text, spam.Markov(spam.START, spam.MOVES, spam.EMISSIONS))
    copies.Canon(fold, ["商品", "颜色", "规格"]).record([text], text)
    assert time.time() - began < 6
