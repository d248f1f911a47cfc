"""Cross-entropy difference against models made of plain dictionaries."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lm_scoring as lm

SCHEMA = "doc_id long, text string, target boolean, score int, Loss_Target long"


def rows(n=60):
    rnd = random.Random(3)
    out = [(i, " ".join(rnd.choices("aa Ab é, zz! q 中文字 7x".split() if i % 3 else "xx xy (yy) aa".split(), k=rnd.randint(0, 30))), i % 3 == 0, 1, 1) for i in range(n)]
    return out + [(1, None, True, None, None), (None, "", None, None, None), (2, "aa ab", False, None, None), (2, "aa ab", False, None, None), (77, "aé " * 40000, None, None, None), (78, "unique words here", None, 1, 1), (79, "w" * 3000, True, 1, 1)]


def words(text):
    return ["<b>", *re.findall(r"[　-\U0010ffff]|[^\W_　-\U0010ffff]+|[^\w\s]|_", (text or "").lower()), "<e>"]


def counts(data):
    one, two = Counter(), Counter()
    for _, text in data:
        w = words(text)
        one.update(w)
        two.update(zip(w, w[1:]))
    return one, two


def slow(data):
    """(n, loss_target, loss_background, loss_corpus) of each row, each under models counted without it."""
    total = [sum(len(words(r[1])) - 1 for r in data if bool(r[2]) == x) for x in (True, False)]
    scale = total[0] / total[1] if total[1] else 0.0
    every = [counts([r[:2] for r in data if bool(r[2]) == x]) for x in (True, False)]
    out = []
    for r in data:
        w, (own1, own2) = words(r[1]), counts([r[:2]])
        n = len(w) - 1
        sets = [(c[0] - own1, c[1] - own2, total[k] - n) if bool(r[2]) == (k == 0) else (*c, total[k]) for k, c in enumerate(every)]

        def loss(parts):
            s, sum_ = lm.STRENGTH, 0.0
            for a, b in zip(w, w[1:]):
                one = lambda x: sum(f * p[0][x] for f, p in parts)
                p1 = (one(b) + s * lm.UNSEEN) / (sum(f * p[2] for f, p in parts) + s)
                sum_ -= math.log((sum(f * p[1][a, b] for f, p in parts) + s * p1) / (one(a) + s))
            return sum_ / n

        out.append((n, loss([(1, sets[0])]), loss([(scale, sets[1])]), loss([(1, sets[0]), (1, sets[1])])))
    return out


@pytest.mark.parametrize("chunk_bytes", [lm.CHUNK_BYTES, 2000])
def test_scores_equal_dictionaries(spark, chunk_bytes):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = lm.add_scores(df, chunk_bytes=chunk_bytes)
    assert got.columns == ["doc_id", "text", "target", "score", "Loss_Target", "n_tokens", "loss_target_", "loss_background", "loss_corpus", "score_"]
    key = lambda r: (str(r[0]), str(r[1]))
    for r, (row, want) in zip(sorted(got.collect(), key=key), sorted(zip(data, slow(data)), key=lambda x: key(x[0])), strict=True):
        assert tuple(r)[:2] == row[:2] and r.n_tokens == want[0]
        assert np.allclose([r.loss_target_, r.loss_background, r.loss_corpus, r.score_], [*want[1:], want[2] - want[1]], atol=1e-9)
    like = [r.score_ for r in got.collect() if r.target and r.text]
    assert np.mean(like) > np.mean([r.score_ for r in got.collect() if not r.target and r.text])


def test_texts_that_occur_again_have_a_low_corpus_loss(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choices([f"w{k}" for k in range(500)], k=60)) for _ in range(150)]
    df = spark.createDataFrame([(k, t, k % 2 == 0) for k, t in enumerate(texts + texts[:20])], "doc_id long, text string, target boolean")
    got = {r.doc_id: r.loss_corpus for r in lm.add_scores(df).collect()}
    twice, once = [got[k] for k in range(20)], [got[k] for k in range(20, 150)]
    assert max(twice) < min(once)


def test_texts_are_read_in_pieces(monkeypatch):
    texts = ["one two  three\nfour, five " * 400, "", "x" * 99, "a b"]
    flat, bounds = lm.tokens(texts)
    monkeypatch.setattr(lm, "PIECE", 100)
    again = lm.tokens(texts)
    assert np.array_equal(flat, again[0]) and np.array_equal(bounds, again[1])


def test_numbers_survive_packing():
    rnd = np.random.default_rng(1)
    for x in (np.sort(rnd.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2)), rnd.integers(0, 9, 50), np.zeros(0, np.int64), np.array([5, 1 << 40, 0])):
        assert np.array_equal(lm._unpacked(lm._packed(x), x.dtype), x)


def test_flags_are_the_same_broadcast_or_shuffled(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "doc_id long, Target string")
    good = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (9, 1)], "doc_id long, quality int")
    for most in (0, 100):
        got = lm.flag_targets(docs, good, broadcast_ids=most)
        assert got.columns == ["doc_id", "Target", "target_"]
        assert sorted((r.Target, r.target_) for r in got.collect()) == [("a", True), ("b", True), ("c", False), ("d", False)]


def test_no_target_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "abc", False, 1, 1), (2, None, None, 1, 1)], SCHEMA)
    assert [r.score_ for r in lm.add_scores(df).collect()] == [0.0, 0.0]
    assert lm.add_scores(df.limit(0)).count() == 0
