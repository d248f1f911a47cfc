"""Quality: term counts against plain counting, the vote against brute force, held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np

from tessera.llm import quality

DOCS = "doc_id long, text string, quality int, label string"


def clean(rnd):
    return ". ".join(" ".join(rnd.choices("one two three four five six".split(), k=8)).capitalize() for _ in range(rnd.randint(1, 9))) + "."


def junk(rnd):
    kind = rnd.randrange(3)
    words = rnd.choices("one two three four five six".split(), k=30)
    return [" | ".join(words), " ".join(f"{w}$$$ {w.upper()}!!" for w in words), " ".join(w for w in words for _ in range(6))][kind]


def data(n=500):
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.8
        docs.append((i, (clean if good else junk)(rnd), 9, "x"))
        labels.append((i, int(good), 0))
    return docs, labels


def slow_counts(text):
    kinds = []
    for c in text:
        k = next((i for i, s in enumerate(quality.SIGNS) if c in s), None)
        if k is None:
            k = (quality.LOWER if c.islower() else quality.UPPER if c.isupper() else quality.LETTER) if c.isalpha() else quality.OTHER
        if not kinds or k != kinds[-1] or k not in quality.JOINED:
            kinds.append(k)
    out = Counter((a * quality.CLASSES + b) * quality.CLASSES + c for a, b, c in zip(kinds, kinds[1:], kinds[2:]))
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    for back in (1, 2):
        out[quality.TERMS - back] = sum(a == b for a, b in zip(words, words[back:]))
    return +out


def test_term_counts_equal_plain_counting():
    rnd = random.Random(1)
    texts = [clean(rnd), junk(rnd), "", "A", "ab  12\n\nB é中文!! x x x x y x", "w " * 4000]
    got = quality.term_counts(texts)
    for row, text in zip(got, texts):
        assert {int(k): int(row[k]) for k in np.flatnonzero(row)} == dict(slow_counts(text))


def test_vote_equals_brute_force():
    rnd = random.Random(2)
    texts, labels = [clean(rnd) for _ in range(30)] + [junk(rnd) for _ in range(20)], np.array([1] * 30 + [0] * 20)
    model = quality.fit_counts(quality.term_counts(texts), labels, 0.8, 12)
    asked = [clean(rnd) for _ in range(10)] + [junk(rnd) for _ in range(10)] + [""]
    got = quality.scores(asked, model, 7, block=4)
    v = quality._unit(quality._weighted(quality.term_counts(asked), model.weights) @ model.axes)
    for k in range(len(asked)):
        near = sorted(((float(v[k] @ w), m, y) for w, m, y in zip(model.vectors, model.mass, labels)), reverse=True)[:7]
        total = sum(max(c, 0) ** quality.SHARPNESS * m for c, m, _ in near)
        want = sum(max(c, 0) ** quality.SHARPNESS * m * y for c, m, y in near) / total if total > 1e-12 else 0.8
        assert abs(got[k] - want) < 1e-3


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = data()
    odd = [(9000, None, None, None), (9001, "", 1, None), (None, "one two three", None, None), (9002, "x" * 300000, 0, None)]
    model = quality.fit(spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + [(9000, None, 0), (None, 1, 1), (3, 7, 0), labels[5]], "doc_id long, quality int, toxic int"))
    got = quality.add_score(spark.createDataFrame(docs + odd + docs[:1], DOCS), model).collect()
    assert len(got) == len(docs) + 5 and all(0 <= r.score <= 1 for r in got)
    truth = {i: y for i, y, _ in labels}
    tested = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(tested) > 50
    assert sum((r.score >= quality.THRESHOLD) == truth[r.doc_id] for r in tested) / len(tested) > 0.97
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[9000] == by_id[9001] == model.prior
    again = quality.fit(spark.createDataFrame(docs + odd, DOCS).repartition(7), spark.createDataFrame(labels[::-1], "doc_id long, quality int, toxic int"))
    assert np.allclose(np.abs(again.vectors @ again.vectors.T), np.abs(model.vectors @ model.vectors.T), atol=1e-3)


def test_held_out_rows_teach_nothing(spark):
    docs, labels = data(60)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, t) for i, y, t in labels]
    df = spark.createDataFrame(docs, DOCS)
    a, b = (quality.fit(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert np.array_equal(a.labels, b.labels) and np.array_equal(a.vectors, b.vectors)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(spark.createDataFrame([], DOCS), none)
    df = spark.createDataFrame([(1, "a", 0, "")], DOCS)
    assert [r.score for r in quality.add_score(df, model).collect()] == [0.5]
    assert quality.add_score(df.limit(0), model).count() == 0
    one = quality.fit(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert quality.add_score(df, one).first().score in (0.0, 1.0, one.prior)


def test_words_tell_texts_of_one_shape_apart(spark):
    rnd = random.Random(4)
    good, bad = "rivers carry silt toward wide plains while farmers watch".split(), "casino bonus cheap loans poker pills winner jackpot deals".split()
    prose = lambda words: ". ".join(" ".join(rnd.choices(words, k=8)).capitalize() for _ in range(rnd.randint(2, 6))) + "."
    docs = [(i, prose(good if i % 2 else bad), 9, "x") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    model = quality.fit(spark.createDataFrame(docs, DOCS), labels)
    tested = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    got = quality.scores([d[1] for d in tested], model)
    assert np.mean((got >= 0.5) == [d[0] % 2 for d in tested]) > 0.97


def test_word_counts_equal_plain_counting():
    got = quality.word_counts(["Ab ab, c3AB éÉ", "", "中文中", "AB"])
    assert got.sum(axis=1).tolist() == [5, 0, 3, 1] and sorted(got[0][got[0] > 0].tolist()) == [1, 1, 3]
    assert got[0] @ got[3] == 3 and sorted(got[2][got[2] > 0].tolist()) == [1, 2]


def test_repeated_identifiers_crowd_nothing_out(spark):
    docs, labels = data(60)
    chosen = next(i for i, *_ in docs if zlib.crc32(str(i).encode()) % 4 != 2)
    many = docs + [(chosen, f"Copy {k} of it.", 9, "x") for k in range(200)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a, b = (quality.fit(spark.createDataFrame(many, DOCS).repartition(n), table, per_class=40) for n in (1, 7))
    learnt = [y for i, y, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(a.labels) == sorted(b.labels) == sorted(learnt)
    assert np.allclose(a.vectors @ a.vectors.T, b.vectors @ b.vectors.T, atol=1e-3)


def test_a_text_in_pieces_has_the_same_counts(monkeypatch):
    rnd = random.Random(9)
    for size in (1, 3, 40, 400):
        text = " ".join("".join(rnd.choices("abÄ中Z.,$1", k=rnd.randint(1, 3))) + rnd.choice(["", "!", "\n"]) for _ in range(size)) + rnd.choice(["", "  "])
        whole = quality.all_counts(["x y", text, ""])
        for piece in (16, 33, 64):
            monkeypatch.setattr(quality, "PIECE", piece)
            assert np.array_equal(quality.all_counts(["x y", text, ""]), whole)
        monkeypatch.undo()
