"""Language identification: bundles against a plain sum, and held-out accuracy."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import langid

SCHEMA = "doc_id long, text string, lang string, score double, lang_pred_ string"
PARTS = {"xx": "the and ing tion of er re th".split(), "yy": "der die sch ung ß keit ö ver".split(), "zz": "ñ que ción as os el ja ó".split()}


def document(rnd, lang, n=30):
    return " ".join("".join(rnd.choices(PARTS[lang], k=rnd.randint(1, 4))) for _ in range(n)).capitalize() + "."


def slow_vector(text):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    s = " " + re.sub(" +", " ", low).strip(" ") + " "
    out = np.zeros(langid.DIMENSIONS)
    for gram, n in Counter(s[i : i + 3] for i in range(len(s) - 2)).items():
        a, b, c = (langid.letter_vectors(np.array([ord(x)]))[0].astype(int) for x in gram)
        out += np.log1p(n) * np.roll(a, 2) * np.roll(b, 1) * c
    return out if any(map(str.isalpha, text)) else out * 0


@pytest.mark.parametrize("texts", [["Ünï x ß1a中文 déf", "", "1 2", "a"], ["abc def"] * 3, ["q" * 5000, "İstanbul"]])
def test_bundles_equal_a_plain_sum(texts):
    assert np.allclose(langid.text_vectors(texts), np.array([slow_vector(t) for t in texts]), rtol=1e-4, atol=1e-2)


def test_many_distinct_trigrams_take_the_same_way():
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    rnd = random.Random(2)
    texts = ["".join(rnd.choices(letters, k=9000)), "".join(rnd.choices(letters, k=50))]
    assert np.allclose(langid.text_vectors(texts), np.array([slow_vector(t) for t in texts]), rtol=1e-4, atol=1e-2)


def test_held_out_accuracy_and_edge_cases(spark):
    rnd = random.Random(1)
    rows = [(i, document(rnd, lang := rnd.choice(list(PARTS))), lang, None, "c") for i in range(600)]
    train, test = spark.createDataFrame(rows[:400], SCHEMA), rows[400:]
    profiles = langid.fit(train)
    assert profiles.languages == ["xx", "yy", "zz"]
    odd = [(1000, None, None, 1.0, None), (1001, "", "xx", None, None), (1002, "12 !?", None, None, None), (None, document(rnd, "yy", 20000), None, None, None)]
    df = spark.createDataFrame(test + odd + test[:1], SCHEMA)
    got = langid.add_language(df, profiles, score_col="cosine").collect()
    assert len(got) == len(test) + 5
    right = [r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 1000]
    assert sum(right) / len(right) > 0.98
    by_id = {r.doc_id: (r.lang_pred, r.cosine) for r in got}
    assert by_id[1000] == by_id[1001] == by_id[1002] == ("und", 0.0)
    assert by_id[None][0] == "yy"
    assert all(0 <= r.cosine <= 1 for r in got)


def test_profiles_do_not_depend_on_partitions(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, document(rnd, lang := rnd.choice(list(PARTS))), lang, 0.0, "c") for i in range(80)], SCHEMA)
    a, b = langid.fit(df.coalesce(1)), langid.fit(df.repartition(7))
    assert np.allclose(a.prototypes, b.prototypes, atol=1e-6)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    profiles = langid.fit(empty)
    assert langid.add_language(empty, profiles, score_col="cosine").count() == 0
    one = spark.createDataFrame([(1, "words", None, None, None)], SCHEMA)
    assert [(r.lang_pred, r.cosine) for r in langid.add_language(one, profiles, score_col="cosine").collect()] == [("und", 0.0)]


def test_a_text_in_pieces_has_the_same_bundle(monkeypatch):
    rnd = random.Random(5)
    signs = "abc ΣςİßÄ中文é \n.,1  "
    for size in (1, 7, 300, 5000):
        text = "".join(rnd.choices(signs, k=size))
        whole = langid.text_vectors([text])
        for piece in (1, 2, 3, 64):
            monkeypatch.setattr(langid, "PIECE", piece)
            assert np.allclose(langid._long_vector(text, langid.DIMENSIONS)[None, :], whole, rtol=1e-4, atol=1e-2)
        monkeypatch.undo()


def test_a_very_long_text_takes_little_memory():
    import tracemalloc

    text = "The quick brown fox, and ünï 中文. " * 400_000  # 13 million signs
    langid.text_vectors(["warm up"])
    tracemalloc.start()
    langid.text_vectors([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(text) + (120 << 20)
