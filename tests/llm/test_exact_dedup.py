"""Exact dedup against a dictionary of texts."""

import random
from collections import defaultdict

import pytest

from tessera.llm.exact_dedup import drop_exact, exact_groups

SCHEMA = "doc_id long, text string, lang string, sha string, n long"


def rows(n=700, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.4:
            text = "hot copy " * 40
        elif kind < 0.5:
            text = rnd.choice([None, "", " ", "a", "A"])
        else:
            text = "the same beginning of more than thirty-two bytes " + str(rnd.randrange(120))
        out.append((i, text, rnd.choice([None, "en"]), "x", i))
    out += [(None, "only here, no id", None, None, None), (None, "a", None, None, 1), (5, "é" * 20000, "fr", "", 2)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("parts", [1, 13])
def test_groups_equal_a_dictionary(spark, keep, parts):
    data = rows()
    got = exact_groups(spark.createDataFrame(data, SCHEMA).repartition(parts), keep=keep).collect()
    groups = defaultdict(list)
    for r in data:
        groups[r[1] or ""].append(r[0])
    best = {t: (min if keep == "smallest" else max)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = sorted(((r[0], best[r[1] or ""], len(groups[r[1] or ""]), r[0] is not None and r[0] == best[r[1] or ""]) for r in data), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == want


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_drop_keeps_one_row_per_text_and_all_columns(spark, keep):
    data = rows() + [(9, "twice the same row", "en", "s", 1)] * 2
    got = drop_exact(spark.createDataFrame(data, SCHEMA), keep=keep)
    assert got.columns == ["doc_id", "text", "lang", "sha", "n"]
    kept = got.collect()
    groups = defaultdict(list)
    for r in data:
        groups[r[1] or ""].append(r[0])
    assert len(kept) == len(groups)
    for r in kept:
        ids = [i for i in groups[r.text or ""] if i is not None]
        assert r.doc_id == (min if keep == "smallest" else max)(ids, default=None)
        assert tuple(r) in set(data)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_groups(empty).count() == 0
    assert drop_exact(empty).count() == 0


def test_rows_that_cannot_be_told_apart_make_one_group(spark):
    data = [(None, "the very same row", "en", "s", 1)] * 400 + [(7, "the very same row", "en", "s", 1)] * 400
    df = spark.createDataFrame(data, SCHEMA).repartition(9)
    got = exact_groups(df, keep="largest").collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(7, 800)} and len(got) == 800
    assert [r.doc_id for r in drop_exact(df).collect()] == [7]
