"""Licence scans against Python's own regular expressions, with variants of known texts."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.llm import licences as lic

SCHEMA = "doc_id long, text string, licence_id string, digest int"


def slow_canonical(text):
    out = re.sub(lic.COPYRIGHT_LINE, "\n", text.lower())
    for pattern, replacement in lic.SPELLINGS:
        out = re.sub(pattern, replacement, out, flags=re.ASCII)
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in out).split()


FORMS = {}
for name, known_text in sorted(lic.KNOWN.items(), reverse=True):
    FORMS[" ".join(slow_canonical(known_text))] = name


def slow_scan(text):
    find = lambda t: FORMS.get(" ".join(slow_canonical(t))) if t else None
    return find(text), ",".join(sorted({n for line in (text or "").split("\n") if (n := find(line))}))


def rows():
    mit = lic.KNOWN["MIT"]
    out = [(i, t) for i, t in enumerate(lic.KNOWN.values())]
    out += [
        (100, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("\n", "\r\n\r\n")),
        (101, "© 1999-2003 X, Y and Z. All rights reserved.\n  " + mit.replace("sublicense", "sub-licence").replace('"', "“")),
        (102, mit + "\nand one more sentence"),
        (103, "Some prose first.\nReleased under the MIT Licence!\nlicensed under cc by-nc 4.0\nLicensed under CC BY-NC 4.0.\nend"),
        (104, "Licensed under the Apache License, v2.0"),
        (105, None),
        (106, ""),
        (107, "licence"),
        (108, "permission " * 60000),
        (109, "Copyright 2020 A\nCopyright 2021 B"),
        (103, "Licensed under CC0 1.0"),
        (None, "Released under the MIT License."),
    ]
    return [(*r, "clash", 1) for r in out]


@pytest.mark.parametrize("as_frame", [False, True])
def test_scan_equals_python(spark, as_frame):
    known = spark.createDataFrame(list(lic.KNOWN.items()), "licence_id string, text string") if as_frame else None
    got = lic.scan(spark.createDataFrame(rows(), SCHEMA).repartition(3), known=known).collect()
    want = [(r[0], *slow_scan(r[1])) for r in rows()]
    assert sorted(((r.doc_id, r.licence_id, r.notices) for r in got), key=str) == sorted(want, key=str)
    by_id = {r.doc_id: r for r in got}
    assert by_id[100].licence_id == by_id[101].licence_id == "MIT" and by_id[102].licence_id is None
    assert by_id[104].licence_id == "Apache-2.0-notice"


def test_every_known_text_names_itself(spark):
    assert {r.licence_id for r in lic.known_digests(spark).collect()} == set(lic.KNOWN)


def test_plan_is_native(spark):
    plan = lic.scan(spark.createDataFrame(rows(), SCHEMA).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" not in plan and "NestedLoop" not in plan


def test_texts_with_one_canonical_form_have_one_skeleton(spark):
    """Every rule is applied to random strings of what the rules look for, and both forms compared."""
    rnd = random.Random(5)
    bits = ["licence", "license", "sub-licen", "sub licens", "non-commercial", "noninfringement", "organise", "organize", "realisation", "colour", "judgement", "copyright holder", "copyright owner", "https://x", "http://x", "v2", "ver. 3", "version 3", "v. 4", "(c) 2020 a\n", "© b", "Copyright 2020 q\n", "all rights reserved", "\n", " ", "-", "é", "x9", "K", "İ", "our", "vour", "ising"]
    rows = [("".join(rnd.choices(bits, k=rnd.randint(1, 4))),) for _ in range(6000)]
    got = spark.createDataFrame(rows, "t string").select(lic.canonical(F.col("t")).alias("c"), lic.skeleton(F.col("t")).alias("s")).distinct().groupBy("c").agg(F.count("*").alias("n"), F.collect_list("s").alias("s"))
    assert got.where("n > 1").collect() == [] and got.count() < 5000


def test_no_match_needs_a_word_of_licences(spark):
    rows = [(1, "Do as you please!", "", 1), (2, "Copyright 2020 A\nDo as you please.", "", 1), (3, "before\n do AS you-please\nafter", "", 1), (4, "Do as you please not", "", 1)]
    got = lic.scan(spark.createDataFrame(rows, SCHEMA), known={"X": "do as you please"}).collect()
    assert {tuple(r) for r in got} == {(1, "X", "X"), (2, "X", "X"), (3, None, "X"), (4, None, "")}
    assert {tuple(r)[1:] for r in lic.scan(spark.createDataFrame(rows, SCHEMA), known={}).collect()} == {(None, "")}


def test_whole_licences_are_found_by_the_digest_join(spark):
    whole = [k for k, v in lic.KNOWN.items() if len(v) > 400]
    rows = [(k, f"Copyright (c) 20{k:02} Some One\nAll rights reserved.\n\n" + lic.KNOWN[n].replace(". ", ".\n  ").upper(), "", 1) for k, n in enumerate(whole)]
    got = {r.doc_id: r.licence_id for r in lic.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == dict(enumerate(whole)) and len(whole) >= 8


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lic.scan(empty).count() == 0
    one = spark.createDataFrame([(1, "Released under the MIT License.", "", 1)], SCHEMA)
    assert [tuple(r) for r in lic.scan(one, known=spark.createDataFrame([], "licence_id string, text string")).collect()] == [(1, None, "")]
