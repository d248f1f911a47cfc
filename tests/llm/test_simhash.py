"""SimHash against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.operators.components import components

SCHEMA = "doc_id long, text string, fp string, component_id int"


def slow_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    codes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def roots(fps):
    """Smallest index of each item's component, by comparing all pairs."""
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [find(i) for i in range(len(fps))]


def documents(seed=5):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choices("alpha Beta gamma delta Épsilon zeta\x0b eta\x1c theta\xa0iota".split(" "), k=300)) for _ in range(12)]
    out = []
    for i in range(160):
        words = rnd.choice(base).split(" ")
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(99)}"
        out.append((i, " ".join(words)))
    out += [(200, None), (201, ""), (202, " \t\n"), (203, "one two"), (204, "ONE  TWO"), (205, "one"), (206, "x " * 30000), (206, "x " * 30000), (None, "one"), (None, "no id at all"), (7, "a b c d")]
    rnd.shuffle(out)
    return [(*r, "clash", 1) for r in out]


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_components_equal_brute_force(spark, hot):
    rows = documents()
    got = simhash.near_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), hot=hot).collect()
    fps = [slow_fingerprint(r[1]) for r in rows]
    groups = {}
    for r, root in zip(rows, roots(fps)):
        groups.setdefault(root, []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    want = [(r[0], f"{f:016x}", least[root]) for r, f, root in zip(rows, fps, roots(fps))]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert len({r.component_id for r in got}) < 0.5 * len(rows)


@pytest.mark.parametrize("broadcast_ids", [simhash.BROADCAST_IDS, 0])
def test_drop_keeps_one_row_of_each_component(spark, broadcast_ids):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    kept = simhash.drop_near(df, broadcast_ids=broadcast_ids).collect()
    fps = [slow_fingerprint(r[1]) for r in rows]
    groups = {}
    for r, f, root in zip(rows, fps, roots(fps)):
        groups.setdefault(root, []).append(r[0])
    want = [min((x for x in v if x is not None), default=None) for v in groups.values()]
    assert sorted((r.doc_id for r in kept), key=str) == sorted(want, key=str)
    assert {tuple(r) for r in kept} <= set(rows)


def test_lists_find_every_close_pair():
    rng = np.random.default_rng(1)
    near = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([near, *(near ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (1, 2, 3, 3, 4, 5) for _ in range(3))]))
    ints = [int(x) for x in fps]
    close = [(i, j) for i in range(len(ints)) for j in range(i) if (ints[i] ^ ints[j]).bit_count() <= 3]
    assert len(close) > 50
    for i, j in close:
        assert any(all((ints[i] ^ ints[j]) >> 8 * p & 255 == 0 for p in t) for t in simhash.TRIPLES)
    one_list = np.zeros(len(fps), np.int64)
    a, b = simhash.list_links(one_list, fps)
    pieces = simhash._Pieces(len(fps))
    simhash._probe(fps, pieces, 0)
    same = [ints.index(int(y)) for y in b]
    label = list(range(len(ints)))
    for x, y in zip(a, same):
        label[ints.index(int(x))] = y
    assert label == roots(ints) == pieces.label.tolist()


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (901, 900), (5, 5)], "a long, b long")
    got = {tuple(r) for r in components(links).collect()}
    assert got == {(i, 0) for i in range(1, 201)} | {(901, 900)}
    assert components(links.limit(0)).count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_groups(empty).count() == 0
    assert simhash.drop_near(empty).count() == 0


def test_a_hot_fingerprint_is_kept_out_of_the_shuffle(spark, monkeypatch):
    """One text in 80 % of the rows: with and without the split the result is the same, and it is spread."""
    from tessera import runtime

    df = spark.createDataFrame([(k, "one text that very many rows share" if k % 5 else f"text number {k} of its own {k * 7}") for k in range(2000)], "doc_id long, text string").repartition(8)
    want = sorted(map(tuple, simhash.near_groups(df).collect()))
    split = lambda *a, **k: runtime.join_counted(*a, **k, hot_rows=100)
    monkeypatch.setattr(simhash, "join_counted", split)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = simhash.near_groups(df)
        assert sorted(map(tuple, got.collect())) == want
        assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 600
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_lists_that_span_batches(monkeypatch):
    import pyarrow as pa

    keys = np.repeat(np.arange(5), [3, 40, 1, 60, 2])
    fps = np.random.default_rng(3).integers(0, 16, len(keys)).astype(np.uint64)
    def links(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + size]), pa.array(fps[k : k + size].view(np.int64))], names=["key", "fp"]) for k in range(0, len(keys), size)]
        return sorted((a, b) for x in simhash._links(iter(batches)) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist()))
    assert links(7) == links(1000) == links(1)


def test_a_text_in_pieces_has_the_same_fingerprint(monkeypatch):
    rnd = random.Random(8)
    for size in (0, 1, 2, 3, 4, 50, 700):
        words = ["".join(rnd.choices("abÄ中Z", k=rnd.randint(1, 9))) for _ in range(size)]
        text = "".join(w + rnd.choice([" ", "\n\n", "\t \r", "\x0b\x0c"]) for w in words)
        for n in (1, 3, 5):
            whole = simhash.fingerprint(text, n)
            for piece in (1, 2, 5, 64):
                monkeypatch.setattr(simhash, "PIECE", piece)
                assert simhash.fingerprint(text, n) == whole
            monkeypatch.undo()
