"""The pipeline against brute force, stage by stage, on a small fixture."""

import random

import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline as cp  # noqa: E402
import public_tokenizers  # noqa: E402
from tests.llm.test_decontaminate import plain_matches  # noqa: E402
from tests.llm.test_quality import junk  # noqa: E402
from tests.llm.test_simhash import roots, slow_fingerprint  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"
STAGE = dict(cp.STAGES)


def fixture():
    rnd = random.Random(12)
    sentence = lambda n: " ".join("".join(rnd.choices(["ba", "ti", "ro", "ne", "su", "ka", "lo"], k=rnd.randint(1, 4))) for _ in range(n)).capitalize() + "."
    items = [(k, sentence(16)) for k in range(6)]
    docs, labels = [], []
    for i in range(260):
        good = rnd.random() < 0.8
        text = " ".join(sentence(rnd.randint(6, 12)) for _ in range(rnd.randint(3, 12))) if good else junk(rnd)
        if good and i % 9 == 0:
            text += " " + rnd.choice(items)[1]
        docs.append((i, text))
        labels.append((i, int(good), 0))
    for i in range(40):
        text = docs[rnd.randrange(260)][1]
        docs.append((300 + i, text if i % 2 else text + " x"))
    docs += [(400, None), (401, ""), (402, " \n"), (None, sentence(30)), (7, sentence(30)), (7, docs[7][1])]
    rnd.shuffle(docs)
    return [(*d, None, "s", None, 1.0, "clash") for d in docs], labels, items


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, labels, items = fixture()
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, labels, items


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_each_stage_equals_brute_force(spark, tables):
    folder, docs, labels, items = tables
    df = spark.read.parquet(f"{folder}/documents.parquet")
    kept = rows(STAGE["quality classifier"](spark, df, folder))
    good = {i for i, y, _ in labels if y}
    labelled = [d for d in docs if d[0] is not None and d[0] < 260 and d[0] != 7]
    assert sum((d in kept) == (d[0] in good) for d in labelled) / len(labelled) > 0.97
    assert set(kept) <= set(docs)

    got = rows(STAGE["exact dedup"](spark, df, folder))
    groups = {}
    for d in docs:
        groups.setdefault(d[1] or "", []).append(d[0])
    assert sorted(((d[0], d[1] or "") for d in got), key=str) == sorted(((max((i for i in v if i is not None), default=None), t) for t, v in groups.items()), key=str)

    got = rows(STAGE["SimHash near-dedup"](spark, df, folder))
    fps, groups = [slow_fingerprint(d[1]) for d in docs], {}
    for d, root in zip(docs, roots(fps)):
        groups.setdefault(root, []).append(d[0])
    assert sorted((d[0] for d in got), key=str) == sorted((min((i for i in v if i is not None), default=None) for v in groups.values()), key=str)

    got = rows(STAGE["benchmark decontamination"](spark, df, folder))
    want = sorted((d for d in docs if not any(d[1] and plain_matches(d[1], t) for _, t in items)), key=str)
    assert got == want and len(want) < len(docs) - 10

    got = STAGE["BPE encoding and decoding"](spark, df, folder).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(got) == len(docs)
    for r in got:
        assert list(r.ids_) == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids_) and r.round_trip


def test_run_applies_all_stages_in_order(spark, tables):
    folder, docs, *_ = tables
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    df = spark.read.parquet(f"{folder}/documents.parquet")
    for name, f in cp.STAGES[:-1]:
        df = spark.createDataFrame(f(spark, df, folder).collect(), DOCS)
    got = cp.run(spark, folder)
    assert rows(got.select(*df.columns)) == rows(df)
    assert got.columns == [*df.columns, "ids_", "n_tokens", "round_trip"]


def test_empty_tables_and_no_labels(spark, tables, tmp_path):
    folder, docs, labels, items = tables
    df = spark.read.parquet(f"{folder}/documents.parquet")
    bare = str(tmp_path / "bare")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{bare}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{bare}/benchmark.parquet")
    assert STAGE["quality classifier"](spark, df, bare).count() == len(docs)
    assert STAGE["benchmark decontamination"](spark, df, bare).count() == len(docs)
    for _, f in cp.STAGES:
        assert f(spark, df.limit(0), bare).count() == 0
