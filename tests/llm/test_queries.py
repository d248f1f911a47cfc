"""The registered queries over small tables, against their contracts computed in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from tests.llm.test_simhash import roots, slow_fingerprint
from tests.llm.test_url_rules import slow_rule, slow_split

pytest.importorskip("public_tokenizers")
queries = pytest.importorskip("tessera.llm.queries")

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables with nulls, repeated texts and control strings, and labels and languages to learn."""
    import random

    from tests.llm.test_chat import conversations
    from tests.llm.test_langid import PARTS, document
    from tests.llm.test_quality import junk
    from tests.llm.test_url_rules import urls

    rnd, folder = random.Random(20), str(tmp_path_factory.mktemp("tables"))
    docs, labels = [], []
    for i in range(240):
        lang = rnd.choice(list(PARTS))
        good = rnd.random() < 0.8
        text = document(rnd, lang, rnd.randint(5, 60)) if good else junk(rnd)
        docs.append((i, text, lang if good else None, f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    docs += [(300 + k, docs[k][1], docs[k][2], "s0", 0) for k in range(0, 60, 2)]
    docs += [(400, None, None, None, None), (401, "", "xx", None, 0), (402, "12 34", "yy", None, 5), (403, "a <|endoftext|> b é中🎉 \n\n  x", "zz", None, 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, docs[0][1]), (1, "nothing of this is anywhere in there")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    conv = [r[:4] for r in conversations() if r[0] is not None]
    spark.createDataFrame(conv, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(r[0], r[1], "<p>") for r in urls(120)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder, docs, labels, conv


def run(spark, small, number):
    name = next(n for n in queries.QUERIES if n.startswith(f"op{number}_"))
    return queries.QUERIES[name](spark, small[0])


def test_all_ten_are_there():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 11)]


def test_op1(spark, small):
    got = run(spark, small, 1)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    truth = {d[0]: d[2] for d in small[1]}
    rows = got.collect()
    assert len(rows) == len(small[1]) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    asked = [r for r in rows if r.held_out and truth[r.doc_id] and r.doc_id < 400]
    assert sum(r.lang_pred == truth[r.doc_id] for r in asked) / len(asked) > 0.95
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {400, 401, 402}


def test_op2(spark, small):
    got = run(spark, small, 2)
    assert {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}.items() <= dict(got.dtypes).items()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{small[0]}/pages.parquet").collect()}
    rows = [r for r in got.collect() if r.page_id not in (3, None)]
    for r in rows:
        host, path = slow_split(urls[r.page_id])
        rule, verdict = slow_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_op3(spark, small):
    rows = run(spark, small, 3).collect()
    good = {i for i, y, _ in small[2] if y}
    bad = {i for i, y, _ in small[2] if not y}
    mean = lambda s: sum(r.score for r in rows if r.doc_id in s) / len(s)
    assert len(rows) == len(small[1]) and mean(good) > mean(bad)


def test_op4(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {d[0]: d[1] or "" for d in small[1]}
    rows = run(spark, small, 4).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_op5(spark, small):
    convs = defaultdict(list)
    for c, t, r, x in [*small[3], *queries.TRAP]:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    rows = run(spark, small, 5).collect()
    assert len(rows) == len(convs)
    for r in rows:
        turns = [x[2:] for x in sorted(convs[r.conv_id], key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)) and r.formatted_chars > sum(len(a) + len(b) for a, b in turns)


def test_op6(spark, small):
    fps = [slow_fingerprint(d[1]) for d in small[1]]
    least = {}
    for d, root in zip(small[1], roots(fps)):
        least[root] = min(least.get(root, d[0]), d[0])
    want = {d[0]: (f"{f:016x}", least[root]) for d, f, root in zip(small[1], fps, roots(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, small, 6).collect()} == want


def test_op7(spark, small):
    found = {(r.doc_id, r.item_id) for r in run(spark, small, 7).collect()}
    first = small[1][0][1]
    assert {(d[0], 0) for d in small[1] if d[1] and first in d[1]} <= found and not any(i == 1 for _, i in found)


def test_op8(spark, small):
    rows = run(spark, small, 8).collect()
    assert len(rows) == len(small[1]) and all(r.licence_id is None and r.notices == "" for r in rows)


def test_op9(spark, small):
    groups = defaultdict(list)
    for d in small[1]:
        groups[d[1] or ""].append(d[0])
    want = sorted((d[0], max(groups[d[1] or ""]), len(groups[d[1] or ""]), d[0] == max(groups[d[1] or ""]), sha(d[1] or "")) for d in small[1])
    assert sorted(tuple(r) for r in run(spark, small, 9).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want


def test_op10(spark, small):
    got = run(spark, small, 10)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    truth = {i: y for i, y, _ in small[2]}
    rows = got.collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id) for r in rows)
    asked = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in asked) / len(asked) > 0.95
