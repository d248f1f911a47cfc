"""BPE against the tokenizers library, id by id."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from pyspark.sql import functions as F

from tessera.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["a", "b", "'", "s", "t", "re", "ll", "ve", "d", "m", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "1", "²", "Ⅷ", "é", "中", "!", "_", "-", "🎉", "́", "<|endoftext|>", "\r", "　", "​", "'S", "the", " of"]


@pytest.fixture(scope="module")
def source():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def texts():
    rnd = random.Random(4)
    return ["".join(rnd.choices(SIGNS, k=rnd.randint(0, 40))) for _ in range(3000)] + ["", "a" * 3000, " " * 500, "aaaa aaaaa aaa", "\x00�", "thing " * 9000]


def test_ids_and_texts_are_those_of_the_library(source):
    library, encoder, decoder = Tokenizer.from_file(PATH), bpe.Encoder(source), bpe.Decoder(source)
    every = texts()
    for k in range(0, len(every), 500):
        part = every[k : k + 500]
        ids, bounds = encoder.encode(part)
        decoded = decoder.decode(ids, bounds)
        for i, want in enumerate(library.encode_batch(part, add_special_tokens=False)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want.ids
            assert decoded[i] == library.decode(want.ids, skip_special_tokens=False) == part[i]


def test_word_starts_follow_the_pattern():
    import regex

    for text in texts():
        cps, bounds = bpe.flat_codepoints([text])
        if text:
            at = [*bpe.word_starts(cps, bounds).nonzero()[0].tolist(), len(text)]
            assert [text[a:b] for a, b in zip(at[:-1], at[1:])] == regex.findall(bpe.SPLIT, text)


def test_the_table_of_words_starts_anew(source, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    encoder, library = bpe.Encoder(source), Tokenizer.from_file(PATH)
    for text in texts()[:50]:
        ids, _ = encoder.encode([text, text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids * 2


def test_frames_nulls_extra_columns_and_broken_bytes(spark, source):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "it's", None)], "doc_id long, text string, tokens string")
    got = bpe.decode(bpe.encode(df, source), source).collect()
    assert [(r.doc_id, r.text, r.tokens, r.decoded) for r in got] == [(1, None, "x", ""), (1, "", "y", ""), (None, "it's", None, "it's")]
    assert [r.ids for r in got][:2] == [[], []]
    broken = spark.createDataFrame([([164],), (None,), ([50256],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(broken, source).collect()] == [Tokenizer.from_file(PATH).decode([164]), "", "<|endoftext|>"]
    assert bpe.encode(df.limit(0), source).count() == 0


def test_ids_that_no_token_has_decode_to_nothing(spark):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        source = f.read()
    df = spark.createDataFrame([(1, [50257, 99999999, -1, None]), (2, None), (3, [])], "doc_id long, ids array<int>")
    some = bpe.encode(spark.createDataFrame([(4, "a b", "x")], "doc_id long, text string, IDS string"), source)
    assert some.columns == ["doc_id", "text", "IDS", "ids_"]
    mixed = some.select("doc_id", F.concat(F.array(F.lit(-5)), "ids_", F.array(F.lit(10**8))).alias("ids"))
    got = {r.doc_id: r.decoded for r in bpe.decode(df.unionByName(mixed), source).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "a b"}
