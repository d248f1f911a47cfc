"""Decontamination against a word-by-word version, and planted cases."""

import random
import re

import numpy as np
import pytest

from tessera.llm import decontaminate as d

DOCS = "doc_id long, text string, item_id string, coverage int"
ITEMS = "item_id long, text string, doc_id long"
WORDS = "one lion under seven green hills sings about old rivers while young birds hold bright stones near small doors".split()


def prose(rnd, n):
    return " ".join(rnd.choices(WORDS, k=n)).capitalize()


QUESTION = "A farmer named Alice keeps 12 cows and 30 sheep on her land. After Alice sells 12 animals, how many kilos, at 5 kg each, does Bob carry home?"
OTHER = QUESTION.replace("Alice", "Mary").replace("Bob", "Tom").replace("12", "40").replace("30", "7").replace("5 kg", "9 lb")
BROKEN = QUESTION.replace("named Alice", "named Mary").replace("Alice sells 12", "Jane sells 17")


def plain_template(text):
    """(plain code, typed code, slot, value) of each word, word by word."""
    out, prev_end = [], None
    for m in re.finditer(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text):
        word, gap = m.group(), text[prev_end : m.start()] if prev_end is not None else None
        slot = 0
        if word[0].isdecimal():
            slot = 1
        elif gap is not None and out and out[-1][2] == 1 and len(gap) <= 1 and word.lower() in d.UNITS:
            slot = 2
        elif gap is not None and len(word) > 1 and word[0] != word[0].lower() and word[1] == word[1].lower() and not set(gap) & set(d.SENTENCE_ENDS):
            slot = 3
        low = word.lower()
        plain = {1: "<number>", 2: "<unit>"}.get(slot, low)
        out.append((plain, "<name>" if slot == 3 else plain, slot, low))
        prev_end = m.end()
    return out


def plain_windows(t):
    out = {}
    for i in range(len(t) - d.WINDOW + 1):
        part = t[i : i + d.WINDOW]
        if sum(w[2] not in (1, 2) for w in part) >= d.LITERALS:
            out.setdefault(("plain", *(w[0] for w in part)), []).append(i)
        if any(w[2] == 3 for w in part) and sum(w[2] == 0 for w in part) >= d.LITERALS:
            out.setdefault(("typed", *(w[1] for w in part)), []).append(i)
    return out


def plain_matches(text, item):
    t, q = plain_template(text), plain_template(item)
    wt, wq = plain_windows(t), plain_windows(q)
    total = len({i for v in wq.values() for i in v})
    lines = {}
    for code, places in wq.items():
        for i in places:
            for j in wt.get(code, []):
                lines.setdefault(j - i, set()).add(i)
    covered, longest = set(), 0
    for diagonal, begins in lines.items():
        words = sorted({i + k for i in begins for k in range(d.WINDOW)})
        there, back, good = {}, {}, set()
        for w in words:
            kind, a, b = q[w][2], q[w][3], t[w + diagonal][3]
            if kind not in (1, 3) or (there.setdefault((kind, a), b) == b and back.setdefault((kind, b), a) == a):
                good.add(w)
        kept = sorted(i for i in begins if all(i + k in good for k in range(d.WINDOW)))
        run = 0
        for n, i in enumerate(kept):
            run = run + i - kept[n - 1] if n and i - kept[n - 1] <= d.WINDOW else d.WINDOW
            longest = max(longest, run)
        covered |= set(kept)
    if not covered:
        return None
    coverage = len(covered) / total
    return (round(coverage, 6), longest) if coverage >= d.COVERAGE or longest >= d.RUN else None


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(6)
    items = [(k, prose(rnd, rnd.randint(3, 30)) + ". The " + prose(rnd, 4), k) for k in range(12)] + [(50, QUESTION, 1), (51, None, 1), (52, "", 1), (53, "Too short", 1), (None, "an item without any identifier is here", 1)]
    docs = []
    for i in range(120):
        text = prose(rnd, rnd.randint(0, 60))
        if i % 3 == 0:
            item = rnd.choice(items[:13])[1]
            text += rnd.choice([". ", "\n", " "]) + rnd.choice([item, item.upper(), item.lower(), " ".join(item.split(" ")[: rnd.randint(3, 20)])]) + " " + prose(rnd, 9)
        docs.append((i, text, "x", 1))
    docs += [(200, OTHER, None, None), (201, BROKEN, None, None), (202, None, None, None), (203, "", None, None), (None, QUESTION, None, None), (204, QUESTION + " " + prose(rnd, 40000), None, None), (204, QUESTION, None, None), (205, "AN ITEM without any\n identifier -- is here!", None, None), (206, "too short", None, None)]
    return docs, items


@pytest.mark.parametrize("block_chars", [d.BLOCK_CHARS, 200])
def test_equals_word_by_word(spark, case, block_chars):
    docs, items = case
    got = d.contaminated(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items + items[:2], ITEMS), block_chars=block_chars).collect()
    want = []
    for doc_id, text, *_ in docs:
        for item_id, item, _ in items:
            if text and item and (m := plain_matches(text, item)):
                want.append((doc_id, -1 if item_id is None else item_id, *m))
    assert sorted(((r.doc_id, r.item_id, round(r.coverage, 6), r.run_words) for r in got), key=str) == sorted(want, key=str)
    assert len(want) > 30


def test_reparameterised_questions_are_found_and_inconsistent_ones_not_whole(spark, case):
    docs, items = case
    found = {(r.doc_id, r.item_id): r for r in d.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert found[200, 50].coverage >= 0.95 and found[200, 50].reparameterised
    assert found[204, 50].coverage == 1.0
    assert (201, 50) not in found or found[201, 50].coverage < 1.0
    assert (205, -1) in found and not {202, 203, 206} & {k[0] for k in found}


def test_drop_keeps_clean_rows_as_they_are(spark, case):
    docs, items = case
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    dirty = {r.doc_id for r in d.contaminated(df, bench).collect()}
    for block_chars in (d.BLOCK_CHARS, 200):
        kept = d.drop_contaminated(df, bench, block_chars=block_chars)
        assert kept.columns == df.columns
        assert sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if r.doc_id not in dirty)


def test_templates_word_by_word():
    for text in (QUESTION, OTHER, "In 1,234.5 kg of GOLD, Ünal Çelik saw 5km 3 µm ß. Él İx\nJohn", "", "a", "7"):
        t, want = d.templates([text]), plain_template(text)
        assert t.slot.tolist() == [w[2] for w in want]
        assert len(set(zip(t.plain.tolist(), [w[0] for w in want]))) == len({w[0] for w in want}) == len(set(t.plain.tolist()))
        assert len(set(zip(t.typed.tolist(), [w[1] for w in want]))) == len(set(t.typed.tolist()))
    assert np.array_equal(d.templates(["a b", "c"]).owner, [0, 0, 1])


def test_empty_tables(spark, case):
    docs, items = case
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert d.contaminated(df.limit(0), bench).count() == 0
    assert d.contaminated(df, bench.limit(0)).count() == 0
    assert d.drop_contaminated(df, bench.limit(0)).count() == len(docs)


def found_in(item, *texts):
    index = d.build_index([1], [item])
    return [bool(d.matches([text], index)) for text in texts]


def test_items_of_numbers_and_names_are_found():
    sums = "Compute 3 + 4 * 5 - 6 / 7"
    assert found_in(sums, "We said: " + sums + ", then left.", "compute 3 + 4 * 5 - 6 / 7", "Now compute 9 + 2 * 8 - 1 / 4 here", "compute 9, 2, 8, 1 and 4", "compute 3 5") == [True, True, True, False, False]
    assert found_in("3 4 5 6 7 8", "so 3, 4, 5, 6, 7, 8.", "1 4 5 6 7 9") == [True, False]
    names = "Did Alice Bob Carol Dave Erin meet Frank Grace Heidi?"
    assert found_in(names, names, "did Mary Tom Jane Paul Rita meet Sven Nora Olaf?", "did Mary Tom Jane Paul Mary go Sven Nora Olaf?") == [True, True, False]
    assert found_in("0 " * 3000, "0 " * 3000, "0 1 " * 3000) == [True, False]


def test_one_telling_window_is_not_the_whole_item():
    item = "Find the sum of all 3 4 5 6 7 8 9 10"
    assert found_in(item, "Find the sum of all 3 8 1 things", item.upper(), "Find the sum of all parts") == [False, True, False]


def test_short_items_are_found_as_written():
    assert found_in("What is 3 + 4?", "Quiz:\n  What is  3 + 4?\nseven", "What is 3 + 5?", "what is 3 + 4?") == [True, False, False]
    assert found_in("What is 3 + 4?", "He asked: What is\n3 + 4? Seven!", "What is 3 + 4", "So what is 3 + 4?") == [True, False, False]
    assert found_in("is 12", "This is 12, no more", "this 12", "his 12", "is 123", "is 12") == [True, False, False, False, True]
    assert found_in("Why?", "Why?", "So Why? Because", "a\n Why? \nb") == [True, False, True]


def test_every_verbatim_item_is_found():
    """Items made at random of words, names, numbers, units and signs, put between other words."""
    rnd = random.Random(9)
    bits = [*WORDS, "Alice", "Bob", "NASA", "12", "3.5", "1,000", "kg", "-", "+", "*", "/", "=", "?", "!", ".", "(", ")", "中文", "é", "x", "7", "90 or 91?"]
    for n in range(400):
        item = " ".join(rnd.choices(bits if n % 3 else bits[len(WORDS) + 2 :], k=rnd.randint(2, 25)))
        if len(d.templates([item]).owner) < 2:
            continue
        text = prose(rnd, rnd.randint(0, 30)) + rnd.choice([" ", ". ", "\n"]) + item.replace(" ", rnd.choice([" ", "  ", "\n"])) + rnd.choice([" ", "\n", ". "]) + prose(rnd, rnd.randint(0, 30))
        assert found_in(item, text) == [True], (item, text)
    assert found_in("12 + 34 * 56 - 78 = 90 or 91?", "We know 12 + 34 * 56 - 78 = 90 or 91? Yes") == [True]


def test_many_equal_windows_on_both_sides(monkeypatch):
    line = "the same seven words again and again. "
    texts, items = [line * 50, "nothing", line * 3 + "end", QUESTION], [line * 40, QUESTION, "other words that are in none of these"]
    index = d.build_index([1, 2, 3], items)
    whole = d.matches(texts, index)
    monkeypatch.setattr(d, "HITS", 50)
    assert d.matches(texts, index) == whole and {(m[0], m[1]) for m in whole} >= {(0, 0), (3, 1)}


def test_names_that_begin_sentences_and_values_that_become_one():
    item = "Tom has 3 apples. Tom buys 5 more. How many apples does Tom have?"
    other = item.replace("Tom", "Ann").replace("3", "7").replace("5", "2")
    assert found_in(item, other, item.replace("3", "4").replace("5", "4"), "Well, " + other, item.lower()) == [True] * 4
    assert found_in(item, other.replace("Ann buys", "Bob buys"), other.replace("apples", "pears")) == [False, False]
    assert found_in(QUESTION, OTHER.replace("40", "7"), QUESTION.replace("30", "12")) == [True, True]
