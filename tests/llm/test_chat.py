"""Chat formatting: exact round trips and examples against a plain version."""

import random

from pyspark.sql import functions as F

from tessera.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, whole string, e int"
BITS = [*chat.CONTROLS, chat.TURN, chat.TEXT, chat.END, "\\", "|", "<", "[", "/s>", "INST]", "a", "é", "🎉", "\n", " ", "s>", "\\\\"]


def slow_escape(text):
    text = text.replace("\\", "\\\\")
    for c in chat.CONTROLS:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def conversations(seed=1, n=80):
    rnd = random.Random(seed)
    text = lambda: "".join(rnd.choices(BITS, k=rnd.randint(0, 9)))
    out = []
    for c in range(n):
        for t in range(rnd.randint(1, 7)):
            out.append((c, t, rnd.choice(["user", "assistant", "system", text(), "assistant", None]), rnd.choice([text(), text(), None]), "w", 1))
    out += [(500, t, "assistant" if t % 2 else "user", f"turn {t} " * 20, None, None) for t in range(300)]
    out += [(501, 3, "assistant", "tie b", None, None), (501, 3, "assistant", "tie a", None, None), (501, None, "user", "first", None, None), (501, 3, "assistant", "tie a", None, None)]
    out += [(None, 0, "user", "x", None, None), (None, 1, "assistant", "y", None, None), (502, 0, "user", "z" * 400000, None, None)]
    rnd.shuffle(out)
    return out


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def test_examples_equal_a_plain_version(spark):
    rows = conversations()
    got = {}
    for r in chat.examples(spark.createDataFrame(rows, SCHEMA).repartition(5)).orderBy("conv_id", "example_no").collect():
        got.setdefault(r.conv_id, []).append((r.text, r.loss_start, r.loss_end, r.is_last))
    want = {}
    for c, turns in grouped(rows).items():
        text = ""
        for k, (role, body) in enumerate(turns):
            text += chat.TURN + slow_escape(role) + chat.TEXT + slow_escape(body) + chat.END
            last, stop = k == len(turns) - 1, len(text) - len(chat.END)
            if role == "assistant":
                want.setdefault(c, []).append((text, stop - len(slow_escape(body)), stop, last))
            elif last:
                want.setdefault(c, []).append((text, len(text), len(text), last))
    assert got == want


def test_everything_reads_back(spark):
    rows = conversations(2)
    got = {r.conv_id: r for r in chat.read_back(chat.examples(spark.createDataFrame(rows, SCHEMA))).collect()}
    want = grouped(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert "".join(got[c].losses) == "".join(t for r, t in turns if r == "assistant")


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rnd = random.Random(5)
    texts = [("".join(rnd.choices(BITS, k=rnd.randint(0, 12))),) for _ in range(4000)]
    got = spark.createDataFrame(texts, "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    for r in got:
        assert r.u == r.t and r.e == slow_escape(r.t)
        assert not any(c in r.e for c in chat.CONTROLS)


def test_plan_is_native_and_expands_without_a_second_shuffle(spark):
    df = spark.createDataFrame(conversations(), SCHEMA)
    plan = chat.read_back(chat.examples(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange ") <= 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.examples(empty).count() == 0
    assert chat.read_back(chat.examples(empty)).count() == 0
