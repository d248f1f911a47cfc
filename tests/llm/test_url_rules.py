"""URL rules against brute force: every subset counted, every rule tried on every URL."""

import random
import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from tessera.llm import url_rules as u

SCHEMA = "page_id long, url string, rule string, tokens int"


def slow_split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def slow_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in u.POLICY if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def urls(n=400):
    rnd = random.Random(2)
    out = []
    for i in range(n):
        host = rnd.choice(["a", "shop", "blog.x", "spam-farm", "WWW.News"]) + ".example." + rnd.choice(["org", "com", "net"])
        path = "/" + rnd.choice(["en", "fr", "de", "es"]) + "/" + rnd.choice(["1", "12", "33", "x"]) + rnd.choice(["", "/", ".html", "?utm=1&b", "#top"])
        out.append((i, rnd.choice(["http", "https"]) + "://" + host + path))
    out += [(1000, None), (1001, ""), (1002, "no scheme"), (1003, "https://x.org"), (1004, "https://org/"), (1005, "http://neworg/a"), (1006, "http://a.org?x=/es/"), (1007, "HTTP://ÀB.Example.ORG/es/"), (1008, "://"), (1009, "a://b://c.com/fr/"), (1010, "http://a.com:80/fr/"), (1011, "http://h.net/" + "s/" * 40000), (3, "http://dup.example.net/en/1"), (3, "http://dup.example.net/en/1"), (None, "http://y.com/de/")]
    return [(*r, "clash", 1) for r in out]


def test_equals_brute_force(spark):
    rows = urls()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = u.judge(df, min_support=0.03).collect()
    host, path = u.split_url(F.coalesce("url", F.lit("")))
    sets = {(r.page_id, r.url): tuple(r.t) for r in df.select("page_id", "url", F.when(host == "", F.array().cast("array<string>")).otherwise(u.tokens(F.col("url"), host, path)).alias("t")).collect()}
    baskets = [(sets[r[0], r[1]], v) for r in rows if (v := slow_rule(*slow_split(r[1]))[1]) and sets[r[0], r[1]]]
    alone, both = Counter(), Counter()
    for t, v in baskets:
        for k in range(1, len(t) + 1):
            for c in combinations(t, k):
                alone[c] += 1
                both[c, v] += 1
    least = -(-len(baskets) * 3 // 100)
    mined = {(c, v): n / alone[c] for (c, v), n in both.items() if n >= least and n / alone[c] >= u.MIN_CONFIDENCE}
    want = []
    for r in rows:
        h, p = slow_split(r[1])
        name, verdict = slow_rule(h, p)
        if verdict is None:
            t = set(sets[r[0], r[1]])
            best = {v: max((f for (c, w), f in mined.items() if w == v and set(c) <= t), default=0.0) for v in ("allow", "block")}
            verdict = "block" if best["block"] > best["allow"] else "allow"
        want.append((r[0], h, p, name, verdict))
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(want, key=str)
    assert len({(r.rule is None, r.verdict) for r in got}) == 4


def test_rules_are_pruned(spark):
    rows = [(["a", "b"], "block")] * 8 + [(["a", "c"], "block")] * 4 + [(["d"], "allow")] * 8
    got = {(r.verdict, tuple(r.antecedent)): r.confidence for r in u.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.1, 0.6, 2).collect()}
    assert got == {("block", ("a",)): 1.0, ("block", ("b",)): 1.0, ("block", ("c",)): 1.0, ("allow", ("d",)): 1.0}
    few = {tuple(r.antecedent) for r in u.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.1, 0.6).collect()}
    assert few == {("a",), ("b",), ("d",)}  # c has four rows only


def test_every_part_of_a_url_is_a_token(spark):
    url = "https://a.b.c.example.net/x/y/spam/casino.html?q=1&ad=2&ad=3&flag#part-7"
    host, path = u.split_url(F.lit(url))
    got = set(spark.range(1).select(u.tokens(F.lit(url), host, path)).first()[0])
    assert got == set("scheme:https top:net site:example.net name:a name:b name:c first:x seg:y seg:spam seg:casino.html end:.html key:q key:ad key:flag pair:q=# pair:ad=# mark:#part-#".split())


def test_deep_tokens_decide(spark):
    """Labels come from a rule on the host; what they share lies deep in the path or behind a query key."""
    rows = []
    for k in range(200):
        bad, host = k % 2, "example.com" if k < 120 else "other.net"
        deep = "/".join(f"p{k % 7}{c}" for c in "abcdefghij"[: k % 9]) + ("/casino/" if bad else "/news/")
        rows.append((k, f"http://{'bad' if bad else 'good'}.{host}/en/{deep}x?z={k}&{'ad' if bad else 'id'}=1", "", 1))
    policy = [("block", "bad.example.com", "/"), ("allow", "good.example.com", "/")]
    got = u.judge(spark.createDataFrame(rows, SCHEMA), policy=policy, min_support=0.05).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in got) and sum(r.rule is None for r in got) == 80


def test_long_sets_are_mined_in_pairs_of_blocks(spark):
    """Forty frequent tokens a set, one of them hot: all combinations of two tokens are counted right."""
    rnd = random.Random(4)
    rows = [([*(f"t{j:02}" for j in range(38)), f"x{k % 3}"], "block" if k % 3 else "allow") for k in range(60)] + [([f"t{j:02}" for j in rnd.sample(range(38), 2)], "allow") for _ in range(40)]
    got = {(r.verdict, tuple(r.antecedent)): (round(r.confidence, 9), round(r.support, 9)) for r in u.mine(spark.createDataFrame([(sorted(t), v) for t, v in rows], "tokens array<string>, verdict string"), 0.05, 0.55, 2).collect()}
    alone, both = Counter(), Counter()
    for t, v in rows:
        for k in (1, 2):
            for c in combinations(sorted(t), k):
                alone[c] += 1
                both[c, v] += 1
    good = {(v, c): (round(n / alone[c], 9), round(n / 100, 9)) for (c, v), n in both.items() if n >= 5 and n / alone[c] >= 0.55}
    want = {(v, c): x for (v, c), x in good.items() if len(c) == 1 or not any(good.get((v, (t,)), (0,))[0] >= x[0] for t in c)}
    assert {k: x for k, x in got.items() if len(k[1]) <= 2} == want and want


def test_long_sets_lose_no_rule(spark):
    """Thirteen frequent tokens; three far ones together decide, and no two of them do."""
    rnd = random.Random(7)
    names = [f"t{j:02}" for j in range(13)]
    rows = []
    for k in range(80):
        gone = {rnd.choice(names) for _ in range(k % 3)}
        t = [n for n in names if n not in gone]
        rows.append((t, "block" if {"t00", "t05", "t11"} <= set(t) else "allow"))
    alone, both = Counter(), Counter()
    for t, v in rows:
        for k in range(1, len(t) + 1):
            for c in combinations(t, k):
                alone[c] += 1
                both[c, v] += 1
    good = {(v, c): n / alone[c] for (c, v), n in both.items() if n >= 4 and n / alone[c] >= 0.6}
    want = {(v, c): f for (v, c), f in good.items() if not any(good.get((v, p), 0) >= f for k in range(1, len(c)) for p in combinations(c, k))}
    got = {(r.verdict, tuple(r.antecedent)): r.confidence for r in u.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.6, 2).collect()}
    assert ("block", ("t00", "t05", "t11")) in want and {k: round(x, 9) for k, x in got.items()} == {k: round(x, 9) for k, x in want.items()}


def test_long_sets_need_no_product_of_partitions(spark, monkeypatch):
    """Single tokens have no key to meet by: joined by a shuffle, 23 partitions made 529 tasks and files."""
    held, made = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}, []
    before, cut = {k: spark.conf.get(k) for k in held}, u.cut
    monkeypatch.setattr(u, "cut", lambda df: made.append((out := cut(df)).rdd.getNumPartitions()) or out)
    names = [f"t{j:02}" for j in range(13)]
    rows = [([n for j, n in enumerate(names) if (k + j) % 7], "block" if k % 3 else "allow") for k in range(40)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert u.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.6, 2).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(made) < 23 * 23


def test_one_set_in_most_rows_is_spread(spark):
    """The join back of a token set that 80 % of the rows share, without adaptive execution."""
    rows = [(k, "http://hot.example.net/en/1", "", 1) for k in range(800)] + [(1000 + k, f"http://h{k}.example.{'com' if k % 2 else 'org'}/{'fr' if k % 2 else 'en'}/{k}", "", 1) for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    want = sorted(map(tuple, u.judge(df).collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hot = u.judge(df, hot_rows=50, broadcast_sets=0)
        assert sorted(map(tuple, hot.collect())) == want
        sizes = hot.where("page_id < 1000").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 400
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_plan_is_native_and_tables_may_be_empty(spark):
    df = spark.createDataFrame(urls(30), SCHEMA)
    plan = u.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert u.judge(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/", "", 1)], SCHEMA)
    assert [(r.rule, r.verdict) for r in u.judge(one).collect()] == [(None, "allow")]
