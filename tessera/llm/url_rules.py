"""URL filtering by a rule list and by mined association rules, in DataFrame functions only.

A short policy list decides the URLs that one of its rules fits. These verdicts are the labels
for the rest: FP-growth mines which combinations of URL tokens go with a verdict; combinations
are kept above a least support and confidence, and a rule that a shorter, at least as confident
one covers is dropped. A URL that the list leaves open is matched against the mined rules
through an inverted index that files a rule under its rarest token: the rules filed under a URL's
tokens are compared with all of these, and the most confident one that fits decides (ties: allow; none: allow).

Every host label, path segment, query key and query pair of a URL is a token. Only tokens with the least
support are mined, which loses no rule. A set of up to ``TOGETHER`` of them is mined whole. A larger one
is cut into blocks of ``BLOCK`` tokens, and each two blocks are mined together, so that a transaction never has
more than 2**TOGETHER subsets, however long its URL. What needs three blocks, or is frequent only over
several sets' blocks, is found level by level (``_levels``), which loses no rule either. As such a set
gives several transactions, mining only proposes combinations; support and confidence are counted
anew over the labelled sets, each weighted by its URLs. URLs are matched by their distinct token sets;
the few sets that very many URLs share are joined back by broadcast.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import only
from tessera.runtime import cut

#: (verdict, host, start of path): a rule fits its host and all subdomains.
POLICY = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.6
#: Labelled URLs that a mined combination needs at least, however few there are.
LEAST_COUNT = 5
#: Frequent tokens that are mined together, and the size of a block where a URL has more.
TOGETHER, BLOCK = 10, 4
#: Rows of mined rules or of fired sets up to this number are broadcast; more are shuffled.
BROADCAST_RULES = 20_000
#: URLs beyond which a token set is joined back by broadcast; there are at most rows / HOT_ROWS of these.
HOT_ROWS = 1_000_000
#: Copies of a labelled set that one row stands for before they are laid out for mining.
COPIES = 10_000
#: Digits of a token's place by rarity.
PLACE = 9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def policy_rule(host: Column, path: Column, policy: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text, host and path together, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(policy, key=lambda r: (len(r[1] + r[2]), r)):  # later ones win
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The URL's distinct tokens, sorted."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    shape = lambda s: F.regexp_replace(s, "[0-9]+", "#")
    tag = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(kind + ":"), v))
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)
    pairs = F.filter(F.split(F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1), "&"), lambda p: p != "")
    single = {
        "scheme": F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1),
        "top": F.element_at(labels, -1),
        "site": F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), "."),
        "end": F.when(F.endswith(path, F.lit("/")), F.lit("/")).otherwise(F.regexp_extract(path, "(\\.[A-Za-z0-9]{1,8})$", 1)),
        "mark": shape(F.regexp_extract(url, "(#.*)$", 1)),
    }
    lists = {
        "name": F.slice(labels, F.lit(1), F.greatest(n - 2, F.lit(0))),
        "first": F.slice(segments, 1, 1),
        "seg": F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))),
        "key": F.transform(pairs, lambda p: F.regexp_extract(p, "^[^=]*", 0)),
        "pair": F.transform(F.filter(pairs, lambda p: F.contains(p, F.lit("="))), shape),
    }
    made = F.array(*(F.when(v != "", F.concat(F.lit(k + ":"), v)) for k, v in single.items()))
    return F.sort_array(F.array_distinct(F.array_compact(F.concat(made, *(tag(k, v) for k, v in lists.items())))))


def _transactions(items: Column) -> Column:
    """What a sorted set of frequent tokens is mined as: itself, or each two of its blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / BLOCK).cast("int") - 1), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    two = F.transform(blocks, lambda x, i: F.transform(F.slice(blocks, i + 2, F.size(blocks)), lambda y: F.concat(x, y)))
    return F.when(F.size(items) <= TOGETHER, F.array(items)).otherwise(F.flatten(two))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, least_count: int = LEAST_COUNT) -> DataFrame:
    """(rule_id, verdict, confidence, support, antecedent, token) mined from (tokens, verdict).

    ``token`` is the antecedent's rarest. A combination needs a share of ``min_support`` and
    ``least_count`` rows. The rules don't depend on the order of rows. No labelled rows, no rules.
    """
    spark = labelled.sparkSession
    schema = "rule_id long, verdict string, confidence double, support double, antecedent array<string>, token string"
    sets = cut(labelled.where("verdict IS NOT NULL AND size(tokens) > 0").groupBy("tokens", "verdict").agg(F.count(F.lit(1)).alias("n")))
    n = sets.agg(F.sum("n")).first()[0] or 0
    least = max(math.ceil(min_support * n - 1e-9), least_count)
    if n < least or not n:
        return spark.createDataFrame([], schema)
    parts = sets.select("tokens", "verdict", "n", F.explode("tokens").alias("token"))
    seen = parts.groupBy("token", "verdict").agg(F.sum("n").alias("n"))
    # each of these tokens is in a share of min_support of the sets, so there are few: the mean set's size over it
    often = seen.groupBy("token").agg(F.sum("n").alias("rows"), F.max("n").alias("most")).where(F.col("most") >= least).select("token", "rows").collect()
    if not often:
        return spark.createDataFrame([], schema)
    # a place by rarity in front of each token: sorted sets begin with their rarest token
    places = [(t, f"{k:0{PLACE}d}{t}") for k, (t, _) in enumerate(sorted(often, key=lambda r: (r["rows"], r["token"])))]
    ranked = spark.createDataFrame(places, "token string, item string")
    side = F.broadcast(ranked) if len(places) <= BROADCAST_RULES else ranked
    kept = parts.join(side, "token").groupBy("tokens", "verdict", "n").agg(F.sort_array(F.collect_list("item")).alias("items"))
    sets = cut(kept.groupBy("items", "verdict").agg(F.sum("n").alias("n")))
    # one row for each URL and transaction; a set of very many URLs is dealt out before it is laid out
    goal = F.concat(F.lit("verdict="), "verdict")
    dealt = sets.select(F.explode(_transactions(F.col("items"))).alias("t"), goal.alias("goal"), "n").select(F.concat("t", F.array("goal")).alias("items"), F.explode(F.expr(f"sequence(0, n - 1, {COPIES})")).alias("from"), "n")
    dealt = dealt.select("items", F.least(F.col("n") - F.col("from"), F.lit(COPIES)).cast("int").alias("n"))
    rows = dealt.agg(F.sum("n")).first()[0]
    baskets = dealt.repartition(spark.sparkContext.defaultParallelism).select("items", F.explode(F.sequence(F.lit(1), F.col("n")))).select("items")
    found = FPGrowth(itemsCol="items", minSupport=max(least - 0.5, 0.5) / rows).fit(baskets).freqItemsets
    verdicts = F.filter("items", lambda t: F.startswith(t, F.lit("verdict=")))
    proposed = found.select(F.get(verdicts, F.lit(0)).alias("goal"), F.sort_array(F.array_except("items", verdicts)).alias("placed")).where("goal IS NOT NULL AND size(placed) > 0")
    if not sets.where(F.size("items") > TOGETHER).isEmpty():
        proposed = proposed.unionByName(_levels(sets, least).crossJoin(F.broadcast(sets.select(goal.alias("goal")).distinct()))).distinct()
    antecedent = F.sort_array(_bare("placed"))
    filed = proposed.select(F.substring("goal", 9, 1000).alias("verdict"), antecedent.alias("antecedent"), F.get(_bare("placed"), F.lit(0)).alias("token"))
    filed = cut(filed.withColumn("rule_id", F.xxhash64("verdict", "antecedent")))
    # support and confidence over the labelled sets
    hits = _fitting(sets.select(_bare("items").alias("items"), F.col("verdict").alias("said"), "n"), "items", filed)
    counted = hits.groupBy("rule_id").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("said") == F.col("verdict"), F.col("n"))).alias("both"))
    good = counted.where((F.col("both") >= least) & (F.col("both") / F.col("all") >= min_confidence))
    named = cut(filed.join(good, "rule_id").select("rule_id", "verdict", (F.col("both") / F.col("all")).alias("confidence"), (F.col("both") / n).alias("support"), "antecedent", "token"))
    # a rule is idle if one with some of its tokens, the same verdict and no less confidence exists: its
    # at most 1,022 smaller combinations are looked up, so the work grows with the rules, not their pairs
    # (those of the rare longer ones are looked up as a URL's rules are)
    masks = F.expr("sequence(1, shiftleft(1, size(antecedent)) - 2)")
    part = F.transform(masks, lambda m: F.filter("antecedent", lambda t, i: F.getbit(m, i) == 1))
    smaller = named.where(f"size(antecedent) BETWEEN 2 AND {TOGETHER}").select("rule_id", "verdict", F.col("confidence").alias("least"), F.explode(part).alias("antecedent"))
    covered = smaller.join(named.select("verdict", "antecedent", "confidence"), ["verdict", "antecedent"]).where("confidence >= least").select("rule_id").distinct()
    long = named.where(F.size("antecedent") > TOGETHER).select(F.col("rule_id").alias("long_id"), F.col("verdict").alias("same"), F.col("confidence").alias("least"), F.col("antecedent").alias("whole"))
    if not long.isEmpty():
        within = _fitting(long, "whole", named).where((F.col("same") == F.col("verdict")) & (F.col("confidence") >= F.col("least")) & (F.size("antecedent") < F.size("whole")))
        covered = covered.unionByName(within.select(F.col("long_id").alias("rule_id"))).distinct()
    return named.join(covered, "rule_id", "left_anti")


def _levels(sets: DataFrame, least: int) -> DataFrame:
    """(placed) every combination that can be a rule of the weighted sets (items, verdict, n), whatever their length.

    A combination found in the same rows as a part of it says no more than the part, and one of whose rows all
    have one verdict can't be bettered. So only combinations that are rarer than each of their parts, with ``least``
    rows of a verdict and with rows of another, are joined to longer ones; that drops rules only that a shorter one covers.
    """
    said = cut(sets.select("items", F.col("verdict").alias("said"), "n"))

    def counted(candidates: DataFrame) -> DataFrame:
        hits = _fitting(said, "items", candidates.withColumn("token", F.get("antecedent", F.lit(0))))
        by = hits.groupBy("antecedent", "said").agg(F.sum("n").alias("n"))
        return by.groupBy("antecedent").agg(F.sum("n").alias("all"), F.max("n").alias("most")).where(F.col("most") >= least)

    single = said.select(F.explode("items").alias("item")).distinct()
    now = cut(counted(single.select(F.array("item").alias("antecedent"))))
    out, k = now.select(F.col("antecedent").alias("placed")), 1
    while True:
        open_ = cut(now.where("most < all").select("antecedent", "all"))
        head, last = F.slice("antecedent", 1, k - 1) if k > 1 else F.array().cast("array<string>"), F.element_at("antecedent", k)
        a, b = open_.select(head.alias("head"), last.alias("x")), open_.select(head.alias("head"), last.alias("y"))
        # single tokens have no head to meet by: shuffled, they would be a product of all partitions; they are few
        b = F.broadcast(b) if k == 1 or open_.count() <= BROADCAST_RULES else b
        longer = cut(a.join(b, "head").where("x < y").select(F.concat("head", F.array("x", "y")).alias("longer")))
        if longer.isEmpty():
            return out
        # all parts that lack one token must be there; the rarest of them bounds the rows
        part = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda j: F.filter("longer", lambda t, i: i != j))
        parts = longer.select("longer", F.explode(part).alias("antecedent")).join(open_, "antecedent").groupBy("longer").agg(F.count(F.lit(1)).alias("parts"), F.min("all").alias("rows"))
        candidates = cut(parts.where(F.col("parts") == k + 1).select(F.col("longer").alias("antecedent"), "rows"))
        now = cut(counted(candidates.select("antecedent")).join(candidates, "antecedent").where("all < rows").select("antecedent", "all", "most"))
        if now.isEmpty():
            return out
        out, k = out.unionByName(now.select(F.col("antecedent").alias("placed"))), k + 1


def _bare(items: str) -> Column:
    """Items without the places in front of their tokens."""
    return F.transform(items, lambda t: F.substring(t, PLACE + 1, 1 << 30))


def _fitting(sets: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """Rows of ``sets`` beside each rule whose tokens its array ``column`` has all."""
    index = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    return sets.withColumn("token", F.explode(column)).join(index, "token").where(F.forall("antecedent", lambda t: F.array_contains(column, t)))


def fire(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined_verdict, confidence) for each of the distinct token sets that a rule fits."""
    hits = _fitting(sets.select("tokens"), "tokens", cut(rules))
    sure = hits.groupBy("tokens").agg(F.max(F.when(F.col("verdict") == "block", F.col("confidence"))).alias("block"), F.max(F.when(F.col("verdict") == "allow", F.col("confidence"))).alias("allow"))
    blocked = F.coalesce(F.col("block"), F.lit(0.0)) > F.coalesce(F.col("allow"), F.lit(0.0))
    return sure.select("tokens", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")).alias("mined_verdict"), F.greatest(F.coalesce("block", F.lit(0.0)), F.coalesce("allow", F.lit(0.0))).alias("confidence"))


def _with_verdicts(rows: DataFrame, rules: DataFrame, hot_rows: int, broadcast_sets: int) -> DataFrame:
    """``rows`` with mined_verdict and confidence, null where no rule fits their tokens."""
    sets = rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    fired = cut(fire(sets, rules))
    if fired.count() <= broadcast_sets:
        return rows.join(F.broadcast(fired), "tokens", "left")
    # a set that very many rows share would be one key of the shuffle: these few sets are broadcast
    hot = cut(sets.where(F.col("n") > hot_rows).select("tokens").join(fired, "tokens", "left"))
    cold = rows.join(F.broadcast(hot.select("tokens")), "tokens", "left_anti").join(fired.hint("merge"), "tokens", "left")
    return cold.unionByName(rows.join(F.broadcast(hot), "tokens").select(cold.columns))


def judge(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    policy: list[tuple[str, str, str]] | None = None,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    hot_rows: int = HOT_ROWS,
    broadcast_sets: int = BROADCAST_RULES,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, confidence.

    ``rule`` is the policy rule that decides, or null where the mined rules do; ``confidence`` is
    the deciding mined rule's, else null. Null, empty and malformed URLs have an empty host
    and path, fit no rule and are allowed. Repeated rows give repeated rows; an empty table
    gives an empty result; other columns are not looked at.
    """
    url = F.coalesce("url", F.lit(""))
    rows = only(df, page_id=id_col, url=url_col)
    host, path = split_url(url)
    rows = rows.withColumns({"host": host, "path": path})
    name, verdict = policy_rule(F.col("host"), F.col("path"), POLICY if policy is None else policy)
    made = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(tokens(url, F.col("host"), F.col("path")))
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("given"), made.alias("tokens"))
    rules = mine(rows.select("tokens", F.col("given").alias("verdict")), min_support, min_confidence)
    # rows that the policy decides and those without tokens stay out of the join
    decided = rows.where("given IS NOT NULL OR size(tokens) = 0").select("page_id", "host", "path", "rule", F.coalesce("given", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    left = _with_verdicts(rows.where("given IS NULL AND size(tokens) > 0").select("page_id", "host", "path", "rule", "tokens"), rules, hot_rows, broadcast_sets)
    return decided.unionByName(left.select("page_id", "host", "path", "rule", F.coalesce("mined_verdict", F.lit("allow")).alias("verdict"), "confidence"))


def judge_sql(table: str = "pages") -> str:
    """``judge`` in DuckDB's SQL, by counting every combination of every labelled set.

    For tables whose labelled URLs have at most ``TOGETHER`` frequent tokens, where nothing is cut into blocks.
    """
    shape = lambda s: f"regexp_replace({s}, '[0-9]+', '#', 'g')"
    tag = lambda kind, values: f"list_transform({values}, lambda v: '{kind}:' || v)"
    single = {
        "scheme": "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)",
        "top": "labels[-1]",
        "site": "array_to_string(labels[greatest(len(labels) - 1, 1):], '.')",
        "end": "CASE WHEN ends_with(path, '/') THEN '/' ELSE regexp_extract(path, '(\\.[A-Za-z0-9]{1,8})$', 1) END",
        "mark": shape("regexp_extract(url, '(#.*)$', 1)"),
    }
    lists = {"name": "labels[:greatest(len(labels) - 2, 0)]", "first": "segments[:1]", "seg": "segments[2:]", "key": "list_transform(pairs, lambda p: regexp_extract(p, '^[^=]*', 0))", "pair": f"list_transform(list_filter(pairs, lambda p: contains(p, '=')), lambda p: {shape('p')})"}
    made = ", ".join(f"CASE WHEN {v} <> '' THEN '{k}:' || {v} END" for k, v in single.items())
    every = f"list_filter([{made}], lambda x: x IS NOT NULL)" + "".join(f" || {tag(k, v)}" for k, v in lists.items())
    rules = sorted(POLICY, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    name, given = ("CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(v, h, p)}'" for v, h, p in rules) + " END" for value in (lambda v, h, p: h + p, lambda v, h, p: v))
    return f"""
    WITH u AS (SELECT row_number() OVER () AS k, page_id, coalesce(url, '') AS url FROM {table}),
    r AS (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
    h AS (SELECT k, page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    s AS (SELECT *, string_split(host, '.') AS labels, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: {shape("x")}) AS segments,
          list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '') AS pairs FROM h),
    t AS (SELECT k, page_id, host, path, {name} AS rule, {given} AS given, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct({every})) END AS tokens FROM s),
    l AS (SELECT * FROM t WHERE given IS NOT NULL AND len(tokens) > 0),
    n AS (SELECT greatest(ceil({MIN_SUPPORT} * count(*) - 1e-9), {LEAST_COUNT}) AS least FROM l),
    o AS (SELECT DISTINCT token FROM (SELECT token, given FROM (SELECT unnest(tokens) AS token, given FROM l) GROUP BY token, given HAVING count(*) >= (SELECT least FROM n))),
    b AS (SELECT k, given, list(token ORDER BY token) AS items FROM (SELECT k, given, unnest(tokens) AS token FROM l) JOIN o USING (token) GROUP BY k, given),
    c AS (SELECT given, list_filter(items, lambda x, i: (mask // (1 << (i - 1))) % 2 = 1) AS part FROM (SELECT given, items, unnest(range(1, CAST(1 << len(items) AS BIGINT))) AS mask FROM b)),
    a AS (SELECT part, count(*) AS n, count(*) FILTER (WHERE given = 'block') AS block, count(*) FILTER (WHERE given = 'allow') AS allow FROM c GROUP BY part),
    m AS (SELECT part, 'block' AS verdict, block / n AS confidence FROM a WHERE block >= (SELECT least FROM n) AND block / n >= {MIN_CONFIDENCE}
          UNION ALL SELECT part, 'allow', allow / n FROM a WHERE allow >= (SELECT least FROM n) AND allow / n >= {MIN_CONFIDENCE}),
    f AS (SELECT t.k, coalesce(max(m.confidence) FILTER (WHERE verdict = 'block'), 0) AS block, coalesce(max(m.confidence) FILTER (WHERE verdict = 'allow'), 0) AS allow
          FROM t JOIN m ON list_has_all(t.tokens, m.part) WHERE t.given IS NULL GROUP BY t.k)
    SELECT t.page_id, t.host, t.path, t.rule, coalesce(t.given, CASE WHEN f.block > f.allow THEN 'block' ELSE 'allow' END) AS verdict, greatest(f.block, f.allow) AS confidence
    FROM t LEFT JOIN f ON f.k = t.k
    """
