"""Cross-entropy difference between a target and a background n-gram model.

Both models are bigram models of words over one vocabulary: the words of all texts, counted in all
texts. Words are runs of letters and digits in lower case; every other sign but white space, and every
sign of scripts that don't part words, is a word of its own. The models match: one order, one vocabulary,
one smoothing, and the background, which is all texts but the target's, is scaled to the target's number of
tokens. A text is scored by models that leave its own counts out, so target texts aren't
judged by what they taught. Its score is the mean over its tokens of background loss minus target
loss in nats: the higher, the more it reads like the target. The loss under the model of
the whole corpus comes along; it is low for texts that the corpus has again.

The counts grow with the corpus and are never gathered in one place. Texts are dealt into chunks of
bounded size. A chunk sends its distinct n-grams with its counts to as many buckets of hashes as there are, packed
in arrays; a bucket adds up what all chunks sent and answers each chunk with the sums of its own
n-grams, in the order in which they were sent. An answer holds no hashes: a chunk finds its distinct
n-grams again from its texts. Chunks then score their texts. A frequent n-gram is one entry from each
chunk, however often it occurs, so none is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.batches import cut_text, flat_codepoints
from tessera.llm.words import folding, mix, runs, word_hashes
from tessera.runtime import fresh

#: Strength of the lower order in each step of the interpolation, in tokens.
STRENGTH = 5.0
#: Chance of a word that no other text has, as one of very many alike.
UNSEEN = 2.0**-20
#: Identifiers of target texts up to this number are broadcast, more are shuffled.
BROADCAST_IDS = 2_000_000
#: Bytes of text whose counts or scores one group holds, unless one text has more.
CHUNK_BYTES = 10 << 20
#: Signs that are turned into words at a time.
PIECE = 1 << 20
#: The first sign of the scripts whose words aren't parted by blanks.
UNPARTED = 0x3000
NAMES = ("n_tokens", "loss_target", "loss_background", "loss_corpus", "score")
_ODD = np.uint64(0x9FB21C651E98DF25)
#: The bits of an n-gram's hash that are told apart: 56, which are a byte shorter to send.
KEPT = np.uint64(0xFFFFFFFFFFFFFF00)
BEGIN, END, TOTAL = (mix(np.array([k], dtype=np.uint64))[0] & KEPT for k in (11, 12, 13))


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many each text has."""
    letter, lower, blank = folding()
    cps, bounds = flat_codepoints(texts)
    if not len(cps):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    low = lower[cps]
    inside = letter[low] & (low < UNPARTED)
    starts, ends = runs(inside, bounds)
    alone = np.flatnonzero(~inside & ~blank[low])
    starts, ends = np.concatenate([starts, alone]), np.concatenate([ends, alone + 1])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return word_hashes(low, starts, ends) & KEPT, np.diff(np.searchsorted(starts, bounds))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """BEGIN, the words and END of each text in one array, and the texts' bounds in it.

    Long texts are read in pieces that end at a blank, so memory goes by words, not signs.
    """
    parts: list[np.ndarray] = []
    sizes = np.zeros(len(texts), np.int64)
    held: list[tuple[int, str]] = []
    room = PIECE

    def work() -> None:
        codes, n = _words([p for _, p in held])
        np.add.at(sizes, [k for k, _ in held], n)
        parts.append(codes)
        held.clear()

    for k, text in enumerate(texts):
        for piece in cut_text(text, PIECE):
            if room < len(piece) and held:
                work()
                room = PIECE
            held.append((k, piece))
            room -= len(piece)
    if held:
        work()
    bounds = np.concatenate([[0], np.cumsum(sizes + 2)])
    flat = np.full(bounds[-1], BEGIN, dtype=np.uint64)
    inner = np.ones(len(flat), dtype=bool)
    inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
    flat[bounds[1:] - 1] = END
    flat[inner] = np.concatenate([*parts, np.zeros(0, np.uint64)])
    return flat, bounds


def _bigrams(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all tokens but BEGIN, and their bigrams' hashes."""
    at = np.ones(len(flat), dtype=bool)
    at[bounds[:-1]] = False
    at = np.flatnonzero(at)
    return at, mix(mix(flat[at - 1]) * _ODD + flat[at]) & KEPT


def _packed(x: np.ndarray) -> bytes:
    """The bytes of 8-byte numbers, all first ones first: sorted and small numbers then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(packed: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def _slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` signs together, or single ones."""
    start = total = 0
    for k, t in enumerate(texts):
        if k > start and total + len(t) > most:
            yield start, k
            start, total = k, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def _added(codes: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct codes in order, and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else order
    return codes[heads], *(np.add.reduceat(c[order], heads) if len(codes) else c for c in counts)


def chunk_counts(texts: list[str], target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of a chunk, and their counts in target and other texts."""
    held = []
    for a, b in _slices(texts, 2 * PIECE):
        flat, bounds = tokens(texts[a:b])
        at, pairs = _bigrams(flat, bounds)
        own = np.repeat(target[a:b], np.diff(bounds))
        n = [np.count_nonzero(own[at] == x) for x in (True, False)]
        codes = np.concatenate([flat, pairs, [TOTAL]])
        own = np.concatenate([own, own[at]])
        held.append(_added(codes, *(np.append(own == x, k).astype(np.int64) for x, k in zip((True, False), n, strict=True))))
    return _added(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _look(codes: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not len(known[0]):
        return (np.zeros(len(codes)),) * 2
    at = np.minimum(np.searchsorted(known[0], codes), len(known[0]) - 1)
    there = known[0][at] == codes
    return np.where(there, known[1][at], 0).astype(float), np.where(there, known[2][at], 0).astype(float)


def _own(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each code is in its own text."""
    _, number, n = np.unique(codes * _ODD + mix(owner.astype(np.uint64)), return_inverse=True, return_counts=True)
    return n[number].astype(float)


def score_texts(texts: list[str], target: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray], strength: float = STRENGTH) -> np.ndarray:
    """Rows n_tokens, loss_target, loss_background, loss_corpus of counted texts, given the corpus' counts."""
    sums = _look(np.array([TOTAL]), known)
    scale = sums[0][0] / sums[1][0] if sums[1][0] else 0.0
    out = np.zeros((4, len(texts)))
    for a, b in _slices(texts, 2 * PIECE):
        flat, bounds = tokens(texts[a:b])
        at, pairs = _bigrams(flat, bounds)
        owner = np.repeat(np.arange(b - a), np.diff(bounds))
        mine = target[a:b][owner]
        own1, own2 = _own(flat, owner), _own(pairs, owner[at])
        n1, n2 = _look(flat, known), _look(pairs, known)
        size = (np.diff(bounds) - 1).astype(float)
        first = bounds[:-1] - np.arange(b - a)  # of each text among the tokens but BEGIN

        def loss(one: np.ndarray, two: np.ndarray, total: np.ndarray) -> np.ndarray:
            p1 = (one[at] + strength * UNSEEN) / (total[owner[at]] + strength)
            p2 = (two + strength * p1) / (one[at - 1] + strength)
            return np.add.reduceat(-np.log(p2), first) / size

        # counts without the text's own, never below zero
        less = lambda n, own, when: np.maximum(n - np.where(when, own, 0), 0)
        t, o = (less(n1[0], own1, mine), less(n2[0], own2, mine[at])), (less(n1[1], own1, ~mine), less(n2[1], own2, ~mine[at]))
        nt, no = less(sums[0][0], size, target[a:b]), less(sums[1][0], size, ~target[a:b])
        out[0, a:b] = size
        out[1, a:b] = loss(*t, nt)
        out[2, a:b] = loss(o[0] * scale, o[1] * scale, no * scale)
        out[3, a:b] = loss(t[0] + o[0], t[1] + o[1], nt + no)
    return out


def flag_targets(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", target_col: str = "target", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` with a last column that is true for identifiers in ``targets``; null ones are in none.

    A taken name is lengthened by underscores. Texts are not shuffled for it as long as the targets'
    identifiers are few enough to be broadcast (8 bytes each, counted first); more are joined by a shuffle.
    """
    flag, key = fresh(target_col, docs), fresh("__id", docs)
    ids = targets.select(F.col(f"`{id_col}`").alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    side = F.broadcast(ids) if ids.count() <= broadcast_ids else ids.hint("merge")
    out = docs.join(side, F.col(f"`{id_col}`") == F.col(key), "left")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce(flag, F.lit(False)).alias(flag))


def add_scores(df: DataFrame, text_col: str = "text", target_col: str = "target", names: tuple[str, ...] = NAMES, strength: float = STRENGTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``df`` with tokens, the mean losses under the target's, the background's and the corpus' model,
    and background minus target loss, for each whole text.

    A null or empty text has one token, its end; a null flag is false. Without any target text both
    models are empty and every score is 0. Repeated rows count as texts of their own. All columns stay;
    a new name that is taken (case ignored) is lengthened by underscores. An empty table gives an empty one. A text
    of any length is held in memory whole, with some 40 bytes a sign.
    """
    spark = df.sparkSession
    taken, fields = df, []
    for name, kind in zip(names, (T.LongType(), *(T.DoubleType(),) * 4), strict=True):
        fields.append(T.StructField(fresh(name, taken), kind))
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`"))).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    parallel = min(spark.sparkContext.defaultParallelism, max(size["rows"], 1))
    chunks = max(-(-(size["n"] or 0) // chunk_bytes), parallel)
    chunk = fresh("__chunk", df)
    # by content, so that rows are dealt alike whenever they are read; rows that repeat wholly are
    # told apart by the partition that they come from
    content = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    dealt = df.withColumn(chunk, F.pmod(F.xxhash64(*content, F.spark_partition_id()), F.lit(chunks)))
    text_at, flag_at, chunk_at = df.columns.index(text_col), df.columns.index(target_col), len(df.columns)

    def read(table: pa.Table) -> tuple[list[str], np.ndarray]:
        return [t or "" for t in table.column(text_at).to_pylist()], np.array([bool(f) for f in table.column(flag_at).to_pylist()], dtype=bool)

    def count(table: pa.Table) -> pa.Table:
        codes, target, other = chunk_counts(*read(table))
        # buckets of equal spans of hashes, in order
        ends = np.searchsorted((codes >> np.uint64(32)) * np.uint64(chunks) >> np.uint64(32), np.arange(chunks + 1))
        spans = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if b > a]
        number = table.column(chunk_at)[0].as_py()
        packed = [pa.array([_packed(x[s]) for _, s in spans], pa.binary()) for x in (codes, target, other)]
        return pa.Table.from_arrays([pa.array([number] * len(spans), pa.int64()), pa.array([k for k, _ in spans], pa.int64()), *packed], names=["chunk", "bucket", "codes", "target", "other"])

    def answer(table: pa.Table) -> pa.Table:
        sent = [[_unpacked(p, kind) for p in table.column(c).to_pylist()] for c, kind in (("codes", np.uint64), ("target", np.int64), ("other", np.int64))]
        codes, *sums = _added(*(np.concatenate(x) for x in sent))
        places = [np.searchsorted(codes, asked) for asked in sent[0]]
        packed = [pa.array([_packed(x[at]) for at in places], pa.binary()) for x in sums]
        return pa.Table.from_arrays([table.column("chunk").combine_chunks(), table.column("bucket").combine_chunks(), *packed], names=["chunk", "bucket", "target", "other"])

    def score(docs: pa.Table, sums: pa.Table) -> pa.Table:
        texts, flags = read(docs)
        codes = chunk_counts(texts, flags)[0]
        sums = sums.sort_by("bucket")  # spans of hashes in order, as the codes are
        got = [np.concatenate([_unpacked(p, np.int64) for p in sums.column(c).to_pylist()]) for c in ("target", "other")]
        if len(got[0]) != len(codes):
            raise ValueError("the texts of a chunk changed between counting and scoring; give add_scores a table that reads the same twice")
        n, target, background, corpus = score_texts(texts, flags, (codes, *got), strength)
        new = [pa.array(n.astype(np.int64)), *(pa.array(x) for x in (target, background, corpus, background - target))]
        return pa.Table.from_arrays([*docs.columns[:chunk_at], *new], names=[*docs.column_names[:chunk_at], *(f.name for f in fields)])

    sent = dealt.groupBy(chunk).applyInArrow(count, "chunk long, bucket long, codes binary, target binary, other binary")
    sums = sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, target binary, other binary")
    return dealt.groupBy(chunk).cogroup(sums.groupBy("chunk")).applyInArrow(score, T.StructType([*df.schema.fields, *fields]))
