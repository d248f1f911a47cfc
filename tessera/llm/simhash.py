"""SimHash near-duplicate detection with a byte-position inverted index.

A fingerprint has 8 bytes. Two fingerprints that differ in at most 3 bits differ in at most
3 bytes, so they share at least 5 bytes at the same positions: the guaranteed number of
matches. Lists for single (position, byte) pairs would hold 1/256 of all fingerprints each, so
the index intersects them up front: of any 5 of the 8 positions, 3 lie within the first
four or within the last four, so the 8 triples of positions inside either half are enough to
bring every such pair together. Within a list the shared positional bytes of each pair are
tallied, pairs that reach 5 are retained, and their differing bits are counted.

A list of more than ``HOT`` fingerprints is not worked off in one task. Its fingerprints must
share 2 more of the remaining 5 bytes, so it is split into lists for each of the 10 pairs of
these. Such a list fixes 5 bytes; at most 2**24 different fingerprints fit in it, whatever the
corpus, and they are paired by probing the 2,324 ways to change 3 of 24 bits when it is long.

Only distinct fingerprints are indexed, so copies are never paired. A list hands on links
between each fingerprint and the first of its piece, not pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.batches import append_columns, only
from tessera.operators.components import components
from tessera.runtime import cut, fresh, join_counted

SEED = 42
MAX_BITS = 3
SHARED_BYTES = 8 - MAX_BITS
HOT = 4096
PROBE = 30_000
#: Identifiers of dropped rows up to this number are broadcast, more are shuffled.
BROADCAST_IDS = 2_000_000
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
#: Bytes of a text whose words are split at a time, and the rest of the last word.
PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, words: int) -> int:
    """Bits set in over half the XXH64 values of the text's word shingles; 0 without words."""
    data = text.encode("utf-8", "replace").translate(_LOWER)
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, dtype=np.int64), 0
    last: list[bytes] = []  # words whose shingles go on in the next piece
    at = 0
    while at < len(data):
        gap = _BLANK.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        found = last + data[at:end].split()  # splits at 0x20 and 0x09 to 0x0D
        at = end
        size = len(found) - words + 1
        if size < 1:
            last = found
            continue
        last = found[size:]
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[:size].tolist(), ends[words - 1 :].tolist(), strict=True)
        codes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=size)
        for k in range(0, size, 1 << 16):
            part = codes[k : k + (1 << 16)]
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += size
    if not n:
        return digest(b" ".join(last), SEED) if last else 0
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def add_fingerprint(df: DataFrame, text_col: str, out_col: str, words: int = 3) -> DataFrame:
    """``df`` with the signed 64-bit fingerprint of each whole text (null: empty, 0)."""

    def factory() -> Callable[[list[str]], list[pa.Array]]:
        return lambda texts: [pa.array(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))]

    return append_columns(df, text_col, [T.StructField(out_col, T.LongType())], factory)


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(255)


def _key(fp: Column, positions: tuple[int, ...], kind: int) -> Column:
    """The positions' bytes in one number; ``kind`` tells the position sets apart."""
    out = F.lit(kind).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(fp, p))
    return out


def _postings(nodes: DataFrame) -> DataFrame:
    fp = F.col("fp")
    return nodes.select("fp", F.explode(F.array(*(_key(fp, t, k) for k, t in enumerate(TRIPLES)))).alias("key"))


def _refined(hot: DataFrame) -> DataFrame:
    """The lists of ``hot`` split by each pair of the remaining positions."""
    fp, triple = F.col("fp"), F.shiftrightunsigned("key", 24)
    keys = None
    for k, t in enumerate(TRIPLES):
        rest = [p for p in range(8) if p not in t]
        own = F.array(*(_key(fp, (*t, *pair), 16 + 16 * k + n) for n, pair in enumerate(combinations(rest, 2))))
        keys = F.when(triple == k, own) if keys is None else keys.when(triple == k, own)
    return hot.select("fp", F.explode(keys).alias("key"))


class _Pieces:
    """Pieces of a graph on 0..n-1, grown by arrays of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs reach the guaranteed number of shared bytes and differ in few enough bits."""
    differ = x ^ y
    keep = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= SHARED_BYTES
    keep[keep] = np.bitwise_count(differ[keep]) <= MAX_BITS
    return keep


def _probe(fps: np.ndarray, pieces: _Pieces, base: int) -> None:
    """Links of one long list: look up every change of at most MAX_BITS of its varying bits."""
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [1 << b for b in range(64) if varying >> b & 1]
    order = np.argsort(fps)
    ranked = fps[order]
    for n in range(1, MAX_BITS + 1):
        for chosen in combinations(bits, n):
            other = ranked ^ np.uint64(sum(chosen))
            at = np.minimum(np.searchsorted(ranked, other), len(ranked) - 1)
            hit = np.flatnonzero(ranked[at] == other)
            pieces.link(base + order[hit], base + order[at[hit]])


def list_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, first of its piece) found in lists that lie one after another."""
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(heads, len(keys)))
    size = np.repeat(sizes, sizes)
    ends = np.repeat(heads + sizes, sizes)
    pieces = _Pieces(len(fps))
    for h, s in zip(heads[sizes > PROBE].tolist(), sizes[sizes > PROBE].tolist(), strict=True):
        _probe(fps[h : h + s], pieces, h)
    at = np.flatnonzero((size > 1) & (size <= PROBE))
    step = 1
    while len(at):
        at = at[at + step < ends[at]]
        hit = at[_close(fps[at], fps[at + step])] if len(at) else at
        pieces.link(hit, hit + step)
        step += 1
    linked = np.flatnonzero(pieces.label != np.arange(len(fps)))
    return fps[linked], fps[pieces.label[linked]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``list_links`` over a partition sorted by key; a list may go on in the next batch."""

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []  # joined once, however many batches a list spans
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        whole = int(np.searchsorted(keys, keys[-1]))  # sorted: the last list may be unfinished
        if whole == 0 and held and held[-1][0][-1] != keys[0]:
            yield out(*list_links(*(np.concatenate(x) for x in zip(*held, strict=True))))
            held.clear()
        if whole:
            held.append((keys[:whole], fps[:whole]))
            yield out(*list_links(*(np.concatenate(x) for x in zip(*held, strict=True))))
            held.clear()
        held.append((keys[whole:], fps[whole:]))
    if held:
        yield out(*list_links(*(np.concatenate(x) for x in zip(*held, strict=True))))


def fingerprint_links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, enough to join all that are close."""
    postings = _postings(nodes)
    hot_keys = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key")
    hot_keys = cut(hot_keys)
    usual = postings.join(hot_keys, "key", "left_anti").select("fp", "key")
    lists = usual
    if not hot_keys.isEmpty():
        lists = usual.unionByName(_refined(postings.join(hot_keys, "key", "left_semi").select("fp", "key")))
    return lists.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_links, "a long, b long").distinct()


def _classes(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(fp, n, root, component_id) of each distinct fingerprint of ``prints`` (doc_id, fp).

    ``n`` is how many rows have it, ``root`` the smallest fingerprint of the component,
    component_id its smallest doc_id.
    """
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    stars = components(fingerprint_links(nodes.select("fp"), hot)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = nodes.join(stars, "fp", "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    return join_counted(rooted, least, "root", "members").select("fp", "n", "root", "component_id")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest identifier
    that can be reached, its own included (null only if no row of the component has one).
    A text without words (null, empty, white space) has the fingerprint zero, which links
    like any other; one with fewer words than a shingle is hashed whole. Repeated rows give
    repeated rows. An empty table gives an empty result; other columns are not looked at.
    """
    rows = only(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = cut(add_fingerprint(rows, "text", "fp", words).select("doc_id", "fp"))
    # copies of one text, and all empty ones, share a fingerprint
    classes = cut(_classes(prints, hot))
    return join_counted(prints, classes, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``df`` with one row of each component of near copies, all columns unchanged.

    The row with the smallest identifier stays (nulls last); of rows that repeat both this
    identifier and its fingerprint, any one.
    """
    rows = only(df, doc_id=id_col, text=text_col)
    slim = cut(add_fingerprint(rows, "text", "fp", words).select("doc_id", "fp"))
    best = slim.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("best"))
    stays = cut(best.join(_classes(slim), "fp").groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", "best.fp"))
    # identifiers that do not name one row are settled by identifier and fingerprint
    unclear = cut(slim.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"))
    id_, fp_c = df[f"`{id_col}`"], fresh("__fp", df)
    # few rows go, so their identifiers are what the documents are joined with: broadcast while there
    # are few enough, which leaves the texts where they are, and shuffled beyond
    gone = cut(slim.select("doc_id").join(stays.select("doc_id"), "doc_id", "left_anti").unionByName(unclear).distinct())
    side = F.broadcast(gone) if gone.count() <= broadcast_ids else gone
    out = df.where(id_.isNotNull()).join(side, id_ == gone["doc_id"], "left_anti")
    if not unclear.isEmpty():
        again = add_fingerprint(df.join(unclear, id_.eqNullSafe(unclear["doc_id"]), "left_semi"), text_col, fp_c, words).dropDuplicates([id_col, fp_c])
        won = again.join(stays, again[f"`{id_col}`"].eqNullSafe(stays["doc_id"]) & (again[fp_c] == stays["fp"]), "left_semi")
        out = out.unionByName(won.drop(fp_c))
    return out
