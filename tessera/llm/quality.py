"""Quality classification by nearest-neighbour voting in a latent semantic space.

The terms of a text are its words (runs of letters in lower case, single signs of Chinese,
Japanese and Korean), hashed to ``WORDS`` numbers, the trigrams of its shape (each sign's class,
with runs of lower-case letters, digits and blanks drawn together) and the words that repeat one
of the two words before them. Term counts are damped, weighted by inverse document frequency,
brought to one length for the words and one for the rest, and projected on the leading
singular vectors of a bounded, class-balanced sample of labelled texts. The sample's latent
vectors are broadcast (their size is fixed by ``PER_CLASS`` and ``DIMENSIONS``); each document's
exact cosine to all of them comes from blocked matrix products, and the labels of the nearest
``NEIGHBOURS`` vote with their similarities as weights.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.batches import append_columns, cut_text, flat_codepoints, only
from tessera.llm.words import runs, word_spans, word_hashes

#: Labelled texts of each class that a fit uses at most.
PER_CLASS = 1500
DIMENSIONS = 48
NEIGHBOURS = 15
THRESHOLD = 0.7
#: Text that is turned into term counts at a time.
SLICE_BYTES = 1 << 20
#: Signs of a longer text whose terms are counted at a time.
PIECE = 1 << 20
#: Weight of a neighbour: its cosine to this power.
SHARPNESS = 8

#: The classes of signs, by their place in this list. Letters come after.
SIGNS = ["\n\r", " \t\x0b\x0c\xa0", "0123456789", ".", ",;:", "!?", "\"'`´«»‘’“”", "()[]{}<>", "-_–—", "/\\|", "*#~^=+", "$€£¥%&@"]
LOWER, UPPER, LETTER, OTHER = range(len(SIGNS), len(SIGNS) + 4)
CLASSES = len(SIGNS) + 4
JOINED = (1, 2, LOWER, LETTER)
TERMS = CLASSES**3 + 2
#: Numbers that words are hashed to; they come after the TERMS of shape and repetition.
WORDS = 1 << 13
#: The first sign of the scripts whose words aren't parted by blanks.
UNPARTED = 0x3000


def _sign_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.int64)
    for c in range(0x3000):
        s = chr(c)
        if s.isalpha():
            table[c] = LOWER if s.islower() else UPPER if s.isupper() else LETTER
    for a, b in ((0x3000, 0xD7A4), (0xF900, 0xFB00), (0x20000, 0x323B0)):
        table[a:b] = LETTER
    for k, signs in enumerate(SIGNS):
        for s in signs:
            table[ord(s)] = k
    return table


_TABLE: list[np.ndarray] = []


def term_counts(texts: list[str]) -> np.ndarray:
    """Counts (texts x TERMS) of shape trigrams and of repeated words."""
    if not _TABLE:
        _TABLE.append(_sign_table())
    n = len(texts)
    cps, bounds = flat_codepoints(texts)
    out = np.zeros((n, TERMS), dtype=np.float32)
    if not len(cps):
        return out
    owner = np.repeat(np.arange(n), np.diff(bounds))
    kind = _TABLE[0][cps]
    keep = np.ones(len(kind), dtype=bool)
    keep[1:] = (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1]) | ~np.isin(kind[1:], JOINED)
    kind, own = kind[keep], owner[keep]
    if len(kind) >= 3:
        code = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
        inside = own[:-2] == own[2:]
        out += np.bincount(own[:-2][inside] * TERMS + code[inside], minlength=n * TERMS).reshape(n, TERMS)
    starts, ends = word_spans(cps, bounds)
    codes, own = word_hashes(cps, starts, ends), owner[starts] if len(starts) else starts
    for back in (1, 2):
        if len(codes) > back:
            again = (codes[back:] == codes[:-back]) & (own[back:] == own[:-back])
            out[:, TERMS - back] = np.bincount(own[back:][again], minlength=n)
    return out


def _long_counts(text: str) -> np.ndarray:
    """``term_counts`` of one text, counted in pieces; kinds and words that end a piece begin the next one."""
    out = np.zeros(TERMS)
    kind, codes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    for piece in cut_text(text, PIECE):
        cps, bounds = flat_codepoints([piece])
        kind = np.concatenate([kind, _TABLE[0][cps]])
        keep = np.ones(len(kind), dtype=bool)
        keep[1:] = (kind[1:] != kind[:-1]) | ~np.isin(kind[1:], JOINED)
        kind = kind[keep]
        if len(kind) >= 3:
            out += np.bincount((kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:], minlength=TERMS)
        kind = kind[-2:]
        before = len(codes)
        codes = np.concatenate([codes, word_hashes(cps, *word_spans(cps, bounds))])
        for back in (1, 2):
            new = np.arange(max(before, back), len(codes))
            out[TERMS - back] += np.count_nonzero(codes[new] == codes[new - back])
        codes = codes[-2:]
    return out


def _lower_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x3000):
        if len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    return table


def word_counts(texts: list[str]) -> np.ndarray:
    """Counts (texts x WORDS) of hashed words."""
    if not _TABLE:
        _TABLE.append(_sign_table())
    if len(_TABLE) < 2:
        _TABLE.append(_lower_table())
    n = len(texts)
    cps, bounds = flat_codepoints(texts)
    if not len(cps):
        return np.zeros((n, WORDS), dtype=np.float32)
    letter = np.isin(_TABLE[0][cps], (LOWER, UPPER, LETTER))
    alone = np.flatnonzero(letter & (cps >= UNPARTED))
    starts, ends = runs(letter & (cps < UNPARTED), bounds)
    starts, ends = np.concatenate([starts, alone]), np.concatenate([ends, alone + 1])
    code = (word_hashes(_TABLE[1][cps], starts, ends) % np.uint64(WORDS)).astype(np.int64)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    return np.bincount(owner * WORDS + code, minlength=n * WORDS).reshape(n, WORDS).astype(np.float32)


def all_counts(texts: list[str]) -> np.ndarray:
    """Counts (texts x TERMS + WORDS) of all terms; a text of more than PIECE signs is counted in pieces."""
    out = np.hstack([term_counts([t if len(t) <= PIECE else "" for t in texts]), word_counts([t if len(t) <= PIECE else "" for t in texts])])
    for k, text in enumerate(texts):
        if len(text) > PIECE:
            out[k, :TERMS] = _long_counts(text)
            for piece in cut_text(text, PIECE):
                out[k, TERMS:] += word_counts([piece])[0]
    return out


@dataclass(frozen=True)
class Model:
    """What scoring needs; its size depends on the parameters of the fit alone."""

    weights: np.ndarray  # TERMS, and WORDS if the fit had them
    axes: np.ndarray  # as many x dimensions
    vectors: np.ndarray  # labelled texts x dimensions, unit length
    labels: np.ndarray
    mass: np.ndarray  # labelled texts that each vector stands for, as the sample is class-balanced
    prior: float


def _weighted(counts: np.ndarray, weights: np.ndarray, own: bool = False) -> np.ndarray:
    """Weighted terms of unit length; ``own`` counts are overwritten, which saves their copy."""
    x = np.sqrt(counts, out=counts if own else None)
    x *= weights
    for part in (x[:, :TERMS], x[:, TERMS:]):  # words and the rest weigh the same
        norm = np.sqrt(np.einsum("ij,ij->i", part, part))[:, None]  # without a copy of the part
        part /= np.where(norm > 0, norm, 1)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 1e-9, norm, 1)


def fit_counts(counts: np.ndarray, labels: np.ndarray, prior: float, dimensions: int = DIMENSIONS, own: bool = False) -> Model:
    """Latent space and labelled vectors from the term counts of the sample.

    ``prior`` is the share of label 1 among all labels that may be learnt from; ``own`` counts
    are overwritten.
    """
    n = len(labels)
    df = np.count_nonzero(counts, axis=0)
    weights = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0).astype(np.float32)
    x = _weighted(counts, weights, own)
    # leading right singular vectors by subspace iteration from a fixed start
    k = min(dimensions, n) if n else 1
    q = np.linalg.qr(x.T @ np.random.default_rng(7).standard_normal((n, k + 8)).astype(np.float32))[0] if n else np.zeros((counts.shape[1], 1), np.float32)
    for _ in range(6 if n else 0):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    share = labels.mean() if n else 0.5
    mass = np.where(labels == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    if n:
        q = q @ np.linalg.svd(x @ q, full_matrices=False)[2].T[:, :k]
    return Model(weights, q.astype(np.float32), _unit(x @ q).astype(np.float32), labels.astype(np.float32), mass, prior)


def scores(texts: list[str], model: Model, neighbours: int = NEIGHBOURS, block: int = 256) -> np.ndarray:
    """Share of label 1 in the weighted vote, for each text; the prior where nothing is near."""
    out = np.full(len(texts), model.prior)
    k = min(neighbours, len(model.labels))
    if not k:
        return out
    count = all_counts if len(model.weights) > TERMS else term_counts
    for at in range(0, len(texts), block):
        v = _unit(_weighted(count(texts[at : at + block]), model.weights, own=True) @ model.axes)
        cosine = v @ model.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS * model.mass[near]
        total = weight.sum(axis=1)
        vote = (weight * model.labels[near]).sum(axis=1)
        out[at : at + block] = np.where(total > 1e-12, vote / np.where(total > 1e-12, total, 1), model.prior)
    return np.clip(out, 0, 1)


def held_out(id_: Column) -> Column:
    """Rows no model may learn from: the checksum of the identifier as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled, not held-out texts of each label 0 and 1.

    The sample is drawn by a hash of the identifier, so it is the same wherever it runs; of an
    identifier with several texts one is drawn by its hash. Only the sample's term counts reach the driver. Null labels and other labels are left out.
    """
    marked = only(labels, doc_id=id_col, label=label_col).where("label IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).distinct()
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit_counts(np.zeros((0, TERMS), np.float32), np.zeros(0), 0.5)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(1 << 30))
    chosen = None
    for label, n in sorted(sizes.items()):
        part = marked.where(F.col("label") == label).withColumn("draw", draw)
        # a little more than wanted is drawn without any sort, then cut to the bound
        part = part.where(F.col("draw") < int(min(1.0, 1.2 * per_class / n) * (1 << 30))).orderBy("draw", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = only(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id")
    # one text of an identifier that repeats, the least by hash
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).getField("text")
    texts = texts.groupBy("label", "draw", "doc_id").agg(least.alias("text"))

    def factory() -> Callable[[list[str]], list[pa.Array]]:
        def kernel(batch: list[str]) -> list[pa.Array]:
            lists: list[list] = [[], []]
            for k in range(0, len(batch), 64):
                for row in all_counts(batch[k : k + 64]):
                    at = np.flatnonzero(row)
                    lists[0].append(at)
                    lists[1].append(row[at])
            return [pa.array(lists[0], type=pa.list_(pa.int32())), pa.array(lists[1], type=pa.list_(pa.float32()))]

        return kernel

    fields = [T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.FloatType()))]
    sample = append_columns(texts, "text", fields, factory).drop("text")
    # as Arrow, which holds a number in four bytes, where rows of Python objects take some fifty
    rows = sample.toArrow().combine_chunks().sort_by([("label", "ascending"), ("draw", "ascending"), ("doc_id", "ascending")])
    counts = np.zeros((rows.num_rows, TERMS + WORDS), dtype=np.float32)
    ends = np.cumsum(rows.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)) if rows.num_rows else np.zeros(0, int)
    place = np.repeat(np.arange(rows.num_rows), np.diff(ends, prepend=0))
    flat = [rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("terms", "counts")] if rows.num_rows else [np.zeros(0, int)] * 2
    counts[place, flat[0]] = flat[1]
    drawn = rows.column("label").to_numpy().astype(np.float32)
    del rows, flat, place
    return fit_counts(counts, drawn, sizes.get(1, 0) / sum(sizes.values()), own=True)


def add_score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the score, 0 to 1, of each whole text.

    Null and empty texts, and all texts if no label was learnt, score the prior: the share of
    label 1 among the labels (0.5 without any). Rows, repeated ones too, are independent of each other;
    long texts count whole, in pieces of PIECE signs, where a run of more than half a piece without a blank may count as two words. A taken name is lengthened by underscores (case ignored).
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def factory() -> Callable[[list[str]], list[pa.Array]]:
        return lambda texts: [pa.array(scores(texts, shared.value))]

    return append_columns(df, text_col, [T.StructField(score_col, T.DoubleType())], factory, SLICE_BYTES)
