"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone. A trigram's
vector binds (multiplies) its letters' vectors, each permuted (rotated) by its place in the
trigram; a text's vector bundles (adds) the vectors of its trigrams, each weighted by the logarithm
of one plus its count, so that a few words said over and over don't drown the rest. Prototypes
bundle the unit vectors of labelled texts, and a text gets the language whose prototype has
the largest cosine with its own vector.

Words are runs of letters in lower case, with a blank on either side. Each slice of rows finds
its distinct trigrams and their counts once; bundling is one matrix product of counts with
trigram vectors. A text of more than ``PIECE`` signs is counted piece by piece, with the same result: it costs memory
for its lower case, one piece and its distinct trigrams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.batches import append_columns, flat_codepoints, only, slices
from tessera.llm.words import mix

DIMENSIONS = 512
#: Labelled texts of each language that a fit uses, about.
PER_LANGUAGE = 3000
UNKNOWN = "und"
SLICE_BYTES = 1 << 20
#: Signs of a longer text whose trigrams are counted at a time.
PIECE = 1 << 20

_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letter" not in _TABLES:
        _TABLES["letter"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _TABLES["letter"]


def letter_vectors(cps: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Random vectors of +1 and -1 (int8) of code points."""
    seeds = mix(cps.astype(np.uint64)[:, None] * np.uint64(dimensions // 64 + 1) + np.arange(dimensions // 64, dtype=np.uint64)[None, :] + np.uint64(1))
    bits = np.unpackbits(np.ascontiguousarray(seeds).view(np.uint8), axis=1, bitorder="little")
    return (bits * 2 - 1).astype(np.int8)


def trigram_vectors(trigrams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bound vectors of trigrams, given as n x 3 code points."""
    used, place = np.unique(trigrams, return_inverse=True)
    vectors, place = letter_vectors(used, dimensions), place.reshape(trigrams.shape)
    return np.roll(vectors, 2, axis=1)[place[:, 0]] * np.roll(vectors, 1, axis=1)[place[:, 1]] * vectors[place[:, 2]]


def _long_vector(text: str, dimensions: int) -> np.ndarray:
    """The bundle of one text, counted in pieces; the last two signs of a piece begin the next one."""
    low = f" {text} ".lower()
    distinct, counts, last = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(0, len(low), PIECE):
        cps = flat_codepoints([low[k : k + PIECE]])[0]
        signs = np.concatenate([last, np.where(_letters()[cps], cps, 32).astype(np.int64)])
        keep = np.ones(len(signs), dtype=bool)
        keep[1:] = (signs[1:] != 32) | (signs[:-1] != 32)
        signs = signs[keep]
        last = signs[-2:]
        gram, n = np.unique((signs[:-2] << 42) | (signs[1:-1] << 21) | signs[2:], return_counts=True)
        distinct, at = np.unique(np.concatenate([distinct, gram]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(distinct)).astype(np.int64)
    out = np.zeros(dimensions, dtype=np.float32)
    sign = (1 << 21) - 1
    for k in range(0, len(distinct), 8192):
        gram = distinct[k : k + 8192]
        trigrams = np.stack([gram >> 42, gram >> 21 & sign, gram & sign], axis=1)
        out += np.log1p(counts[k : k + 8192]).astype(np.float32) @ trigram_vectors(trigrams, dimensions).astype(np.float32)
    return out


def text_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bundles (float32, texts x dimensions) of each text's trigrams; zero without letters."""
    n = len(texts)
    if n == 1 and len(texts[0]) > PIECE:  # slices leave texts of that length alone
        return _long_vector(texts[0], dimensions)[None, :]
    out = np.zeros((n, dimensions), dtype=np.float32)
    cps, bounds = flat_codepoints([f" {t} ".lower() for t in texts])
    letter = _letters()[cps]
    if not letter.any():
        return out
    # one blank for each run of other signs
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    owner = np.repeat(np.arange(n), np.diff(bounds))
    keep[1:] |= owner[1:] != owner[:-1]
    signs, own = np.where(letter, cps, 32)[keep], owner[keep]
    alphabet, code = np.unique(signs, return_inverse=True)
    size = len(alphabet)
    gram = (code[:-2] * size + code[1:-1]) * size + code[2:]
    inside = (own[:-2] == own[2:]) & ((signs[:-2] != 32) | (signs[1:-1] != 32))
    gram, own = gram[inside], own[:-2][inside]
    if not len(gram):
        return out
    if size**3 <= 1 << 22:
        there = np.zeros(size**3, dtype=bool)
        there[gram] = True
        distinct = np.flatnonzero(there)
        number = np.cumsum(there) - 1
        at = number[gram]
    else:
        distinct, at = np.unique(gram, return_inverse=True)
    trigrams = alphabet[np.stack([distinct // (size * size), distinct // size % size, distinct % size], axis=1)]
    rows = max(1, (1 << 23) // len(distinct))
    spans = np.searchsorted(own, np.arange(0, n + rows, rows))
    for k in range(0, len(distinct), 8192):  # bounded even for slices with very many trigrams
        bound = trigram_vectors(trigrams[k : k + 8192], dimensions).astype(np.float32)
        for b, (lo, hi) in enumerate(zip(spans[:-1], spans[1:], strict=True)):
            part = (at[lo:hi] >= k) & (at[lo:hi] < k + 8192)
            first, width = b * rows, len(bound)
            height = min(rows, n - first)
            if height <= 0:
                break
            counts = np.bincount((own[lo:hi][part] - first) * width + at[lo:hi][part] - k, minlength=height * width)
            out[first : first + height] += np.log1p(counts.reshape(height, width)).astype(np.float32) @ bound
    return out


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # languages x dimensions, unit length


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes of all non-null values of ``lang_col``.

    About ``per_language`` texts of each language are used, drawn by a hash of the identifier
    and the text, so rare languages are used whole. Sums of vectors are made where the texts
    are; the driver gets one vector for each language and partition. No rows, no profiles.
    """
    rows = only(df, doc_id=id_col, text=text_col, lang=lang_col).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    some = rows.join(F.broadcast(sizes.where(F.col("size") > 0)), "lang").where(draw < F.least(F.lit(1.0), F.lit(per_language) / F.col("size")) * (1 << 30)).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                vectors = _unit(text_vectors(part.column("text").to_pylist(), dimensions)).astype(np.float64)
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), type=pa.list_(pa.float64()))], names=["lang", "v"])

    parts = some.mapInArrow(bundle, "lang string, v array<double>")
    total = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).collect()
    found = sorted(found, key=lambda r: r["lang"])
    v = np.array([[round(e["x"], 6) for e in r["v"]] for r in found]).reshape(len(found), dimensions)
    return Profiles([r["lang"] for r in found], _unit(v).astype(np.float32))


def add_language(df: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``df`` with the language of each whole text and its cosine (0 to 1; negative: 0).

    A null text and one without a letter is "und" with score 0, as is every text if there are
    no profiles. A tie goes to the language that sorts first. Rows, repeated ones too, don't influence
    each other; long texts count whole, in pieces. A taken name is lengthened by underscores (case ignored).
    """
    shared = df.sparkSession.sparkContext.broadcast(profiles)

    def factory() -> Callable[[list[str]], list[pa.Array]]:
        known = shared.value
        names = np.array([*known.languages, UNKNOWN], dtype=object)

        def kernel(texts: list[str]) -> list[pa.Array]:
            letters = np.fromiter((any(map(str.isalpha, t)) for t in texts), dtype=bool, count=len(texts))
            if not known.languages:
                return [pa.array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts)))]
            cosine = _unit(text_vectors(texts, known.prototypes.shape[1])) @ known.prototypes.T
            best = np.where(letters, cosine.argmax(axis=1), len(known.languages))
            score = np.where(letters, np.clip(cosine.max(axis=1), 0, 1), 0).astype(np.float64)
            return [pa.array(names[best].tolist(), type=pa.string()), pa.array(score)]

        return kernel

    fields = [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    return append_columns(df, text_col, fields, factory, SLICE_BYTES)
