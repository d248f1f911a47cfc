"""Byte-level BPE by a pair occurrence index.

The distinct words of a bounded run of rows are laid out in one symbol array, joined into
a list by ``next`` and ``prev`` links. An index maps each pair of adjacent symbols that
has a merge rank to *all* its positions in the array. Active ranks are taken in ascending
order from a heap; the rank's positions are merged at once with NumPy, left to right where
occurrences overlap, and the pairs that the merges create are added to the lists of their
own ranks. A merge makes a token that only later ranks can use, so a rank is finished
when it has been taken, and every word ends up as the one-word-at-a-time algorithm has it.

Encoding a word once serves all its occurrences: words repeat across rows, so a task keeps
a bounded table of words it has met.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.batches import append_columns, flat_codepoints
from tessera.llm.words import powers
from tessera.runtime import fresh

#: The pattern that splits text before merging, for this family of vocabularies.
#: ``word_starts`` finds the same words without running a pattern over every text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a task remembers between batches.
WORDS_KEPT = 400_000
#: Characters of all these words; beyond either bound the table starts anew.
CHARS_KEPT = 8_000_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte, as byte-level vocabularies write their tokens."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, byte ids, merge ranks and special tokens of one tokenizer file's JSON."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normaliser and prefix space is supported")
        alphabet, ids = byte_alphabet(), model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *special.values()]) + 1
        tokens = [b""] * self.size
        for token, i in ids.items():
            tokens[i] = bytes(alphabet[c] for c in token)
        for token, i in special.items():
            tokens[i] = token.encode()
        self.tokens, self.special = tokens, special
        self.byte_ids = np.array([ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], dtype=np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int32)
        code = left * self.size + right
        self.order = np.argsort(code, kind="stable")
        self.codes = code[self.order]
        self.pair = np.stack([left, right], axis=1)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where it has none."""
        code = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.order[at], -1)


@cache
def vocabulary(source: str) -> Vocabulary:
    return Vocabulary(source)


def merge_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in one array, and the words' bounds in it."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    n = int(lengths.sum())
    word_of = np.repeat(np.arange(len(words)), lengths)
    symbol = vocab.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    nxt, prev = np.arange(1, n + 1), np.arange(-1, n - 1)
    if n:
        last = np.cumsum(lengths) - 1
        nxt[last[lengths > 0]] = -1
        prev[(last - lengths + 1)[lengths > 0]] = -1
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(at: np.ndarray) -> None:
        """Put the pairs that begin at ``at`` into the lists of their ranks."""
        rank = vocab.ranks(symbol[at], symbol[nxt[at]])
        has = rank >= 0
        at, rank = at[has], rank[has]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        heads = np.flatnonzero(np.diff(rank, prepend=-1))
        begins = heads.tolist()
        for r, a, b in zip(rank[heads].tolist(), begins, [*begins[1:], len(at)], strict=True):
            if r in index:
                index[r].append(at[a:b])
            else:
                index[r] = [at[a:b]]
                heapq.heappush(heap, r)

    add(np.flatnonzero(nxt >= 0))
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        left, right = vocab.pair[r]
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        follow = nxt[at]
        # positions whose symbols an earlier merge has changed are out of date
        at = at[(symbol[at] == left) & (follow >= 0) & (symbol[follow] == right)]
        if left == right and len(at) > 1:
            at = np.unique(at)
            at = at[_alternate(at, nxt[at])]
        elif len(parts) > 1:
            at = np.unique(at)
        if not len(at):
            continue
        gone = nxt[at]
        after = nxt[gone]
        symbol[at] = vocab.merged[r]
        symbol[gone] = -1
        nxt[at] = after
        ok = after >= 0
        prev[after[ok]] = at[ok]
        before = prev[at]
        add(np.unique(np.concatenate([before[before >= 0], at[ok]])))
    alive = symbol >= 0
    return symbol[alive], np.concatenate([[0], np.cumsum(np.bincount(word_of[alive], minlength=len(words)))])


def _alternate(at: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Which of the overlapping positions merge, left to right: every other one of a chain."""
    chained = np.concatenate([[False], follow[:-1] == at[1:]])
    heads = np.flatnonzero(~chained)
    place = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
    return place % 2 == 0


def _class_table() -> np.ndarray:
    """Class of every code point: 0 white space, 1 letter, 2 number, 3 other."""
    every = "".join(map(chr, [*range(0xD800), *[0x20] * 0x800, *range(0xE000, 0x110000)]))
    table = np.full(0x110000, 3, dtype=np.int8)
    for kind, pattern in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    table[0xD800:0xE000] = 3
    return table


class_table = cache(_class_table)
#: The endings that a leading apostrophe splits off.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def word_starts(cps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the words of SPLIT begin in texts laid end to end, found for all texts at once.

    A run of letters, numbers or other signs is a word and takes one blank before it along.
    White space before a word leaves its last sign to the word or to itself; at the end of a
    text it is one word. An apostrophe at the start of a word splits off one of ENDINGS.
    """
    n = len(cps)
    kind = class_table()[cps]
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    first = first[:n]
    space, blank = kind == 0, cps == 32
    change = np.ones(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~first
    starts = change & (space | ~after_blank)
    # the last white space sign before a word begins a word
    starts[:-1] |= space[:-1] & ~space[1:] & ~first[1:]
    quotes = np.flatnonzero((cps == 39) & starts)
    if len(quotes):
        ends = bounds[np.searchsorted(bounds, quotes, side="right")]
        open_ = np.ones(len(quotes), dtype=bool)
        for ending in ENDINGS:
            fits = open_ & (quotes + len(ending) < ends)
            for k, c in enumerate(ending, 1):
                fits &= cps[np.minimum(quotes + k, n - 1)] == ord(c)
            open_ &= ~fits
            at = quotes[fits]
            starts[at + 1] = False
            after = at + 1 + len(ending)
            starts[after[after < n]] = True
    return starts


def distinct_words(cps: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, and each word's number among them.

    ``at`` has the words' bounds. Words are told apart by a 64-bit polynomial hash from
    prefix sums; afterwards every word is compared with its representative in full.
    """
    size = np.diff(at)
    sums = np.zeros(len(cps) + 1, dtype=np.uint64)
    np.cumsum((cps.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * powers(len(cps)), out=sums[1:])
    code = (sums[at[1:]] - sums[at[:-1]]) * powers(len(cps), inverse=True)[at[:-1]]
    _, place, number = np.unique(code, return_index=True, return_inverse=True)
    there = np.arange(len(cps)) + np.repeat(at[place][number] - at[:-1], size)
    if np.any(size != size[place][number]) or np.any(cps != cps[there]):  # a collision: tell them apart in full
        words = np.array([cps[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], dtype=object)
        _, place, number = np.unique(words, return_index=True, return_inverse=True)
    return place, number


class Encoder:
    """Encodes texts with one vocabulary; remembers a bounded number of words."""

    def __init__(self, source: str):
        self.vocab = vocabulary(source)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Add words that aren't known, special tokens among them, to the table."""
        special = self.vocab.special
        self.chars += sum(map(len, words))
        ids, bounds = merge_words([b"" if w in special else w.encode("utf-8", "replace") for w in words], self.vocab)
        for k, w in enumerate(words):
            if w in special:
                ids = np.insert(ids, bounds[k], special[w])
                bounds[k + 1 :] += 1
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.bounds = np.concatenate([self.bounds, bounds[1:] + self.bounds[-1]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in one array, and the texts' bounds in it."""
        special = self.vocab.special
        pieces, owner = texts, np.arange(len(texts))
        if special and any(s in t for t in texts for s in special):
            split = [self.vocab.cut.split(t) for t in texts]
            pieces, owner = [p for x in split for p in x], np.repeat(owner, [len(x) for x in split])
        cps, bounds = flat_codepoints(pieces)
        if not len(cps):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = word_starts(cps, bounds)
        for k, p in enumerate(pieces if len(pieces) > len(texts) else ()):
            if p in special:
                starts[bounds[k] + 1 : bounds[k + 1]] = False
        at = np.append(np.flatnonzero(starts), len(cps))
        place, number = distinct_words(cps, at)
        joined = "".join(pieces)
        words = [joined[a:b] for a, b in zip(at[place].tolist(), at[place + 1].tolist(), strict=True)]
        if new := [w for w in words if w not in self.known]:
            self._learn(new)
        which = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))[number]
        ids = gather(self.ids, self.bounds, which)
        ends = np.concatenate([[0], np.cumsum((self.bounds[1:] - self.bounds[:-1])[which])])
        word_bounds = np.searchsorted(at, bounds)
        last = np.searchsorted(owner, np.arange(len(texts)), side="right")
        out = ends[word_bounds[np.concatenate([[0], last])]]
        if len(self.known) > WORDS_KEPT or self.chars > CHARS_KEPT:
            self._forget()
        return ids, out


def gather(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The lists ``values[bounds[i]:bounds[i + 1]]`` for each i of ``which``, end to end."""
    sizes = (bounds[1:] - bounds[:-1])[which]
    total = int(sizes.sum())
    if not total:
        return values[:0]
    starts = np.cumsum(sizes) - sizes
    return values[np.arange(total) + np.repeat(bounds[which] - starts, sizes)]


class Decoder:
    """Token ids back to text; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""

    def __init__(self, source: str):
        tokens = vocabulary(source).tokens
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        known = (ids >= 0) & (ids < len(self.bounds) - 1)
        if not known.all():
            bounds, ids = np.concatenate([[0], np.cumsum(known)])[bounds], ids[known]
        raw = gather(self.bytes, self.bounds, ids).tobytes()
        ends = np.concatenate([[0], np.cumsum((self.bounds[1:] - self.bounds[:-1])[ids])])[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode(df: DataFrame, tokenizer_json: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with the token ids of each whole text, and if asked the text decoded from them.

    ``tokenizer_json`` is the content of a tokenizer file (about 1.5 MB, sent with the task;
    executors need no path). A null or empty text has no ids and decodes to an empty text;
    strings of special tokens in a text become those tokens. All columns of ``df`` stay, rows,
    repeated ones too, are independent of each other, and an empty table gives an empty one. A new name
    that is taken (case ignored) is lengthened by underscores; the new columns are the last ones.
    """
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), containsNull=True))]
    if decoded_col:
        fields.append(T.StructField(decoded_col, T.StringType()))
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def factory() -> Callable[[list[str]], list[pa.Array]]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value) if decoded_col else None

        def kernel(texts: list[str]) -> list[pa.Array]:
            ids, bounds = encoder.encode(texts)
            out = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))]
            if decoder:
                out.append(pa.array(decoder.decode(ids, bounds), type=pa.string()))
            return out

        return kernel

    return append_columns(df, text_col, fields, factory)


def decode(df: DataFrame, tokenizer_json: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with the text of each row's token ids, as its last column.

    Null ids decode to an empty text, ids that no token has to nothing. A taken name is
    lengthened by underscores.
    """
    decoded_col = fresh(decoded_col, df)
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    schema = T.StructType([*df.schema.fields, T.StructField(decoded_col, T.StringType())])

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = [np.array([-1 if i is None else i for i in x or []], dtype=np.int64) for x in batch.column(ids_col).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
            texts = decoder.decode(np.concatenate([*lists, np.zeros(0, np.int64)]), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], names=[*batch.schema.names, decoded_col])

    return df.mapInArrow(run, schema)
