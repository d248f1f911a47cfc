"""Benchmark decontamination by template windows.

Texts are canonicalised to templates: numbers become <number>, units after a number <unit>, and
capitalised words inside a sentence <name>; all other words are lower-cased, and punctuation and
white space don't count. Windows of five template words are looked up in a hash table of
the benchmark's windows. Hits of a document in an item that lie on one diagonal (document
position minus item position) are checked for slot consistency: within such an alignment each
number or name of the item must always stand for the same one in the document, which a
re-parameterised question keeps and a chance likeness doesn't; two of the item may become one.
Capitalised words that begin a sentence may be names or not, so they count as both. Coverage is a share of all windows of the item.

A document is contaminated by an item if consistent windows cover at least 0.8 of the item's
windows, or a consistent run of at least ``RUN`` words is aligned. Texts are also compared
as plain lower-case words (numbers and units still typed), so that a copy in other case is found.

Windows with fewer than ``LITERALS`` literal words are looked up with their numbers as written, and so is
one window of every item, whatever its words; an item whose words all follow as written is found by it.
An item without any other window has one of them looked up as a template, too. Where this does not
decide, such windows are compared along each alignment that was found: those with a literal
by their slots, those without by their values. An item that is aligned from its first to its last
word, with the same signs between words, is found even so. Items of two to four words have a
window of their own length and are found wherever they stand between other words as written, case and signs
included; items of one word, or of signs alone, where a line equals them. So every item that is
copied verbatim is found, but one of a single word inside a longer line.

The benchmark is indexed in blocks of bounded size; each block is broadcast and all documents
are read against it. With more than one block the results are written before the next block is
read, so driver and executors hold one block at a time and the benchmark may be of any size.
Hits of many equal windows on both sides are worked off text by text and item by item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import flat_codepoints, only, slices
from tessera.llm.words import mix, word_hashes
from tessera.runtime import cut

WINDOW = 5
COVERAGE = 0.8
RUN = 13
#: Words of a window that must be no placeholder.
LITERALS = 3
#: Characters of benchmark text that one broadcast index is made of.
BLOCK_CHARS = 16 << 20
SLICE_BYTES = 2 << 20
#: Hits that are laid out at once, unless a single text and item have more.
HITS = 2 << 20

#: Words that are units after a number.
UNITS = """
mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces
ton tons tonne tonnes ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days
week weeks month months year years hz khz mhz ghz w kw watt watts v volt volts a amp amps j joule joules k c f degree degrees
percent dollar dollars cent cents euro euros usd eur gbp mph kmh kph byte bytes kb mb gb tb
""".split()
#: Signs after which a sentence begins.
SENTENCE_ENDS = ".!?:;\n\r\"“”«»(["
NUMBER, UNIT, NAME = (mix(np.array([k], dtype=np.uint64))[0] for k in (1, 2, 3))
_ODD = np.uint64(0x9FB21C651E98DF25)
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        kind = np.fromiter((1 if c.isalpha() else 2 if c.isdecimal() else 0 for c in map(chr, range(0x110000))), dtype=np.int8, count=0x110000)
        lower = np.arange(0x110000, dtype=np.uint32)
        upper = np.zeros(0x110000, dtype=bool)
        for c in np.flatnonzero(kind == 1).tolist():
            low = chr(c).lower()
            if low != chr(c):
                upper[c] = True
                if len(low) == 1:
                    lower[c] = ord(low)
        ends = np.zeros(0x110000, dtype=bool)
        ends[[ord(c) for c in SENTENCE_ENDS]] = True
        cps, bounds = flat_codepoints(UNITS)
        _TABLES.update(kind=kind, lower=lower, upper=upper, ends=ends, units=np.sort(word_hashes(cps, bounds[:-1], bounds[1:])))
    return _TABLES


@dataclass(frozen=True)
class Template:
    """Template words of many texts: ``plain`` and ``typed`` codes, slot values, owners."""

    owner: np.ndarray
    value: np.ndarray  # hash of the word as written, lower case
    plain: np.ndarray
    typed: np.ndarray
    slot: np.ndarray  # 0 literal, 1 number, 2 unit, 3 name (in the typed form only)
    loose: np.ndarray  # typed, with capitalised words that begin a sentence as names, too
    first: np.ndarray  # which words these are
    start: np.ndarray  # where the word is in its text
    end: np.ndarray


def templates(texts: list[str]) -> Template:
    t = _tables()
    cps, bounds = flat_codepoints(texts)
    n = len(cps)
    kind = t["kind"][cps]
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    edge = first[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(edge & (kind > 0))
    after = np.append(np.flatnonzero(edge), n)
    ends = after[np.searchsorted(after, starts, side="right")] if len(starts) else starts
    owner = np.searchsorted(bounds, starts, side="right") - 1
    number = kind[starts] == 2
    same = owner[1:] == owner[:-1]
    if len(starts) > 1:  # 1,234.5 is one number
        point = number[1:] & number[:-1] & same & (starts[1:] - ends[:-1] == 1) & np.isin(cps[np.minimum(ends[:-1], n - 1)], (44, 46))
        head = np.concatenate([[True], ~point])
        ends = ends[np.append(np.flatnonzero(head)[1:] - 1, len(ends) - 1)]
        starts, owner, number = starts[head], owner[head], number[head]
        same = owner[1:] == owner[:-1]
    low = t["lower"][cps]
    value = word_hashes(low, starts, ends)
    slot = np.where(number, 1, 0)
    first = np.zeros(len(starts), dtype=bool)
    if len(starts):
        upper = t["upper"][cps]
        capital = upper[starts] & ~upper[np.minimum(starts + 1, n - 1)] & (ends - starts > 1)
    if len(starts) > 1:
        known = t["units"]
        unit = number[:-1] & same & (starts[1:] - ends[:-1] <= 1)
        unit[unit] = known[np.minimum(np.searchsorted(known, value[1:][unit]), len(known) - 1)] == value[1:][unit]
        slot[1:][unit] = 2
        stops = np.concatenate([[0], np.cumsum(t["ends"][cps])])
        inside = same & (stops[starts[1:]] == stops[ends[:-1]])
        slot[1:][inside & capital[1:] & (slot[1:] == 0)] = 3
    if len(starts):
        first = capital & (slot == 0)
    plain = np.where(slot == 1, NUMBER, np.where(slot == 2, UNIT, value))
    typed = np.where(slot == 3, NAME, plain)
    return Template(owner, value, plain, typed, slot, np.where(first, NAME, typed), first, (starts - bounds[owner]).astype(np.int32), (ends - bounds[owner]).astype(np.int32))


#: Forms of a window: names literal, names typed, these and first words of sentences typed, numbers as written, template with few literals.
PLAIN, TYPED, LOOSE, EXACT, ANCHOR = range(1, 6)


def _sums(x: np.ndarray) -> np.ndarray:
    """How many of the words of each window are true."""
    total = np.concatenate([[0], np.cumsum(x)])
    return total[WINDOW:] - total[:-WINDOW]


def windows(t: Template) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each form: its number, windows' first words and their hashes."""
    m = len(t.owner) - WINDOW + 1
    if m <= 0:
        return []
    whole = t.owner[:m] == t.owner[WINDOW - 1 :]

    def coded(form: int, codes: np.ndarray, use: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        at = np.flatnonzero(use & whole)
        code = np.full(len(at), TYPED if form == LOOSE else form, dtype=np.uint64)  # a name at a sentence's start is one inside
        for k in range(WINDOW):
            code = code * _ODD + codes[at + k]
        code = mix(code)
        if form == EXACT:  # inside a run of one word only the first window is looked up
            new = np.ones(len(at), dtype=bool)
            new[1:] = (code[1:] != code[:-1]) | (at[1:] != at[:-1] + 1)
            at, code = at[new], code[new]
        return form, at, code

    plain, typed, loose = (WINDOW - _sums(x) for x in ((t.slot == 1) | (t.slot == 2), t.slot > 0, (t.slot > 0) | t.first))
    return [
        coded(PLAIN, t.plain, plain >= LITERALS),
        coded(TYPED, t.typed, (typed >= LITERALS) & (_sums(t.slot == 3) > 0)),  # without a name both forms of a window are one
        coded(LOOSE, t.loose, (loose >= LITERALS) & (_sums(t.first) > 0)),
        coded(EXACT, t.value, np.ones(m, dtype=bool)),
        coded(ANCHOR, t.loose, (loose > 0) & (loose < LITERALS)),
        coded(ANCHOR, t.typed, (typed > 0) & (typed < LITERALS) & (_sums(t.first) > 0)),
    ]


@dataclass(frozen=True)
class Index:
    """Hash table of the windows of a bounded block of benchmark items."""

    items: np.ndarray  # item number -> item_id
    begins: np.ndarray  # item number -> first word in the block's template
    template: Template
    n_windows: np.ndarray  # windows of each item
    codes: np.ndarray  # sorted
    first: np.ndarray  # first word of each window, by code
    filter: np.ndarray  # which upper bits of a code occur at all
    signs: dict[int, list[str]]  # of items with a window of few literals: signs before each word but the first
    lines: dict[str, list[int]]  # items of fewer than two words by their text
    short: dict[int, dict[int, list[tuple[int, str]]]]  # items of two to four words by this number and the hash of their words


_FILTER_BITS = 22


def _between(text: str, start: np.ndarray, end: np.ndarray) -> list[str]:
    """Signs between words, without blanks."""
    return ["".join(text[a:b].split()) for a, b in zip(end[:-1].tolist(), start[1:].tolist(), strict=True)]


def _varied(value: np.ndarray) -> np.ndarray:
    """Which windows hold more than one word."""
    change = np.concatenate([[0], np.cumsum(value[1:] != value[:-1])])
    return change[WINDOW - 1 :] > change[: -WINDOW + 1]


def build_index(item_ids: list[int], texts: list[str]) -> Index:
    t = templates(texts)
    begins = np.searchsorted(t.owner, np.arange(len(texts) + 1))
    n_windows = np.maximum(np.diff(begins) - WINDOW + 1, 0)
    lines: dict[str, list[int]] = {}
    short: dict[int, dict[int, list[tuple[int, str]]]] = {}
    for i in np.flatnonzero(n_windows == 0).tolist():
        line, n = " ".join(texts[i].split()), int(begins[i + 1] - begins[i])
        if n > 1:
            code = int(_joined(t.value, np.array([begins[i]]), n)[0])
            short.setdefault(n, {}).setdefault(code, []).append((i, line))
        elif line:
            lines.setdefault(line, []).append(i)
    signs, anchors = {}, []
    typed, loose = (WINDOW - _sums(x) if len(x) >= WINDOW else np.zeros(0, np.int64) for x in (t.slot > 0, (t.slot > 0) | t.first))
    low = np.flatnonzero(loose < LITERALS)
    low = low[t.owner[low] == t.owner[low + WINDOW - 1]]
    for i in np.unique(t.owner[low]).tolist():
        a, b = int(begins[i]), int(begins[i + 1])
        signs[i] = _between(texts[i], t.start[a:b], t.end[a:b])
        if loose[a : a + n_windows[i]].max() < LITERALS:
            anchors += [a + int(x[a : a + n_windows[i]].argmax()) for x in (typed, loose)]
    # of windows as written those with few literals are kept, and each item's first that isn't one word over and over
    plain = WINDOW - _sums((t.slot == 1) | (t.slot == 2)) if len(t.slot) >= WINDOW else np.zeros(0, np.int64)
    written = [a + int(np.argmax(_varied(t.value[a : a + n + WINDOW - 1]))) for a, n in zip(begins[:-1].tolist(), n_windows.tolist(), strict=True) if n]
    wanted = {EXACT: np.union1d(np.flatnonzero(plain < LITERALS), written), ANCHOR: anchors}
    found = [(at, code) if form not in wanted else (at[(keep := np.isin(at, wanted[form]))], code[keep]) for form, at, code in windows(t)]
    at, codes = (np.concatenate([f[k] for f in found] or [np.zeros(0, kind)]) for k, kind in ((0, np.int64), (1, np.uint64)))
    order = np.lexsort((at, codes))
    there = np.zeros(1 << _FILTER_BITS, dtype=bool)
    there[(codes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Index(np.array(item_ids, dtype=np.int64), begins, t, n_windows, codes[order], at[order], there, signs, lines, short)


def _joined(value: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each of ``at``."""
    code = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        code = code * _ODD + value[at + k]
    return mix(code)


def _lookup(t: Template, index: Index) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each form: its number, windows that the index has, and where their entries begin and end."""
    found = []
    for form, at, codes in windows(t):
        maybe = np.flatnonzero(index.filter[(codes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if len(maybe) and len(index.codes):
            at, codes = at[maybe], codes[maybe]
            found.append((form, at, np.searchsorted(index.codes, codes), np.searchsorted(index.codes, codes, side="right")))
    return found


def _hits(looked: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (document word, item word) at which equal windows begin, and the windows' form."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    for form, at, lo, hi in looked:
        n = hi - lo
        flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        found.append((np.repeat(at, n), index.first[flat], np.full(len(flat), form)))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _consistent(t: Template, q: Template, doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which aligned words keep slots consistent: the first binding of a value counts.

    The first word of a sentence is a literal where the document has it, too, else a name.
    """
    ok = np.ones(len(doc), dtype=bool)
    there: dict[tuple, int] = {}
    slot = np.where(q.first[item] & (q.value[item] != t.value[doc]), 3, q.slot[item])
    for k in np.flatnonzero((slot == 1) | (slot == 3)).tolist():
        b = int(t.value[doc[k]])
        ok[k] = there.setdefault((int(slot[k]), int(q.value[item[k]])), b) == b
    return ok


def _along(t: Template, index: Index, text: str, which: int, diagonal: int, owner: int) -> tuple[set[int], bool, bool]:
    """Item windows that hold on one diagonal, whether the whole item does, and whether slots changed."""
    q = index.template
    words = np.arange(index.begins[which], index.begins[which + 1])
    spot = words + diagonal
    inside = (spot >= 0) & (spot < len(t.owner))
    inside[inside] = t.owner[spot[inside]] == owner
    words, spot = words[inside], spot[inside]
    same = q.value[words] == t.value[spot]
    alike = same | (q.loose[words] == t.loose[spot])
    alike[alike] = _consistent(t, q, spot[alike], words[alike])
    fit, equal, literal = (np.zeros(len(inside), dtype=bool) for _ in range(3))
    fit[inside], equal[inside], literal[inside] = alike, alike & same, alike & same & (q.slot[words] == 0)
    holds = (_sums(fit) == WINDOW) & ((_sums(literal) > 0) | (_sums(equal) == WINDOW))
    whole = bool(fit.all()) and bool(literal.any()) and _between(text, t.start[spot], t.end[spot]) == index.signs.get(which)
    return set((index.begins[which] + np.flatnonzero(holds)).tolist()), whole, bool(np.any(fit & ~equal))


def matches(texts: list[str], index: Index) -> list[tuple[int, int, float, int, bool]]:
    """(text number, item number, coverage, longest run in words, slots changed) of contaminated texts."""
    t = templates(texts)
    return sorted(_long(texts, t, index) + _short(texts, t, index))


def _of_item(index: Index, which: int) -> Index:
    """The index of one item alone."""
    own = index.template.owner[index.first] == which
    return replace(index, codes=index.codes[own], first=index.first[own])


def _long(texts: list[str], t: Template, index: Index) -> list[tuple[int, int, float, int, bool]]:
    """Matches of items of five words and more."""
    looked = _lookup(t, index)
    if sum(int((hi - lo).sum()) for _, _, lo, hi in looked) > HITS:
        if len(texts) > 1:
            half = len(texts) // 2
            parts = [(0, texts[:half]), (half, texts[half:])]
            return [(d + a, *rest) for a, part in parts for d, *rest in _long(part, templates(part), index)]
        if len(items := np.unique(index.template.owner[index.first])) > 1:
            return [m for i in items.tolist() for m in _long(texts, t, _of_item(index, i))]
    return _judge(texts, t, index, *_hits(looked, index))


def _judge(texts: list[str], t: Template, index: Index, doc: np.ndarray, item: np.ndarray, form: np.ndarray) -> list[tuple[int, int, float, int, bool]]:
    q = index.template
    which, owner, diagonal = q.owner[item], t.owner[doc], doc - item
    order = np.lexsort((item, diagonal, which, owner))
    doc, item, form, which, owner, diagonal = (x[order] for x in (doc, item, form, which, owner, diagonal))
    keys = np.stack([owner, which, diagonal])
    heads = np.flatnonzero(np.concatenate([[True], np.any(keys[:, 1:] != keys[:, :-1], axis=0)])) if len(doc) else doc
    best: dict[tuple[int, int], list] = {}
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(doc)] if len(doc) else [], strict=True):
        entry = best.setdefault((int(owner[a]), int(which[a])), [set(), 0, False, []])
        if int(which[a]) in index.signs or np.any(form[a:b] == EXACT):
            entry[3].append(int(diagonal[a]))
        begins = np.unique(item[a:b][form[a:b] != ANCHOR])
        if not len(begins):
            continue
        words = np.unique(begins[:, None] + np.arange(WINDOW)[None, :])
        fit = _consistent(t, q, words + diagonal[a], words)
        good = set(words[fit].tolist())
        kept = [i for i in begins.tolist() if all(i + k in good for k in range(WINDOW))]
        if not kept:
            continue
        telling = set(item[a:b][form[a:b] < EXACT].tolist())
        longest, run, tells = 0, 0, False  # a run tells something if one of its windows has enough literals
        for k, i in enumerate(kept):
            near = k and i - kept[k - 1] <= WINDOW
            run, tells = (run + i - kept[k - 1], tells or i in telling) if near else (WINDOW, i in telling)
            longest = max(longest, run if tells else 0)
        changed = bool(np.any(q.value[words[fit]] != t.value[words[fit] + diagonal[a]]))
        entry[0].update(kept)
        entry[1] = max(entry[1], longest)
        entry[2] |= changed
    out = []
    for (d, i), (covered, longest, changed, diagonals) in best.items():
        total, whole = int(index.n_windows[i]), False
        if longest < RUN and len(covered) < COVERAGE * total:
            for line in diagonals:
                more, all_, other = _along(t, index, texts[d], i, line, d)
                covered |= more
                whole |= all_
                changed |= other and (all_ or bool(more))
        coverage = 1.0 if whole else len(covered) / total
        if coverage >= COVERAGE or longest >= RUN:
            out.append((d, i, coverage, max(longest, int(index.begins[i + 1] - index.begins[i]) if whole else 0), changed))
    return out


def _short(texts: list[str], t: Template, index: Index) -> list[tuple[int, int, float, int, bool]]:
    """Matches of items of fewer than five words."""
    out = set()
    for n, known in index.short.items():
        at = np.flatnonzero(t.owner[: len(t.owner) - n + 1] == t.owner[n - 1 :])
        codes = _joined(t.value, at, n)
        hit = np.isin(codes, np.fromiter(known, np.uint64, len(known)))
        for d, code in set(zip(t.owner[at[hit]].tolist(), codes[hit].tolist(), strict=True)):
            line = " ".join(texts[d].split())
            out.update((d, i, 1.0, n, False) for i, item in known[code] if _stands_in(item, line))
    for d, text in enumerate(texts if index.lines else ()):
        for line in text.split("\n"):
            for i in index.lines.get(" ".join(line.split()), ()):
                out.add((d, i, 1.0, int(index.begins[i + 1] - index.begins[i]), False))
    return list(out)


def _stands_in(item: str, line: str) -> bool:
    """Whether the item is in the line, not within longer words."""
    at = line.find(item)
    while at >= 0:
        end = at + len(item)
        if not (at and line[at - 1].isalnum() and item[0].isalnum()) and not (end < len(line) and line[end].isalnum() and item[-1].isalnum()):
            return True
        at = line.find(item, at + 1)
    return False


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[tuple[Index, bool]]:
    """Indexes of all items, each of about ``block_chars`` characters, one at a time, and whether it is the last."""
    rows = only(benchmark, item_id=id_col, text=text_col).where("text IS NOT NULL")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().collect()
        block.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        if block:
            yield build_index([-1 if r["item_id"] is None else r["item_id"] for r in block], [r["text"] for r in block]), k == blocks - 1


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, coverage, run_words, reparameterised) of every contaminated document and item.

    A document in no pair is clean. Null texts and texts without any sign match nothing; items of
    fewer than five words match as written; a null item_id is reported as -1. Repeated document rows give repeated rows,
    repeated items (same item_id and text) count once. Either table may be empty; a text is held
    in memory whole, with some 40 bytes a sign.
    """
    rows = only(docs, doc_id=id_col, text=text_col).where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, coverage double, run_words long, reparameterised boolean"
    out = None
    for index, last in indexes(benchmark, item_id_col, item_text_col, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        found = rows.mapInArrow(_finder(shared), schema)
        if not last or out is not None:
            found = cut(found)
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _finder(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                got = matches(part.column("text").to_pylist(), known)
                d, i = ([g[k] for g in got] for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(d, pa.int64())), pa.array(known.items[i] if i else [], pa.int64()), *(pa.array([g[k] for g in got], kind) for k, kind in ((2, pa.float64()), (3, pa.int64()), (4, pa.bool_())))],
                    names=["doc_id", "item_id", "coverage", "run_words", "reparameterised"],
                )

    return find


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without its contaminated rows, all columns unchanged; null texts are clean."""
    out = docs
    for index, last in indexes(benchmark, item_id_col, item_text_col, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        out = out.mapInArrow(_keeper(shared, text_col), docs.schema)
        if not last:
            out = cut(out)
            shared.unpersist()
    return out


def _keeper(shared, text_col: str):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                bad = {g[0] for g in matches([t or "" for t in part.column(text_col).to_pylist()], known)}
                yield part.filter(pa.array([k not in bad for k in range(part.num_rows)])) if bad else part

    return keep
