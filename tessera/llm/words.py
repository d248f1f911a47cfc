"""Words of many texts at once: where they are, and 64-bit hashes of them."""

from __future__ import annotations

from functools import cache

import numpy as np

#: The signs that part words, as ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"
#: An odd factor; its powers modulo 2**64 weigh the signs of a word.
FACTOR = 0xD6E8FEB86659FD93

#: Powers that a worker keeps, 8 bytes each; a longer run of signs has its own made and dropped.
KEPT = 1 << 21

_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of FACTOR, or of its inverse, modulo 2**64."""
    f = pow(FACTOR, -1, 1 << 64) if inverse else FACTOR
    if n <= KEPT and f in _POWERS:
        return _POWERS[f][:n]
    x = np.full(max(n, KEPT), f, dtype=np.uint64)
    x[0] = 1
    np.cumprod(x, out=x)
    if n <= KEPT:
        _POWERS[f] = x
    return x[:n]


@cache
def folding() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter or digit, its lower case where that is one sign, whether it is white space."""
    signs = list(map(chr, range(0x110000)))
    letter, blank = (np.fromiter(map(kind, signs), dtype=bool, count=len(signs)) for kind in (str.isalnum, str.isspace))
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        if len(low := signs[c].lower()) == 1:
            lower[c] = ord(low)
    return letter, lower, blank


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true signs that do not cross the texts' bounds."""
    n = len(inside)
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_spans(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between BLANKS."""
    blank = (cps == 32) | ((cps >= 9) & (cps <= 13))
    return runs(~blank, bounds)


def word_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the span lies."""
    sums = np.zeros(len(cps) + 1, dtype=np.uint64)
    np.cumsum((cps.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * powers(len(cps)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(cps), inverse=True)[starts] if len(starts) else np.zeros(0, np.uint64))
