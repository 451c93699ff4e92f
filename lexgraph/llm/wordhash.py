"""Words of whole batches of texts as 64-bit hashes, computed over arrays."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from ..functions import chars

_SEP, _SKIP = 0, 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Text separator; as a control character it ends words and never stands in one.
_END = "\x00"


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """Code point -> code of its folded character: 0 between words, 1 ignorable, else a code that words hash."""
    t = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x20000):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat[0] == "M" or cat == "Cf":
            t[cp] = _SKIP
            continue
        if cat[0] not in "LN":
            continue
        if 0x3000 <= cp < 0xF900 or cp >= 0x10000:  # no variants to fold there
            t[cp] = cp + 2
            continue
        plain = chars.to_plain().get(cp, ch)
        if plain == "":
            t[cp] = _SKIP
            continue
        plain = "".join(chars.LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFD", plain)).lower()
        plain = "".join(c for c in unicodedata.normalize("NFD", plain) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isalnum():
            t[cp] = ord(plain) + 2
    return t


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept by the worker."""
    if not _POWERS or len(_POWERS[0]) < n + 1:
        size = max(n + 1, 1 << 19)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.full(size, b, dtype=np.uint64), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][: n + 1]


@dataclass
class Words:
    """The words of a batch: hash, number of the text, and the positions [start, end) of each in ``codes``' text."""

    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: The batch as one array of code points, texts ended by NUL.
    points: np.ndarray


def words_of(texts: Sequence[str | None]) -> Words:
    """Words (runs of letters and digits) compared without case, accents, look-alikes, widths, layout or invisible characters.

    NULL and empty texts have no words. A word broken by a hyphen at a line's end is two words.
    """
    joined = _END.join((t or "").replace(_END, " ") for t in texts) + _END
    for k, v in chars.joined_letters().items():
        if len(v) > 1 and k in joined:
            joined = joined.replace(k, v)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = _table()[points]
    keep = np.flatnonzero(code != _SKIP)
    code = code[keep]
    inside = code > _SKIP
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        power, inverse = _powers(len(code))
        sums = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum(code * power, dtype=np.uint64, out=sums[1:])
        h = (sums[last] - sums[first]) * inverse[first]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    start = keep[first]
    end = keep[last - 1] + 1 if len(last) else last
    text = np.searchsorted(np.flatnonzero(points == 0), start)
    return Words(h, text.astype(np.int64), start, end, points)


def ngram_hashes(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each run of ``n`` words that stands in one text."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(m, dtype=np.uint64)
        for j in range(n):
            g = g * np.uint64(0x100000001B3) + h[j : j + m]
            g ^= g >> np.uint64(31)
    at = np.flatnonzero(text[:m] == text[n - 1 :])
    return g[at], at
