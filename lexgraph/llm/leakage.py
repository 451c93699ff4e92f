"""Problem 8: passages of held-out evaluation items in a training corpus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, product

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chars
from ..runtime import unclash
from .wordhash import Words, words_of

#: Words of a passage that must stand in the document in their order.
LEAST_WORDS = 30
#: Characters of passages whose index is broadcast at once; longer lists are compared shard by shard.
MAX_CHARS = 100_000_000
#: Seed hits that are verified at a time.
BLOCK = 2_000_000


def _avoided(n: int, kept: frozenset[str]) -> int | None:
    """Length of the longest sequence of gaps that holds none of the patterns ``kept`` of ``n`` gaps, None if there is no longest."""
    steps: dict[str, list[str]] = {}
    for w in map("".join, product("12", repeat=n)):
        if w not in kept:
            steps.setdefault(w[:-1], []).append(w[1:])
    best: dict[str, int | None] = {}

    def walk(v: str) -> int:
        if v in best:
            if best[v] is None:
                raise RecursionError
            return best[v]
        best[v] = None
        best[v] = max((1 + walk(u) for u in steps.get(v, ())), default=0)
        return best[v]

    try:
        return max((walk(v) for v in list(steps)), default=0) + n - 1
    except RecursionError:
        return None


@lru_cache
def seed_patterns(least: int) -> tuple[tuple[int, ...], ...]:
    """Word offsets of the seeds: every stretch of ``least`` words without two replaced neighbours holds one of them.

    Between the equal words of such a stretch lie gaps of one or two places. From each class of
    gap patterns that turn into each other by rotation one pattern is taken, so that the set cannot
    be avoided by any longer sequence (as in a de Bruijn graph without cycles); the longest patterns
    that ``least`` words must hold are used, since longer seeds meet by chance less often.
    """
    gaps = (least + 1) // 2 - 1  # with every second word replaced
    for n in (4, 3, 2):
        classes: dict[str, set[str]] = {}
        for w in map("".join, product("12", repeat=n)):
            classes.setdefault(min(w[i:] + w[:i] for i in range(n)), set()).add(w)
        tried = ((_avoided(n, frozenset(c)), c) for c in product(*(sorted(x) for x in classes.values())))
        length, chosen = min((x for x in tried if x[0] is not None), default=(gaps, ()))
        if length < gaps:
            return tuple((0, *accumulate(int(g) for g in c)) for c in chosen)
    return ((0, 1), (0, 2))


@lru_cache
def seeds_agreeing(patterns: tuple[tuple[int, ...], ...], least: int) -> int:
    """How many seeds at least every stretch of ``least`` words without two replaced neighbours holds."""
    forms = {"".join(str(b - a) for a, b in zip(p, p[1:], strict=False)) for p in patterns}
    n = len(next(iter(forms)))

    @lru_cache(None)
    def fewest(last: str, left: int) -> int:
        if left <= 0:
            return 0
        return min((last + g in forms) + fewest((last + g)[1 - n :] if len(last) + 1 >= n else last + g, left - int(g)) for g in ("1", "2"))

    return max(fewest("", least - 1), 1)


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def seed_hashes(w: Words, patterns: tuple[tuple[int, ...], ...], passes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each seed that stands in one text; with ``passes`` (a power of two of flags), of those whose flag is set."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    with np.errstate(over="ignore"):
        times = [w.hash * f for f in _FACTORS[: len(patterns[0])]]
        for no, offsets in enumerate(patterns):
            m = len(w.hash) - offsets[-1]
            if m <= 0:
                continue
            g = times[0][:m] + np.uint64(no) * np.uint64(0xE7037ED1A0B428DB)
            for k, o in enumerate(offsets[1:], 1):
                g += times[k][o : o + m]
            at = np.arange(m) if passes is None else np.flatnonzero(passes[g >> np.uint64(65 - len(passes).bit_length())])
            at = at[w.text[at] == w.text[at + offsets[-1]]]
            found.append((g[at], at))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(none, *found, strict=True))


class ItemIndex:
    """The seeds of all passages as one sorted hash array, with the places they stand at."""

    def __init__(self, ids: Sequence, passages: Sequence[str | None], least: int):
        w = words_of(passages)
        self.ids, self.words = list(ids), w.hash
        self.patterns = seed_patterns(least)
        self.agree = seeds_agreeing(self.patterns, least)
        self.first = np.searchsorted(w.text, np.arange(len(passages) + 1))
        g, at = seed_hashes(w, self.patterns)
        order = np.argsort(g, kind="stable")
        self.seeds, self.at = g[order], at[order]
        # a bit of the hash in a table tells most words of a document at once
        self.passes = np.zeros(1 << min(max(len(g) * 16, 1 << 10).bit_length(), 26), dtype=bool)
        self.passes[g >> np.uint64(65 - len(self.passes).bit_length())] = True
        self.longest = int(np.diff(self.first).max(initial=0))

    def alignments(self, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, word of the batch less word of the passages) of each way to lay a text and an item against each other on which enough seeds agree.

        Texts are taken together up to about ``BLOCK`` hits; one with more is taken in parts, in
        which a single seed is enough, so that a seed that stands in many passages costs time but no result.
        """
        g, at = seed_hashes(w, self.patterns, self.passes)
        lo = np.searchsorted(self.seeds, g, "left")
        many = np.searchsorted(self.seeds, g, "right") - lo
        met = np.flatnonzero(many)
        met = met[np.argsort(w.text[at[met]], kind="stable")]
        many, lo, at = many[met], lo[met], at[met]
        total = np.cumsum(many)
        ends = np.flatnonzero(np.diff(w.text[at], append=-1)) + 1  # where the hits of a text end
        start = 0
        while start < len(many):
            before = total[start - 1] if start else 0
            end = int(np.searchsorted(total, before + BLOCK, "right"))
            whole = ends[ends <= end]
            apart = not len(whole) or whole[-1] <= start
            end = max(end, start + 1) if apart else int(whole[-1])
            n, a = many[start:end], at[start:end]
            place = np.repeat(lo[start:end], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc_at, item_at = np.repeat(a, n), self.at[place]
            yield self._agreed(w.text[doc_at], np.searchsorted(self.first, item_at, "right") - 1, doc_at - item_at, 1 if apart or start and w.text[at[start - 1]] == w.text[at[start]] else self.agree)
            start = end

    def _agreed(self, text: np.ndarray, item: np.ndarray, shift: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, items = int(shift.min()), len(self.first) - 1
        width = int(shift.max()) - low + 1
        if (int(text.max()) + 1) * items * width >= 1 << 63:  # such keys would not fit
            key, seen = np.unique(np.stack([text, item, shift]), axis=1, return_counts=True)
            return tuple(key[:, seen >= least])
        key, seen = np.unique((text * items + item) * width + (shift - low), return_counts=True)
        pair, shift = np.divmod(key[seen >= least], width)
        return pair // items, pair % items, shift + low


def longest_stretch(equal: np.ndarray) -> tuple[int, int]:
    """[start, end) of the longest stretch that begins and ends with an equal word and in which no two neighbours differ."""
    best = (0, 0)
    at = np.flatnonzero(equal)
    if len(at):
        breaks = np.flatnonzero(np.diff(at) > 2)
        begins = at[np.concatenate(([0], breaks + 1))]
        ends = at[np.concatenate((breaks, [len(at) - 1]))] + 1
        k = int(np.argmax(ends - begins))
        best = (int(begins[k]), int(ends[k]))
    return best


def leaks(texts: Sequence[str | None], index: ItemIndex, least: int) -> tuple[Words, list[tuple[int, int, int, int]]]:
    """(text, item, first word, last word + 1 of the batch) of each verified passage, one per text and item alignment.

    A seed fixes how item and document are laid against each other; the verification then compares
    word by word along that alignment over the whole passage. Single replaced words count as part
    of the stretch they stand in.
    """
    w = words_of(texts)
    begin = np.searchsorted(w.text, np.arange(len(texts) + 1))
    span = np.arange(index.longest)
    step = max(1, 4_000_000 // max(1, index.longest))
    out: set[tuple[int, int, int, int]] = set()
    for docs, items, shifts in index.alignments(w):
        for a in range(0, len(docs), step):
            doc, it, sh = docs[a : a + step], items[a : a + step], shifts[a : a + step]
            pos = index.first[it][:, None] + span
            at = pos + sh[:, None]
            valid = (pos < index.first[it + 1][:, None]) & (at >= begin[doc][:, None]) & (at < begin[doc + 1][:, None])
            equal = valid & (w.hash[np.clip(at, 0, len(w.hash) - 1)] == index.words[np.clip(pos, 0, len(index.words) - 1)])
            # no stretch of `least` words has fewer than half of them equal
            for k in np.flatnonzero(equal.sum(axis=1) >= (least + 1) // 2):
                s, e = longest_stretch(equal[k])
                if e - s >= least:
                    base = int(index.first[it[k]] + sh[k])
                    out.add((int(doc[k]), int(it[k]), base + s, base + e))
    return w, sorted(out)


def _shards(items: DataFrame, id_col: str, passage_col: str, least: int, most: int) -> list[Broadcast]:
    """Indexes of all passages, broadcast: one where the passages hold at most ``most`` characters, else one per hash shard of the items.

    The passages are measured before any is read to the driver, and read one shard at a time. A
    document is compared with every shard, so a long list costs more passes and no result.
    """
    known = items.select(id_col, passage_col).where(F.col(passage_col).isNotNull())
    chars = known.agg(F.sum(F.length(passage_col))).first()[0] or 0
    n = -(-chars // most) or 1
    out = []
    for k in range(n):
        rows = known.where(F.pmod(F.xxhash64(passage_col), F.lit(n)) == k).orderBy(id_col, passage_col).collect()
        out.append(items.sparkSession.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows], least)))
    return out


def find_leaks(docs: DataFrame, doc_id: str, text_col: str, items: DataFrame, item_id: str, passage_col: str, *, least: int = LEAST_WORDS, most: int = MAX_CHARS) -> DataFrame:
    """(doc_id, item_id) of each document in which at least ``least`` words of the item's passage stand in their order.

    The index of the items is broadcast and lives once in a worker (their size is measured; beyond
    ``most`` characters the items go in shards); documents are only mapped, so the operator never
    shuffles, and copies of a document are each reported. Case, accents, punctuation, layout,
    look-alike and invisible characters and single replaced words do not matter, however many of
    them are replaced; a word put in or left out ends a stretch. NULL and empty texts contain
    nothing; passages under ``least`` words cannot leak; an item is reported once per document row.
    """
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    shards = _shards(items, item_id, passage_col, least, most)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.iloc[k : k + 256]
                for shard in shards:
                    index = shard.value
                    _, found = leaks(list(part.iloc[:, 1]), index, least)
                    pairs = sorted({(d, i) for d, i, _, _ in found})
                    yield pd.DataFrame({"doc": [part.iloc[d, 0] for d, _ in pairs], "item": [index.ids[i] for _, i in pairs]})

    found = docs.select(doc_id, text_col).where(F.col(text_col).isNotNull()).mapInPandas(scan, f"`doc` {kinds[0]}, `item` {kinds[1]}")
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))


def remove_leaks(docs: DataFrame, text_col: str, items: DataFrame, item_id: str, passage_col: str, *, least: int = LEAST_WORDS, most: int = MAX_CHARS, out: str = "clean_text") -> DataFrame:
    """Adds ``out``: the text without the leaked stretches, overlapping ones joined; what is left stands as it was. NULL stays NULL; a text without leaks stays as it is."""
    shards = _shards(items, item_id, passage_col, least, most)

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            values: list[str | None] = list(s)
            for k in range(0, len(values), 256):
                part = values[k : k + 256]
                spans: dict[int, list[tuple[int, int]]] = {}
                for shard in shards:
                    w, found = leaks(part, shard.value, least)
                    offset = np.concatenate(([0], np.flatnonzero(w.points == 0) + 1))
                    for d, _, a, e in found:
                        spans.setdefault(d, []).append((int(w.start[a] - offset[d]), int(w.end[e - 1] - offset[d])))
                for d, cut in spans.items():
                    text, at, kept, last = part[d], _places(part[d]), [], 0
                    for a, e in sorted((at[a], at[e - 1] + 1) for a, e in cut):
                        if a > last:
                            kept.append(text[last:a])
                        last = max(last, e)
                    values[k + d] = "".join([*kept, text[last:]])
            yield pd.Series(values)

    return docs.withColumn(unclash(docs, out)[0], cleaned(F.col(text_col)))


def _places(text: str) -> list[int]:
    """For each position of the text with joined letters written out, as word arrays count, its position in the text itself."""
    joined = chars.joined_letters()
    return [i for i, c in enumerate(text) for _ in joined.get(c, c)]
