"""Problem 9: the subject areas of each document."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .wordhash import Words, words_of

try:
    import zstandard
except ImportError:  # blocks are then larger
    zstandard = None

#: Strength, in words, with which a model is interpolated with the next lower one: unigrams with the background, bigrams with unigrams.
PRIOR_UNIGRAM, PRIOR_BIGRAM = 50.0, 5.0
#: How many times its degrees of freedom an n-gram's G statistic must exceed to have any weight.
NOISE = 1.2
#: Mean log-likelihood ratio per word to the background from which a sentence deals with a subject that cannot be calibrated, and the least that a calibration gives.
ACCEPT, LOWEST = 0.1, 0.02
#: Calibration: parts the samples are dealt to, share of held-out sentences that may be missed, and sentences it takes.
FOLDS, MISSED, LEAST_HELD = 5, 0.05, 10
#: A sentence teaches a model when its log-likelihood ratio to the background reaches the first and leads the second subject's by the second.
CLEAR, TEACH = 2.0, 1.0
#: Share of its sentences that a document must spend on an area.
SHARE = 0.25
#: Labelled rows that are read for training.
MAX_SAMPLES = 50_000
#: Rows of a model that the driver or a worker holds at a time, and words of texts that go through the shards of a larger model together.
SHARD_ROWS, GROUP_WORDS = 500_000, 8_000_000


def sentences_of(w: Words) -> np.ndarray:
    """For each word of a batch the number of its sentence, ascending over the batch.

    A sentence ends at a text's end, at a blank line, and where between two words a full stop,
    question or exclamation mark (and perhaps a closing quote) is followed by white space and the
    next word has a capital letter.
    """
    if not len(w.hash):
        return np.zeros(0, np.int64)
    kind = _kinds()[np.minimum(w.points, 0xFFFF)]
    a, b = w.end[:-1], w.start[1:]
    # most words are one blank apart; only the other gaps can end a sentence
    cut = np.zeros(len(a), dtype=bool)
    wide = np.flatnonzero(b - a > 1)
    stop = kind == _STOP
    stop[1:] |= (kind[1:] == _CLOSE) & stop[:-1]
    newline = w.points == 10
    space = (kind == _SPACE) | newline
    # counts before each position make questions about gaps between words vectorised
    stops = np.concatenate(([0], np.cumsum(stop[:-1] & space[1:], dtype=np.int32)))
    blank = np.concatenate(([0], np.cumsum(_blank_lines(newline, space), dtype=np.int32)))
    a, b = a[wide], b[wide]
    has_stop = stops[np.minimum(b, len(stops) - 1)] > stops[a]
    cut[wide] = (blank[b] > blank[a]) | (has_stop & (kind[b] == _CAPITAL))
    cut |= w.text[1:] != w.text[:-1]
    return np.concatenate(([0], np.cumsum(cut)))


def _blank_lines(newline: np.ndarray, space: np.ndarray) -> np.ndarray:
    """True at each newline whose next character but blanks is a newline too."""
    at = np.flatnonzero(newline)
    out = np.zeros(len(newline), dtype=bool)
    if len(at) > 1:
        gaps = np.concatenate(([0], np.cumsum(~space, dtype=np.int32)))
        near = gaps[at[1:]] == gaps[at[:-1] + 1]
        out[at[:-1][near]] = True
    return out


_STOP, _CLOSE, _SPACE, _CAPITAL = 1, 2, 3, 4


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Code point -> what it means for the ends of sentences."""
    kinds = np.array([_CAPITAL if chr(c).isupper() or chr(c).istitle() else 0 for c in range(0x10000)], dtype=np.uint8)
    for chars, kind in ((".!?…", _STOP), ("”\"»’)]", _CLOSE), (" \t\r\u00a0", _SPACE)):
        kinds[[ord(c) for c in chars]] = kind
    return kinds


#: The code of every number; other words have the upper half of their hash.
_NUMBER = np.uint32(7)


@dataclass
class Tokens:
    """Texts as word codes of 32 bits, with the words of each sentence and of each text."""

    words: np.ndarray
    of_sentence: np.ndarray
    of_text: np.ndarray

    @property
    def sentence(self) -> np.ndarray:
        """The sentence of each word."""
        return np.repeat(np.arange(len(self.of_sentence)), self.of_sentence)

    @property
    def text(self) -> np.ndarray:
        """The text of each sentence."""
        if not len(self.of_sentence):
            return np.zeros(0, np.int64)
        ends = np.cumsum(self.of_text)
        return np.searchsorted(ends, np.cumsum(self.of_sentence) - self.of_sentence, "right")

    def pairs(self, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, word it ends at) of the bigrams inside sentences; the key holds both words."""
        at = np.flatnonzero(sentence[1:] == sentence[:-1]) if len(sentence) else np.zeros(0, np.int64)
        wide = self.words.astype(np.uint64)
        return wide[at] << np.uint64(32) | wide[at + 1], at + 1

    def pack(self) -> bytes:
        parts = [np.array([len(self.words), len(self.of_sentence), len(self.of_text)], np.uint32), self.words, self.of_sentence.astype(np.uint32), self.of_text.astype(np.uint32)]
        return _squeeze(np.concatenate(parts).tobytes())

    @staticmethod
    def unpack(blob: bytes) -> Tokens:
        x = np.frombuffer(_expand(blob), dtype=np.uint32)
        n, m, _ = x[:3].tolist()
        return Tokens(x[3 : 3 + n], x[3 + n : 3 + n + m].astype(np.int64), x[3 + n + m :].astype(np.int64))


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw) if zstandard else zlib.compress(raw, 1)


def _expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob) if zstandard else zlib.decompress(blob)


def tokens_of(texts: Sequence[str | None]) -> Tokens:
    """Word codes, with all numbers alike; two words of one code count as one word, of which there are some among millions of words."""
    w = words_of(texts)
    code = (w.hash >> np.uint64(32)).astype(np.uint32)
    first = w.points[w.start] if len(w.start) else np.zeros(0, np.uint32)
    code[(first >= 48) & (first <= 57)] = _NUMBER
    return Tokens(code, np.bincount(sentences_of(w)), np.bincount(w.text, minlength=len(texts)))


def _trust(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How far the counts of n-grams per class are beyond chance, 0 to 1: one less the noise share of the G statistic.

    An n-gram used alike by all classes has a G of about its degrees of freedom and gets no weight,
    so that common phrases, seen unequally often by chance, cancel out.
    """
    active = total > 0
    free = max(int(active.sum()) - 1, 1)
    expected = n.sum(axis=1, keepdims=True) * (total[active] / max(total.sum(), 1.0))
    seen = n[:, active]
    g = 2 * (seen * np.log(np.where(seen > 0, seen, 1.0) / np.maximum(expected, 1e-300))).sum(axis=1)
    return np.maximum(0.0, 1.0 - NOISE * free / np.maximum(g, 1e-9))


@dataclass
class SubjectModels:
    """Interpolated bigram models of the subjects, as log-ratio tables against the background model.

    A document word costs one lookup: the row of its bigram if any subject has seen it, else of its
    word, else nothing. ``accept`` is the least mean log-ratio per word with which a sentence deals
    with each subject. ``shard`` (number, of how many) is other than (0, 1) where the rows are only those that
    a word of that remainder ends; the scores of all shards add up to those of the whole.
    """

    subjects: list[str]
    uni: np.ndarray
    bi: np.ndarray
    #: Rows of the words, then of the bigrams.
    ratio: np.ndarray
    accept: np.ndarray
    shard: tuple[int, int] = (0, 1)

    def __reduce__(self) -> tuple:
        # the table of bits is larger than the rows and is built again where the model is loaded
        return SubjectModels, (self.subjects, self.uni, self.bi, self.ratio, self.accept, self.shard)

    def __post_init__(self) -> None:
        # most bigrams of a text are in no model: a bit of each key in a table spares them the search
        self.passes = np.zeros(1 << min(max(16 * len(self.bi), 1 << 12).bit_length(), 26), dtype=bool)
        self.passes[self._slot(self.bi)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.passes).bit_length())

    def scores(self, t: Tokens) -> np.ndarray:
        """Sum over the words of each sentence of log p(subject) - log p(background): sentences x subjects."""
        out = np.zeros((len(t.of_sentence), len(self.subjects)), dtype=np.float32)
        sentence = t.sentence
        row = np.full(len(t.words), -1, dtype=np.int64)
        number, of_shards = self.shard
        mine = t.words % np.uint32(of_shards) == number if of_shards > 1 else np.ones(len(t.words), dtype=bool)
        if len(self.uni) and len(t.words):
            at = np.flatnonzero(mine)
            r = np.minimum(np.searchsorted(self.uni, t.words[at]), len(self.uni) - 1)
            known = np.flatnonzero(self.uni[r] == t.words[at])
            row[at[known]] = r[known]
        if len(self.bi):
            g, at = t.pairs(sentence)
            if of_shards > 1:
                g, at = g[mine[at]], at[mine[at]]
            maybe = np.flatnonzero(self.passes[self._slot(g)])
            g, at = g[maybe], at[maybe]
            r = np.minimum(np.searchsorted(self.bi, g), len(self.bi) - 1)
            known = np.flatnonzero(self.bi[r] == g)
            row[at[known]] = r[known] + len(self.uni)
        told = np.flatnonzero(row >= 0)
        if len(told):
            of = sentence[told]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            out[of[starts]] = np.add.reduceat(self.ratio[row[told]], starts, axis=0)
        return out

    def dealt(self, t: Tokens) -> np.ndarray:
        """Whether each sentence deals with each subject: its cross-entropy per word lies below the background's by what the subject asks for."""
        return accepted(self.scores(t), self.accept, t)


def accepted(scores: np.ndarray, accept: np.ndarray, t: Tokens) -> np.ndarray:
    return scores >= accept * t.of_sentence[:, None]


@dataclass
class Counts:
    """Counts of n-grams per class; the last class holds sentences of no subject. ``first`` and ``last`` are the rows of a bigram's words."""

    uni: np.ndarray
    uni_n: np.ndarray
    bi: np.ndarray
    bi_n: np.ndarray
    first: np.ndarray
    last: np.ndarray
    total: np.ndarray

    @staticmethod
    def of(classes: int, grams: pd.DataFrame, total: np.ndarray | None = None) -> Counts:
        """From rows (pair, hash, class, n). ``total`` has the words of each class where the rows do not hold all of them."""
        pair = grams["pair"].to_numpy(bool)
        key, cls, n = grams["hash"].to_numpy(np.int64).view(np.uint64), grams["class"].to_numpy(), grams["n"].to_numpy()
        uni, inv = np.unique(key[~pair].astype(np.uint32), return_inverse=True)
        uni_n = np.zeros((len(uni), classes))
        np.add.at(uni_n, (inv, cls[~pair]), n[~pair])
        rows = [np.minimum(np.searchsorted(uni, x), max(len(uni) - 1, 0)) for x in _words_of_pairs(key[pair])]
        ok = np.logical_and(*(uni[r] == x for r, x in zip(rows, _words_of_pairs(key[pair]), strict=True))) if len(uni) else np.zeros(int(pair.sum()), bool)
        bi, at, inv = np.unique(key[pair][ok], return_index=True, return_inverse=True)
        bi_n = np.zeros((len(bi), classes))
        np.add.at(bi_n, (inv, cls[pair][ok]), n[pair][ok])
        return Counts(uni, uni_n, bi, bi_n, rows[0][ok][at], rows[1][ok][at], uni_n.sum(axis=0) if total is None else total)

    def less(self, grams: pd.DataFrame) -> Counts:
        """Without the counts of some rows (pair, hash, class, n)."""
        out = Counts(self.uni, self.uni_n.copy(), self.bi, self.bi_n.copy(), self.first, self.last, self.total.copy())
        for is_pair, keys, counts in ((False, self.uni, out.uni_n), (True, self.bi, out.bi_n)):
            g = grams[grams["pair"] == is_pair]
            key, cls, n = g["hash"].to_numpy(np.int64).view(np.uint64).astype(keys.dtype), g["class"].to_numpy(), g["n"].to_numpy()
            if not is_pair:
                np.subtract.at(out.total, cls, n)
            if len(keys):
                r = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                here = keys[r] == key
                np.subtract.at(counts, (r[here], cls[here]), n[here])
        return out

    def models(self, subjects: list[str]) -> SubjectModels:
        k = len(subjects)
        uni_ratio, keep1, bi_ratio, keep2 = _ratios(self.uni_n, self.bi_n, self.first, self.last, self.total, k)
        # what has no weight of its own is answered by the lower model, or by nothing
        return SubjectModels(subjects, self.uni[keep1], self.bi[keep2], np.concatenate((uni_ratio[keep1], bi_ratio[keep2])).astype(np.float32), np.full(k, ACCEPT))


def _ratios(un: np.ndarray, bn: np.ndarray, first: np.ndarray, last: np.ndarray, total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log-ratios of the words and of the bigrams (by the rows of their words), each with which of them have a weight; a row depends on its own counts and ``total`` only."""
    active = total > 0
    # every class weighs alike in the background, however common it is
    ml = un / np.maximum(total, 1.0)
    back = np.maximum(ml[:, active].mean(axis=1, keepdims=True), 1e-12) if active.any() else np.full((len(un), 1), 1.0)
    # and has the same size, else a class of few words would lose least by words it does not know
    size = float(np.exp(np.log(total[active]).mean())) if active.any() else 1.0
    p1 = (ml * size + PRIOR_UNIGRAM * back) / (size + PRIOR_UNIGRAM)
    trust1, trust2 = _trust(un, total)[:, None], _trust(bn, total)[:, None]
    uni_ratio = np.log(p1[:, :k] / back) * trust1
    share = ml[first][:, active]
    context = ml[first] * size
    in_class = bn / np.maximum(total, 1.0) * size
    p2 = (in_class + PRIOR_BIGRAM * p1[last]) / (context + PRIOR_BIGRAM)
    # the background's bigram: the classes' own, weighted by how likely each is in that context
    seen = np.divide(in_class, context, out=np.zeros_like(bn), where=context > 0)[:, active]
    mixed = (share * seen).sum(axis=1, keepdims=True) / np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
    n_back = context.sum(axis=1, keepdims=True)
    q2 = (n_back * mixed + PRIOR_BIGRAM * back[last]) / (n_back + PRIOR_BIGRAM)
    bi_ratio = trust2 * np.log(p2[:, :k] / q2) + (1 - trust2) * uni_ratio[last]
    return uni_ratio, trust1[:, 0] > 0, bi_ratio, trust2[:, 0] > 0


def _words_of_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)


def count_ngrams(t: Tokens, label: np.ndarray) -> pd.DataFrame:
    """(pair, hash, class, n) of the words and bigrams of the sentences of each class; class -1 is left out."""
    sentence = t.sentence
    g, at = t.pairs(sentence)
    of_word = label[sentence]
    of_pair = of_word[at]
    parts = []
    for c in np.unique(label[label >= 0]).tolist():
        for pair, keys in ((False, t.words[of_word == c]), (True, g[of_pair == c])):
            u, n = np.unique(keys, return_counts=True)
            parts.append(pd.DataFrame({"pair": pair, "hash": u.astype(np.uint64).view(np.int64), "class": np.int32(c), "n": n.astype(np.int64)}))
    return pd.concat(parts) if parts else pd.DataFrame({"pair": np.zeros(0, bool), "hash": np.zeros(0, np.int64), "class": np.zeros(0, np.int32), "n": np.zeros(0, np.int64)})


def sample_counts(texts: Sequence[str], labels: Sequence[str], subjects: list[str]) -> pd.DataFrame:
    """Counted n-grams of labelled samples; each sentence has its sample's subject."""
    number = {s: i for i, s in enumerate(subjects)}
    t = tokens_of(texts)
    return count_ngrams(t, np.array([number.get(x, -1) for x in labels], dtype=np.int64)[t.text])


def calibrated(counts: Counts, texts: Sequence[str], labels: Sequence[str], subjects: list[str]) -> SubjectModels:
    """The models of all counts, with each subject's acceptance fitted on labelled sentences that its model has not counted.

    The samples of each subject are dealt to FOLDS parts; each part's own counts are taken out of
    the models that score it. A subject accepts from half way between the background (0) and the mean log-ratio per
    word that all but MISSED of its held-out sentences reach, and never below what all but MISSED of the
    others' sentences stay under. With fewer than LEAST_HELD sentences it keeps ACCEPT.
    """
    model = counts.models(subjects)
    number = {s: i for i, s in enumerate(subjects)}
    turn: dict[str, int] = {}
    fold = np.array([turn.update({x: turn.get(x, -1) + 1}) or turn[x] % FOLDS for x in labels], dtype=np.int64)
    told, truth = [], []
    for f in range(FOLDS):
        mine = np.flatnonzero((fold == f) & np.array([x in number for x in labels], dtype=bool))
        if not len(mine):
            continue
        part, of = [texts[i] for i in mine], [labels[i] for i in mine]
        t = tokens_of(part)
        told.append(counts.less(sample_counts(part, of, subjects)).models(subjects).scores(t) / np.maximum(t.of_sentence, 1)[:, None])
        truth.append(np.array([number[x] for x in of], dtype=np.int64)[t.text])
    if told:
        x, y = np.concatenate(told), np.concatenate(truth)
        for k in range(len(subjects)):
            own, others = x[y == k, k], x[y != k, k]
            if len(own) >= LEAST_HELD:
                floor = float(np.quantile(others, 1 - MISSED)) if len(others) else 0.0
                model.accept[k] = max(float(np.quantile(own, MISSED)) / 2, floor, LOWEST)
    return model


def teach_labels(s: np.ndarray, none: int, doc: np.ndarray | None = None) -> np.ndarray:
    """The class each sentence teaches: its subject where it leads clearly, ``none`` where no subject gains, else -1.

    With the sentences' documents (ascending), a sentence that is not clear by itself teaches the
    subject that leads clearly in its document as a whole: weak signs of words that the samples
    hold once or twice add up there. Procedural sentences so labelled do no harm, as they spread
    over all subjects alike.
    """
    if not len(s):
        return np.zeros(0, np.int64)

    def clear(x: np.ndarray, accept: float, lead: float) -> np.ndarray:
        top = np.sort(x, axis=1)
        second = top[:, -2] if x.shape[1] > 1 else np.zeros(len(x))
        return (top[:, -1] >= accept) & (top[:, -1] - np.maximum(second, 0) >= lead)

    label = np.full(len(s), -1, dtype=np.int64)
    label[s.max(axis=1) < CLEAR / 2] = none
    if doc is not None:
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        whole = np.add.reduceat(s, starts, axis=0)
        each = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(s))))
        led = clear(whole, CLEAR, TEACH)[each]
        label[led] = whole.argmax(axis=1)[each][led]
    own = clear(s, CLEAR, TEACH)
    label[own] = s.argmax(axis=1)[own]
    return label


def document_areas(model: SubjectModels, t: Tokens, share: float) -> list[list[str]]:
    """The areas of each text: those that at least ``share`` of its sentences deal with; a sentence may deal with several."""
    return areas_of(model.dealt(t), t, model.subjects, share)


def areas_of(dealt: np.ndarray, t: Tokens, subjects: list[str], share: float) -> list[list[str]]:
    """``document_areas`` of sentences whose subjects are known."""
    out: list[list[str]] = [[] for _ in range(len(t.of_text))]
    doc = t.text
    k = len(subjects)
    total = np.bincount(doc, minlength=len(out))
    sentence, subject = np.nonzero(dealt)
    counted = np.bincount(doc[sentence] * k + subject, minlength=len(out) * k).reshape(len(out), k)
    for d, j in zip(*np.nonzero((counted > 0) & (counted >= share * total[:, None])), strict=True):
        out[d].append(subjects[j])
    return out


def _read_samples(samples: DataFrame, text_col: str, subject_col: str) -> tuple[list[str], list[str]]:
    """At most MAX_SAMPLES labelled rows, the same ones in every run."""
    rows = samples.select(text_col, subject_col).where(F.col(text_col).isNotNull() & F.col(subject_col).isNotNull()).orderBy(F.xxhash64(text_col), text_col).limit(MAX_SAMPLES).collect()
    return [r[0] for r in rows], [r[1] for r in rows]


#: Words that a block of tokenised texts holds before the next begins, and rows that are counted before they are combined.
BLOCK_WORDS, HELD_ROWS = 500_000, 2_000_000


def tokenised(docs: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    """(ids, tokens): the documents with a text, tokenised once; each row is a block of documents with their ids in order.

    Texts are tokenised whole; a block ends when it holds BLOCK_WORDS words. It is written to the
    checkpoint folder, as every round of training and the judgement read it.
    """
    kind = dict(docs.dtypes)[id_col] if id_col else "bigint"

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        parts: list[Tokens] = []
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.iloc[k : k + 256]
                ids += list(part.iloc[:, 1]) if id_col else []
                parts.append(tokens_of(list(part.iloc[:, 0])))
                if sum(len(t.words) for t in parts) >= BLOCK_WORDS:
                    yield pd.DataFrame({"ids": [ids], "tokens": [_joined(parts).pack()]})
                    ids, parts = [], []
        if parts:
            yield pd.DataFrame({"ids": [ids], "tokens": [_joined(parts).pack()]})

    cols = [text_col, id_col] if id_col else [text_col]
    return materialize(docs.select(*cols).where(F.col(text_col).isNotNull()).mapInPandas(blocks, f"ids array<{kind}>, tokens binary"))


def _joined(parts: list[Tokens]) -> Tokens:
    return Tokens(*(np.concatenate([getattr(t, f) for t in parts]) for f in ("words", "of_sentence", "of_text")))


def scored(blocks: Iterable[tuple[Any, bytes]], told: list[Broadcast]) -> Iterator[tuple[Any, Tokens, np.ndarray]]:
    """Each block (what belongs to it, packed tokens) unpacked, with the scores of its sentences by all shards of a model.

    A model in one shard is kept by the worker. The shards of a larger one are loaded in turn for each
    group of blocks of GROUP_WORDS, so that a worker holds one shard and one group, however large the model is.
    """
    held: list[tuple[Any, Tokens]] = []

    def through() -> Iterator[tuple[Any, Tokens, np.ndarray]]:
        sums = [np.float32(0)] * len(held)
        for b in told:
            # encrypted broadcasts have no file to load again
            path = getattr(b, "_path", None) if len(told) > 1 else None
            model = b.load_from_path(path) if path else b.value
            sums = [s + model.scores(t) for s, (_, t) in zip(sums, held, strict=True)]
        yield from ((x, t, s) for (x, t), s in zip(held, sums, strict=True))

    for x, blob in blocks:
        held.append((x, Tokens.unpack(blob)))
        if len(told) == 1 or sum(len(t.words) for _, t in held) >= GROUP_WORDS:
            yield from through()
            held.clear()
    if held:
        yield from through()


def model_rows(words: DataFrame, pairs: DataFrame, total: np.ndarray, k: int) -> DataFrame:
    """(hash, pair, ratio) of the words and bigrams that have a weight, from (hash, by_class) of each, computed where the counts are.

    A bigram's row needs the counts of its two words, which it meets in two joins.
    """

    def counts(col: pa.Array) -> np.ndarray:
        out = np.zeros((len(col), len(total)))
        each = col.flatten()
        row = np.repeat(np.arange(len(col)), col.value_lengths().to_numpy(zero_copy_only=False))
        out[row, each.field("class").to_numpy(zero_copy_only=False)] = each.field("n").to_numpy(zero_copy_only=False)
        return out

    def rows(b: pa.RecordBatch, pair: bool, ratio: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        n = int(keep.sum())
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * k, pa.int32())
        ratios = pa.ListArray.from_arrays(ends, pa.array(ratio[keep].astype(np.float32).ravel(), pa.float32()))
        return pa.RecordBatch.from_arrays([b.column("hash").filter(pa.array(keep)), pa.array(np.full(n, pair)), ratios], names=["hash", "pair", "ratio"])

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for b in batches:
            ratio, keep, _, _ = _ratios(counts(b.column("by_class")), np.zeros((0, len(total))), none, none, total, k)
            yield rows(b, False, ratio, keep)

    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.arange(b.num_rows)
            _, _, ratio, keep = _ratios(np.concatenate((counts(b.column("first")), counts(b.column("last")))), counts(b.column("by_class")), at, at + b.num_rows, total, k)
            yield rows(b, True, ratio, keep)

    schema = "hash bigint, pair boolean, ratio array<float>"
    keyed = pairs.select("hash", "by_class", F.shiftrightunsigned("hash", 32).alias("a"), F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"))
    first, last = words.select(F.col("hash").alias("a"), F.col("by_class").alias("first")), words.select(F.col("hash").alias("b"), F.col("by_class").alias("last"))
    met = keyed.join(first, "a").join(last, "b").select("hash", "by_class", "first", "last")
    return words.select("hash", "by_class").mapInArrow(of_words, schema).unionByName(met.mapInArrow(of_pairs, schema))


def sharded(rows: DataFrame, subjects: list[str], most: int) -> Iterator[SubjectModels]:
    """The model of ``model_rows`` in shards of about ``most`` rows; the driver holds one at a time."""
    k = len(subjects)
    rows = materialize(rows)
    shards = -(-rows.count() // most) or 1
    for s in range(shards):
        part = rows.where(F.pmod(F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(shards)) == s).toArrow()
        key = part.column("hash").to_numpy().view(np.uint64)
        pair = part.column("pair").to_numpy()
        ratio = part.column("ratio").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(key), k)
        del part
        order = np.lexsort((key, pair))
        n = int((~pair).sum())
        yield SubjectModels(subjects, key[order[:n]].astype(np.uint32), key[order[n:]], ratio[order], np.full(k, ACCEPT), (s, shards))


def train_models(blocks: DataFrame, samples: DataFrame, sample_text: str, subject_col: str, subjects: list[str], *, rounds: int = 2) -> SubjectModels:
    """The models of ``train_shards`` as one, held by the driver; ``find_areas`` does not need that."""
    told, accept = train_shards(blocks, samples, sample_text, subject_col, subjects, rounds=rounds)
    parts = [b.value for b in told]
    uni, bi = np.concatenate([m.uni for m in parts]), np.concatenate([m.bi for m in parts])
    ratio = np.concatenate([m.ratio[: len(m.uni)] for m in parts] + [m.ratio[len(m.uni) :] for m in parts])
    order = np.concatenate((np.argsort(uni), len(uni) + np.argsort(bi)))
    return SubjectModels(subjects, np.sort(uni), np.sort(bi), ratio[order], accept)


def train_shards(blocks: DataFrame, samples: DataFrame, sample_text: str, subject_col: str, subjects: list[str], *, rounds: int = 2) -> tuple[list[Broadcast], np.ndarray]:
    """Subject models from labelled samples, widened by the whole tokenised corpus, as broadcast shards, and each subject's calibrated acceptance.

    Models of the samples label the sentences of all documents that they are sure of (in the first
    round also the other sentences of documents that they are sure of); the n-grams
    of those sentences are counted over the whole corpus (combined per task before the one shuffle by n-gram)
    and, with those of the samples, give the next models, ``rounds`` times. The G statistic and the log-ratios are computed
    where the counts are: every n-gram with a weight has its row in a model, and the others have none, so that it is
    the model of all counts. Rows go through the driver in shards of SHARD_ROWS. The calibration
    looks up n-grams of the samples only, and only their counts come to the driver.
    """
    texts, labels = _read_samples(samples, sample_text, subject_col)
    own = sample_counts(texts, labels, subjects)
    none = len(subjects)
    counts = Counts.of(none + 1, own)
    spark = blocks.sparkSession
    grams_of = "pair boolean, hash bigint, class int, n bigint"
    taught = spark.createDataFrame(pa.Table.from_pandas(own, preserve_index=False)).select("pair", "hash", F.col("class").cast("int"), "n") if len(own) else spark.createDataFrame([], grams_of)
    told = [spark.sparkContext.broadcast(counts.models(subjects))]
    for turn in range(rounds):

        def count(batches: Iterator[pd.DataFrame], told: list[Broadcast] = told, by_document: bool = turn == 0) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for _, t, s in scored(((None, blob) for b in batches for blob in b["tokens"]), told):
                held.append(count_ngrams(t, teach_labels(s, none, t.text if by_document else None)))
                if sum(map(len, held)) > HELD_ROWS:
                    yield _combined(held)
                    held = []
            if held:
                yield _combined(held)

        counted = blocks.select("tokens").mapInPandas(count, grams_of).unionByName(taught)
        # one shuffle serves both aggregates: rows of an n-gram are few, one a task and class
        per_class = counted.repartition("pair", "hash").groupBy("pair", "hash", "class").agg(F.sum("n").alias("n"))
        # written once: the totals, the models and the calibration are read from it without counting again
        grams = materialize(per_class.groupBy("pair", "hash").agg(F.collect_list(F.struct("class", "n")).alias("by_class")))
        words = grams.where(~F.col("pair"))
        total = np.zeros(none + 1)
        for r in words.select(F.explode("by_class").alias("c")).groupBy("c.class").agg(F.sum("c.n").alias("n")).collect():
            total[r["class"]] = r["n"]
        pairs = grams.where(F.col("pair") & _weighty(F.col("by_class"), total))
        for b in told:
            b.destroy()
        told = [spark.sparkContext.broadcast(m) for m in sharded(model_rows(words, pairs, total, none), subjects, SHARD_ROWS)]
    if rounds:
        of_pairs = pairs.select(F.explode(F.array(F.shiftrightunsigned("hash", 32), F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("hash")).distinct().withColumn("of_pair", F.lit(True))
        sampled = taught.select("pair", "hash").distinct()
        words = words.join(sampled, ["pair", "hash"], "left_semi").join(of_pairs, "hash", "left").where(F.col("of_pair") | _weighty(F.col("by_class"), total))
        parts = words.select("pair", "hash", "by_class").unionByName(pairs.join(sampled, ["pair", "hash"], "left_semi").select("pair", "hash", "by_class"))
        counts = Counts.of(none + 1, parts.select("pair", "hash", F.explode("by_class").alias("c")).select("pair", "hash", "c.class", "c.n").toPandas(), total)
    return told, calibrated(counts, texts, labels, subjects).accept


def _weighty(by_class: Column, total: np.ndarray) -> Column:
    """Whether the counts of an n-gram per class have a trust above 0, as ``_trust`` has it, or fall short of that by rounding only."""
    free = max(int((total > 0).sum()) - 1, 1)
    share = F.array(*(F.lit(float(x)) for x in total / max(total.sum(), 1.0)))
    n = F.aggregate(by_class, F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"])
    g = F.aggregate(by_class, F.lit(0.0), lambda acc, c: acc + 2 * c["n"] * F.log(c["n"] / (n * F.get(share, c["class"]))))
    return g > NOISE * free * (1 - 1e-9)


def _combined(held: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(held).groupby(["pair", "hash", "class"], as_index=False, sort=False)["n"].sum()


def find_areas(docs: DataFrame, id_col: str, text_col: str, samples: DataFrame, subjects: DataFrame, *, share: float = SHARE, rounds: int = 2) -> DataFrame:
    """(id, subject) of each document and area that at least ``share`` of its sentences deal with.

    A sentence deals with every subject whose n-gram model has a cross-entropy per word below the
    background's by at least what the subject's calibration asks for. Documents with NULL, empty or procedural text
    have no row; each document row is judged.
    """
    names = sorted(r[0] for r in subjects.select("subject").where(F.col("subject").isNotNull()).distinct().collect())
    blocks = tokenised(docs, id_col, text_col)
    told, accept = train_shards(blocks, samples, "text", "subject", names, rounds=rounds)
    kind = dict(docs.dtypes)[id_col]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, t, scores in scored((x for b in batches for x in zip(b["ids"], b["tokens"], strict=True)), told):
            found = [(i, s) for i, areas in zip(ids, areas_of(accepted(scores, accept, t), t, names, share), strict=True) for s in areas]
            yield pd.DataFrame(found, columns=["id", "subject"])

    return blocks.mapInPandas(judge, f"`id` {kind}, subject string").select(F.col("id").alias(id_col), "subject")


def corpus_composition(areas: DataFrame) -> DataFrame:
    """Documents per area."""
    return areas.groupBy("subject").agg(F.count("*").alias("n_docs"))
