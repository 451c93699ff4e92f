"""Problem 1: texts over a size limit cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import unclash

#: Cut penalties by kind of boundary, best first; a cut at a kind is as bad as a piece that much off its share.
PENALTY = {"article": 0.0, "paragraph": 0.15, "line": 0.25, "sentence": 0.5, "word": 2.0, "hard": 6.0}
KINDS = tuple(PENALTY)
#: How strongly unequal pieces count against worse boundaries.
BALANCE = 1.0

_ARTICLE = re.compile(r"(?m)^[ \t]*(?=(?:art(?:icol(?:ul)?)?|cap(?:itolul)?|sec(?:[țţt]iunea)?|anexa)\b\.?[ \t]+(?:\d|[ivxlc]+\b|unic))", re.I)
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?;…][\"”»)\]]*\s+(?=[\"„«(\[]?[^\W\d_a-z])")


def boundaries(text: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut positions and the penalty of each.

    A cut position is the start of what follows it. Where natural boundaries lie more than
    ``step`` apart, word starts are added every ``step``, and where there is no word, bare positions.
    """
    best: dict[int, float] = {}
    for kind, pattern in (("sentence", _SENTENCE), ("line", _LINE), ("paragraph", _PARAGRAPH)):
        for m in pattern.finditer(text):
            best[m.end()] = PENALTY[kind]
    for m in _ARTICLE.finditer(text):
        best[m.start()] = PENALTY["article"]
    n = len(text)
    best.pop(0, None)
    best.pop(n, None)
    filled = dict(best)
    last = 0
    for p in [*sorted(best), n]:
        while p - last > step:
            space = max(text.rfind(" ", last + step // 2, last + step), text.rfind("\n", last + step // 2, last + step))
            last = space + 1 if space >= 0 else last + step
            filled[last] = PENALTY["word"] if space >= 0 else PENALTY["hard"]
        last = p
    at = np.array(sorted(filled), dtype=np.int64)
    return at, np.array([filled[p] for p in at.tolist()], dtype=np.float64)


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The spans [start, end) of the pieces of a text.

    Each piece has at most ``limit`` characters and shares exactly ``overlap`` with the one before
    it. Dynamic programming over the boundary positions minimises the sum of the cut penalties and
    of the squared deviations from an equal share; among equal sums the earlier cut wins.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    room = limit - overlap
    if room <= overlap:
        raise ValueError("the overlap must be below half the limit")
    at, penalty = boundaries(text, max(1, room // 8))
    keep = at > overlap  # an end within the first overlap would leave no progress
    at, penalty = at[keep], penalty[keep]
    share = (n - overlap) / -(-(n - overlap) // room)
    ends = np.append(at, n)
    cost = np.append(penalty, 0.0)
    best = np.full(len(ends), np.inf)
    back = np.full(len(ends), -1, dtype=np.int64)
    points = ends.tolist()
    for j, e in enumerate(points):
        # the first piece begins at 0 and has no overlap before it
        if e <= limit:
            best[j] = cost[j] + BALANCE * ((e - overlap - share) / share) ** 2
        lo = bisect_left(points, e - room)
        if lo < j:
            got = best[lo:j] + BALANCE * ((e - ends[lo:j] - share) / share) ** 2
            k = int(np.argmin(got))
            if got[k] + cost[j] < best[j]:
                best[j], back[j] = got[k] + cost[j], lo + k
    spans, j = [], len(points) - 1
    while j >= 0:
        i = int(back[j])
        spans.append((points[i] - overlap if i >= 0 else 0, points[j]))
        j = i
    return spans[::-1]


def split_texts(df: DataFrame, text_col: str, *, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """One row per piece: the columns of ``df`` but the text, and piece_no, n_pieces, start, piece.

    Lengths are in characters (code points). A text within the limit is its own single piece and
    never leaves the JVM; an empty or NULL text has no piece; a blank one is kept as it is. The
    pieces put together without their overlaps are the text again. Only spans come back from
    Python; the planner cuts the pieces out of the text.
    """
    span_t = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))

    @F.pandas_udf(span_t)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda v: None if v is None else [{"s": s, "e": e} for s, e in cut(v, limit, overlap)])

    # declared as not deterministic, so that the planner never computes it twice (for a filter on its size, too)
    spans = spans.asNondeterministic()
    text = F.col(text_col)
    own = F.array(F.struct(F.lit(0).alias("s"), F.length(text).alias("e")))
    empty = F.array().cast(span_t)
    sp = unclash(df, "_spans")[0]
    all_spans = F.when(F.length(text) > limit, F.col(sp)).when(F.length(text) > 0, own).otherwise(empty)
    rest = [c for c in df.columns if c != text_col]
    names = unclash(df.select(*rest), "piece_no", "n_pieces", "start", "piece")
    cut_up = df.withColumn(sp, spans(F.when(F.length(text) > limit, text))).withColumn(sp, all_spans)
    return cut_up.select(*rest, text_col, F.size(sp).alias("_n"), F.posexplode(sp).alias("_p", "_s")).select(
        *rest,
        (F.col("_p") + 1).alias(names[0]),
        F.col("_n").alias(names[1]),
        F.col("_s.s").alias(names[2]),
        F.substring(text_col, F.col("_s.s") + 1, F.col("_s.e") - F.col("_s.s")).alias(names[3]),
    )


def find_oversized(corpus: DataFrame, *, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """corpus_id of each row whose text had to be cut: the rows that have a second piece."""
    return split_texts(corpus.select("corpus_id", "law_text"), "law_text", limit=limit, overlap=overlap).where("piece_no = 2").select("corpus_id")
