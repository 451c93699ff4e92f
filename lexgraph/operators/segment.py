"""Laws cut into articles, and articles into windows for a language model."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import unclash

# How an article header line is written.
HEADER = re.compile(r"^[ \t]*(?:(?:ART|ARTICOLUL)\.?[ \t]+(?P<num>\d+(?:\^\d+)?|[IVXLCDM]+)\b|ARTICOL[ \t]+(?P<one>UNIC)\b)[^\n]*$", re.IGNORECASE | re.MULTILINE)
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
#: Text before the first header is kept as a preamble from this length on.
LEAST_PREAMBLE = 40


def roman_value(s: str) -> int:
    total = 0
    for a, b in zip(s, s[1:] + " ", strict=True):
        v = ROMAN[a]
        total += -v if ROMAN.get(b, 0) > v else v
    return total


def base_number(label: str) -> int:
    """14 of '14^2', 3 of 'III', 0 of 'unic', -1 of what is neither."""
    if label.lower() == "unic":
        return 0
    if label[0].isdigit():
        return int(label.partition("^")[0])
    return roman_value(label) if all(c in ROMAN for c in label) else -1


def rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence: the earliest end among equals, then the earliest parent of each.

    Patience sorting gives the length of the best run ending at each place in n log n; the run is
    then read off backwards.
    """
    piles: list[int] = []
    length: list[int] = []
    for v in values:
        k = bisect_left(piles, v)
        piles[k : k + 1] = [v]
        length.append(k + 1)
    if not length:
        return []
    # earliest place of each length below a bound, found by one backward walk per step
    need = max(length)
    at = length.index(need)
    chain = [at]
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(length):
        by_length.setdefault(n, []).append(i)
    while need > 1:
        need -= 1
        at = next(i for i in by_length[need] if i < at and values[i] < values[at])
        chain.append(at)
    return chain[::-1]


def split_articles(text: str | None, *, inline_body: bool = False) -> list[dict]:
    """[{article_number, header, text}] of a law text.

    Blank: none. No header: one 'full' chunk. A single-article header wins over all others; else
    only headers of the prevailing numeral style count (Arabic on a tie), and of these a longest
    strictly rising run, which drops quoted headers of other acts. Empty bodies are dropped; with
    ``inline_body`` the rest of the header line opens the body.
    """
    if text is None or not text.strip():
        return []
    found = [(m.start(), m.end(), m["num"] or "unic", m[0].strip(), m.end("num") if m["num"] else m.end("one")) for m in HEADER.finditer(text)]
    if not found:
        return [{"article_number": "full", "header": "", "text": text.strip()}]
    single = [h for h in found if h[2] == "unic"]
    if single:
        kept = single[:1]
    else:
        # case matters here although it does not in the scan: a lower-case numeral counts as Arabic, of base -1
        roman = [h for h in found if all(c in ROMAN for c in h[2])]
        arabic = [h for h in found if not all(c in ROMAN for c in h[2])]
        style = roman if len(roman) > len(arabic) else arabic
        kept = [style[i] for i in rising([base_number(h[2]) for h in style])]
    out = []
    before = text[: kept[0][0]].strip()
    if len(before) >= LEAST_PREAMBLE:
        out.append({"article_number": "preambul", "header": "", "text": before})
    for this, after in zip(kept, [*kept[1:], (len(text),)], strict=True):
        body = text[this[4] if inline_body else this[1] : after[0]].strip()
        if body:
            out.append({"article_number": this[2], "header": this[3], "text": body})
    return out


def first_laws(laws: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` laws by law_id (a law read twice counts twice); 0 or None is no limit. Only ``n`` rows of a task survive its sort."""
    return laws.orderBy("law_id", "law_text").limit(n) if n else laws


def first_articles(articles: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` articles of each law; 0 or None is no limit."""
    return articles.where(F.col("pos") <= n) if n else articles


ARTICLES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("article_number", "header", "text")]))


def split_into_articles(laws: DataFrame, text: str = "law_text", *, inline_body: bool = False) -> DataFrame:
    """One row per article: the columns of ``laws`` but the text, then pos (from 1), article_number, header, text.

    The scan of a law is sequential (a longest rising run), hence a vectorised UDF; laws are
    independent of each other.
    """

    @F.pandas_udf(ARTICLES)
    def articles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: split_articles(v, inline_body=inline_body))

    rest = [c for c in laws.columns if c != text]
    names = unclash(laws.select(*rest), "pos", "article_number", "header", "text")
    return laws.select(*rest, F.posexplode(articles(text)).alias("_p", "_a")).select(*rest, (F.col("_p") + 1).alias(names[0]), *(F.col(f"_a.{f}").alias(n) for f, n in zip(("article_number", "header", "text"), names[1:], strict=True)))


def llm_windows(c: Column, *, size: int = 4000, overlap: int = 200) -> Column:
    """Windows of a text for a language model, as an array.

    A text within ``size`` is one window. Paragraphs (split at empty lines) are packed greedily;
    one that is longer than ``size`` closes the window before it and is cut into windows of
    ``size`` that overlap by ``overlap``. NULL gives NULL, an empty text one empty window.
    """
    stride = size - overlap
    none = F.array().cast("array<string>")

    def fixed(p: Column) -> Column:
        last = F.greatest(F.ceil((F.length(p) - size) / stride), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(p, i * stride + 1, F.lit(size)))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["buf"] == "", p).otherwise(F.concat(acc["buf"], F.lit("\n\n"), p))
        flushed = F.when(acc["buf"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buf"])))
        return (
            F.when(F.length(p) > size, F.struct(F.lit("").alias("buf"), F.concat(flushed, fixed(p)).alias("out")))
            .when(F.length(joined) <= size, F.struct(joined.alias("buf"), acc["out"].alias("out")))
            .otherwise(F.struct(p.alias("buf"), flushed.alias("out")))
        )

    packed = F.aggregate(
        F.split(c, "\n\n"),
        F.struct(F.lit("").alias("buf"), none.alias("out")),
        step,
        lambda a: F.when(a["buf"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"]))),
    )
    return F.when(F.length(c) <= size, F.array(c)).otherwise(packed)
