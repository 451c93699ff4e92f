"""Triples out of language-model responses; the model itself is a pluggable callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LLM_CONFIDENCE, RELATIONS
from ..functions.text import normalize_relation
from .segment import llm_windows

PROMPT = (
    "Extrage din textul de mai jos enunțuri de forma [subiect | relație | obiect], câte unul pe linie.\n"
    "Folosește numai relațiile de mai jos; un fapt care nu se încadrează se ignoră:\n{relations}\n"
    "Text:\n{text}\n"
)


def vocabulary_block(descriptions: Mapping[str, str] | None = None) -> str:
    """The relations, one a line, each with its description where there is one (as in ``relation_vocab``)."""
    told = descriptions or {}
    return "\n".join(f"- {r}: {told[r]}" if told.get(r) else f"- {r}" for r in RELATIONS)


def prompt(text: str, descriptions: Mapping[str, str] | None = None) -> str:
    return PROMPT.format(relations=vocabulary_block(descriptions), text=text)


def recorded(windows: DataFrame, text: str, responses: DataFrame, out: str = "response") -> DataFrame:
    """Adds to each window the response recorded for its text in ``responses`` (window_hash, response), NULL where there is none.

    The offline default in place of a model: responses are found by the SHA-256 of the window's text; of several the smallest counts.
    """
    known = responses.groupBy("window_hash").agg(F.min("response").alias(out))
    return windows.withColumn("window_hash", window_hash(F.col(text))).join(known, "window_hash", "left").drop("window_hash")


def window_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def respond(windows: DataFrame, text: str, model: Callable[[list[str]], list[str]] | None = None, out: str = "response", *, responses: DataFrame | None = None, descriptions: Mapping[str, str] | None = None) -> DataFrame:
    """Adds the model's response to each window; the callable gets a batch of prompts on an executor and must be picklable.

    Without a callable the ``responses`` recorded before are used.
    """
    if model is None:
        if responses is None:
            raise ValueError("a model or recorded responses are needed")
        return recorded(windows, text, responses, out)

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model([prompt(v or "", descriptions) for v in s]), dtype=object)

    return windows.withColumn(out, answers(text))


def windows_of(articles: DataFrame, text: str = "text", *, size: int = 4000, overlap: int = 200) -> DataFrame:
    """One row per window of each article: window_no from 0, window."""
    rest = [c for c in articles.columns if c != text]
    return articles.select(*rest, F.posexplode(llm_windows(F.col(text), size=size, overlap=overlap)).alias("window_no", "window"))


def _fields(line: Column) -> Column:
    """Three fields of a bracketed line: split at '|' (a fourth and later ones dropped), else at ',' (later ones put back into the third)."""
    inner = F.translate(F.regexp_extract(line, r"\[(.*)\]", 1), "\"'", "")
    bars, commas = F.split(inner, r"\|"), F.split(inner, ",")
    by_comma = F.when(F.size(commas) > 3, F.concat(F.slice(commas, 1, 2), F.array(F.array_join(F.slice(commas, F.lit(3), F.size(commas)), ",")))).otherwise(commas)
    return F.transform(F.when(inner.contains("|"), F.slice(bars, 1, 3)).otherwise(by_comma), lambda x: F.trim(x))


def parse_responses(responses: DataFrame, response: str = "response") -> DataFrame:
    """Distinct statements of each response: its other columns, head, relation, tail, source_method, confidence.

    A line counts if it has brackets with three non-empty fields and a relation of the vocabulary.
    """
    rest = [c for c in responses.columns if c != response]
    lines = responses.select(*rest, F.explode(F.split(response, r"\r?\n")).alias("_l")).where(F.col("_l").rlike(r"\[.*\]"))
    fields = lines.select(*rest, _fields(F.col("_l")).alias("_f")).where((F.size("_f") == 3) & F.forall("_f", lambda x: x != ""))
    parsed = fields.select(*rest, F.col("_f")[0].alias("head"), normalize_relation(F.col("_f")[1]).alias("relation"), F.col("_f")[2].alias("tail")).where(F.col("relation").isNotNull())
    return parsed.distinct().withColumn("source_method", F.lit("llm")).withColumn("confidence", F.lit(LLM_CONFIDENCE))
