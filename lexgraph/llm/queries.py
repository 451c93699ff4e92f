"""Queries of the training-data operators over a data directory, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import encoding, leakage, names, splitter, subjects, survivors, textform, vocabmap


def _vocabulary(spark: SparkSession, d: str) -> list[str]:
    """Clean spellings for the trie: the words of the register's titles and issuers."""
    return textform.clean_vocabulary(table(spark, d, "law_meta"), ["titlu", "emitent"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitter.find_oversized(table(spark, d, "legislative_corpus"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every text with its place and a digest."""
    pieces = splitter.split_texts(table(spark, d, "legislative_corpus").select("corpus_id", "law_text"), "law_text")
    return pieces.select("corpus_id", "piece_no", "n_pieces", "start", F.length("piece").alias("n_chars"), F.md5("piece").alias("digest"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    linked = names.find_variants(table(spark, d, "legislative_triples"), table(spark, d, "law_meta"), table(spark, d, "issuers"))
    return names.variant_pairs(linked)


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """Spellings per entity: each name with its entity."""
    return names.find_variants(table(spark, d, "legislative_triples"), table(spark, d, "law_meta"), table(spark, d, "issuers"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # only ids of rows are asked for, in which the consensus of head, relation and tail has no say
    s = survivors.find_survivors(table(spark, d, "legislative_triples"), table(spark, d, "relation_vocab"), _vocabulary(spark, d), consensus=False)
    return s.select("group_id", F.col("source_method_id").alias("source_id"), "confidence_id", F.col("article_number_id").alias("article_id"))


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.surviving_records(table(spark, d, "legislative_triples"), table(spark, d, "relation_vocab"), _vocabulary(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    v = _vocabulary(spark, d)
    a = textform.find_inconsistent(table(spark, d, "legislative_triples"), "triple_id", ["head", "tail"], "legislative_triples", v)
    b = textform.find_inconsistent(table(spark, d, "legislative_corpus"), "corpus_id", ["law_text"], "legislative_corpus", v)
    return a.unionByName(b).select("tbl", "row_id", "fld")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Heads and tails in the consistent form."""
    v = _vocabulary(spark, d)
    t = table(spark, d, "legislative_triples").select("triple_id", "head", "tail")
    return textform.with_form(textform.with_form(t, "head", "head_form", v), "tail", "tail_form", v).select("triple_id", "head_form", "tail_form")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return vocabmap.find_mapped(table(spark, d, "legislative_triples"), table(spark, d, "law_meta"), table(spark, d, "relation_vocab"), table(spark, d, "issuers"))


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values without an entry, counted per table and field."""
    found = p6_found(spark, d)
    return found.groupBy("tbl", "fld").agg(F.count("*").alias("n_values"), F.count_if(F.col("target") == vocabmap.UNMATCHED).alias("n_unmatched"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids are their text again, and others."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("original"))
    back = encoding.decode(encoding.encode_corpus(docs, "doc_id", "original"), "ids").select("doc_id", "text")
    return docs.join(back, "doc_id").groupBy((F.col("text") == F.col("original")).alias("same")).agg(F.count("*").alias("n_docs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage")


def p8_removed(spark: SparkSession, d: str) -> DataFrame:
    """Characters that the removal of leaked passages takes from each affected document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    cut = leakage.remove_leaks(docs, "text", table(spark, d, "eval_items"), "item_id", "passage")
    return cut.select("doc_id", F.length("text").alias("n_before"), F.length("clean_text").alias("n_after")).where("n_after < n_before")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.find_areas(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "subject_samples"), table(spark, d, "subjects"))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.corpus_composition(p9_found(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_pieces, p2_found, p2_entities, p3_found, p3_survivors, p4_found, p4_forms, p6_found, p6_unmatched, p7_ids, p7_roundtrip, p8_found, p8_removed, p9_found, p9_composition)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can state; the others are tested against brute force and round trips."""
    return {
        "p1_found": "SELECT corpus_id FROM legislative_corpus WHERE length(law_text) > 4000",
        "p7_roundtrip": "SELECT true AS same, count(*) AS n_docs FROM documents",
    }
