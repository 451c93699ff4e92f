"""The triple store: merging, deduplication, lookups and statistics. Every function is a lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import TRIPLE_COLS, TRIPLES


def conform(df: DataFrame) -> DataFrame:
    """The seven triple columns with their types; missing ones are NULL, extra ones are dropped."""
    have = {c.lower() for c in df.columns}
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in TRIPLES))


def merge(*parts: DataFrame) -> DataFrame:
    """All rows of several triple sets, columns matched by name."""
    out = conform(parts[0])
    for p in parts[1:]:
        out = out.unionByName(conform(p))
    return out


def best_confidence(df: DataFrame) -> DataFrame:
    """One row per statement within a law and article: highest confidence first, NULL last, then the greater source_method.

    The choice is a combinable maximum, not a window, so hot groups are reduced before the shuffle.
    """
    keys = ["law_id", "article_number", "head", "relation", "tail"]
    rank = F.struct(F.col("confidence").isNotNull().alias("h"), F.col("confidence").alias("c"), F.coalesce("source_method", F.lit("")).alias("s"), F.col("source_method").alias("m"))
    best = df.groupBy(*keys).agg(F.max(rank).alias("b"))
    return best.select("head", "relation", "tail", "law_id", "article_number", F.col("b.m").alias("source_method"), F.col("b.c").alias("confidence"))


def add_triples(store: DataFrame, new: DataFrame) -> DataFrame:
    """Store and new rows, distinct over all seven columns (NULLs equal)."""
    return merge(store, new).dropDuplicates(TRIPLE_COLS)


def by_entity(df: DataFrame, entity: str, role: str = "any") -> DataFrame:
    """Rows with the entity as head, tail, or either."""
    head, tail = F.col("head") == entity, F.col("tail") == entity
    return df.where(head if role == "head" else tail if role == "tail" else head | tail)


def by_relation(df: DataFrame, relation: str) -> DataFrame:
    return df.where(F.col("relation") == relation)


def by_law(df: DataFrame, law_id: str) -> DataFrame:
    return df.where(F.col("law_id") == law_id)


def by_article(df: DataFrame, law_id: str, article_number: str) -> DataFrame:
    """Rows of one article; article numbers are compared as text."""
    return df.where((F.col("law_id") == law_id) & (F.col("article_number") == str(article_number)))


def laws_modified_by(df: DataFrame, law: str) -> DataFrame:
    """Tails of what a law modifies, repeats kept."""
    return df.where((F.col("relation") == "modifică") & (F.col("head") == law)).select("tail")


def laws_modifying(df: DataFrame, law: str) -> DataFrame:
    """Heads of what modifies a law, repeats kept."""
    return df.where((F.col("relation") == "modifică") & (F.col("tail") == law)).select("head")


def law_emitter(df: DataFrame, law: str, seq: str) -> DataFrame:
    """The first issuer of a law by the ingest order ``seq``; one row, NULL without an issuer."""
    return df.where((F.col("relation") == "emis_de") & (F.col("head") == law)).agg(F.min_by("tail", seq).alias("emitter"))


def entity_relations(df: DataFrame, entity: str) -> DataFrame:
    """(direction, relation, other) of an entity's statements; a self-loop appears in both directions."""
    e = F.lit(entity)
    out = F.when(F.col("head") == e, F.struct(F.lit("out").alias("direction"), "relation", F.col("tail").alias("other")))
    inc = F.when(F.col("tail") == e, F.struct(F.lit("in").alias("direction"), "relation", F.col("head").alias("other")))
    return by_entity(df, entity).select(F.explode(F.array_compact(F.array(out, inc))).alias("x")).select("x.*")


def statistics(df: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """One row: total_triples, unique_entities, unique_relations, corpus_size.

    Entities are counted over both roles with one expanded aggregate.
    """
    ends = df.select(F.explode(F.array("head", "tail")).alias("e")).agg(F.count_distinct("e").alias("unique_entities"))
    base = df.agg(F.count("*").alias("total_triples"), F.count_distinct("relation").alias("unique_relations"))
    size = corpus.agg(F.count("*").alias("corpus_size")) if corpus is not None else base.select(F.lit(0).cast("bigint").alias("corpus_size"))
    return base.crossJoin(ends).crossJoin(size).select("total_triples", "unique_entities", "unique_relations", "corpus_size")  # three single rows


def relation_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("relation").agg(F.count("*").alias("n"))


def triple_sources(df: DataFrame, head: str, relation: str, tail: str) -> DataFrame:
    """Provenance rows of one statement, repeats kept."""
    return df.where((F.col("head") == head) & (F.col("relation") == relation) & (F.col("tail") == tail)).select("law_id", "article_number", "source_method", "confidence")


def triples_with_sources(df: DataFrame, *, nested: bool = False) -> DataFrame:
    """Each distinct statement (NULLs equal) with its distinct sources, counted: one row per statement and source, ``times`` how often.

    Rows are reduced on the map side, so a statement extracted any number of times costs its
    distinct provenance only, and no statement's sources meet in one row. ``nested`` gives one row
    per statement with n_sources and an array of its sources instead, for statements whose sources fit in a row.
    """
    per = df.groupBy("head", "relation", "tail", "law_id", "article_number", "source_method", "confidence").agg(F.count("*").alias("times"))
    if not nested:
        return per
    src = F.struct("law_id", "article_number", "source_method", "confidence", "times")
    return per.groupBy("head", "relation", "tail").agg(F.sum("times").alias("n_sources"), F.sort_array(F.collect_list(src)).alias("sources"))
