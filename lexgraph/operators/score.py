"""Document-against-ontology similarity and compliance, one row per document.

The ontology is reduced to its distinct relations, nodes and statements first; documents meet it in
hash joins on those values, never document by document.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SCORE_WEIGHTS, TAIL_DOMAIN
from .axioms import violation_counts
from .resolve import canonicalize


#: Kinds of things that documents and ontology have in common: relations, nodes and whole statements.
KINDS = ("relation", "node", "triple")


def _things(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, kind, a, b, c, n): the distinct relations, nodes and statements of each group with their counts; parts with a NULL are left out."""
    none = F.lit("")
    rows = F.array(
        F.when(F.col("relation").isNotNull(), F.struct(F.lit("relation").alias("kind"), F.col("relation").alias("a"), none.alias("b"), none.alias("c"))),
        F.when(F.col("head").isNotNull(), F.struct(F.lit("node").alias("kind"), F.col("head").alias("a"), none.alias("b"), none.alias("c"))),
        F.when(F.col("tail").isNotNull(), F.struct(F.lit("node").alias("kind"), F.col("tail").alias("a"), none.alias("b"), none.alias("c"))),
        F.when(F.col("head").isNotNull() & F.col("relation").isNotNull() & F.col("tail").isNotNull(), F.struct(F.lit("triple").alias("kind"), F.col("head").alias("a"), F.col("relation").alias("b"), F.col("tail").alias("c"))),
    )
    return df.select(*by, F.explode(F.array_compact(rows)).alias("x")).groupBy(*by, "x.kind", "x.a", "x.b", "x.c").agg(F.count("*").alias("n"))


def similarities(docs: DataFrame, onto: DataFrame, doc: str = "doc_id", kinds: Sequence[str] = KINDS) -> DataFrame:
    """(doc, relation_jaccard, node_jaccard, triple_jaccard, relation_distribution_cosine) of each document.

    |A and B| / |A or B| of the distinct values, 1 for two empty sets; the cosine of the relation
    counts, 0 if either is empty. Documents are expanded into all kinds once, reduced to distinct
    values on the map side, meet the ontology's in one join, and are aggregated once.
    """
    wanted = F.col("kind").isin(list(kinds))
    mine = _things(docs, [doc]).where(wanted)
    theirs = _things(onto).where(wanted).withColumnRenamed("n", "y")

    def of(kind: str, x: Column) -> Column:
        return F.when(F.col("kind") == kind, x)

    size = theirs.agg(*(F.count(of(k, F.lit(1))).alias(f"o_{k}") for k in KINDS), F.sum(of("relation", F.col("y") * F.col("y"))).cast("double").alias("yy"))
    met = mine.join(theirs, ["kind", "a", "b", "c"], "left").groupBy(doc).agg(
        *(F.count(of(k, F.lit(1))).alias(f"d_{k}") for k in KINDS),
        *(F.count(of(k, F.col("y"))).alias(f"b_{k}") for k in KINDS),
        F.sum(of("relation", F.col("n") * F.coalesce("y", F.lit(0)))).cast("double").alias("xy"),
        F.sum(of("relation", F.col("n") * F.col("n"))).cast("double").alias("xx"),
    )
    every = docs.groupBy(doc).agg(F.lit(1).alias("_one")).select(doc).join(met, doc, "left").crossJoin(F.broadcast(size))  # one row of sizes
    zero = F.lit(0)

    def jaccard(k: str) -> Column:
        both = F.coalesce(f"b_{k}", zero)
        union = F.coalesce(f"d_{k}", zero) + F.col(f"o_{k}") - both
        return F.when(union == 0, 1.0).otherwise(F.try_divide(both.cast("double"), union.cast("double"))).alias(f"{k}_jaccard")

    cosine = F.coalesce(F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))), F.lit(0.0)).alias("relation_distribution_cosine")
    return every.select(doc, *(jaccard(k) for k in KINDS), cosine)


def relation_jaccard(docs: DataFrame, onto: DataFrame, doc: str = "doc_id") -> DataFrame:
    return similarities(docs, onto, doc, ["relation"]).select(doc, "relation_jaccard")


def triple_jaccard(docs: DataFrame, onto: DataFrame, doc: str = "doc_id") -> DataFrame:
    return similarities(docs, onto, doc, ["triple"]).select(doc, "triple_jaccard")


def node_jaccard(docs: DataFrame, onto: DataFrame, doc: str = "doc_id") -> DataFrame:
    return similarities(docs, onto, doc, ["node"]).select(doc, "node_jaccard")


def relation_cosine(docs: DataFrame, onto: DataFrame, doc: str = "doc_id") -> DataFrame:
    return similarities(docs, onto, doc, ["relation"]).select(doc, "relation_distribution_cosine")


def compliance(docs: DataFrame, onto: DataFrame, doc: str = "doc_id", *, weights: Mapping[str, float] = SCORE_WEIGHTS, domains: Mapping[str, Sequence[str]] = TAIL_DOMAIN) -> DataFrame:
    """The similarity report: sizes, the four similarities, axiom violations and conformance, and their weighted sum."""
    v = violation_counts(docs, [doc], domains)
    out = v.join(similarities(docs, onto, doc), doc)
    conformance = F.greatest(F.lit(0.0), 1 - F.col("total").cast("double") / F.greatest("n_triples", F.lit(1)))
    out = out.withColumn("axiom_conformance", conformance)
    score = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    violations = F.struct("functional", "asymmetric", "irreflexive", "domain", "vocabulary", "total").alias("axiom_violations")
    return out.select(
        doc, "n_triples", "relation_jaccard", "relation_distribution_cosine", "node_jaccard", "triple_jaccard", "axiom_conformance", violations, score.alias("compliance_score")
    )


def compare_documents(docs: DataFrame, store: DataFrame, aliases: DataFrame | None = None, *, doc: str = "doc_id") -> DataFrame:
    """The similarity report of every document of ``docs`` (as ``sources.files.read_documents`` gives them) against a triple store.

    The store's entities are made canonical first; each report also has n_dropped, the distinct
    relations of the document that are not in the vocabulary. An empty store is an error.
    """
    if store.isEmpty():
        raise ValueError("the triple store is empty")
    report = compliance(docs, canonicalize(store, ["head", "tail"], aliases), doc)
    dropped = docs.groupBy(doc).agg(F.max(F.size("dropped")).alias("n_dropped"))
    return report.join(dropped, doc).select(doc, "n_dropped", *(c for c in report.columns if c != doc))
