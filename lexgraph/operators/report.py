"""Exploratory and validation reports as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CROSS_REFERENCES, RELATIONS, TRIPLE_COLS
from . import graph, store


def basic(df: DataFrame) -> DataFrame:
    """One row: n_rows, distinct heads, tails and relations, null cells, rows in repeated statements and their share in percent."""
    groups = df.groupBy("head", "relation", "tail").agg(F.count("*").alias("k"))
    repeated = groups.agg(F.sum("k").alias("n_rows"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("n_redundant"))
    cells = sum((F.col(c).isNull().cast("int") for c in TRIPLE_COLS), F.lit(0))
    rest = df.agg(F.count_distinct("head").alias("n_heads"), F.count_distinct("tail").alias("n_tails"), F.count_distinct("relation").alias("n_relations"), F.sum(cells).alias("n_null_cells"))
    zero = F.lit(0).cast("bigint")
    return repeated.crossJoin(rest).select(  # two single rows
        F.coalesce("n_rows", zero).alias("n_rows"),
        "n_heads",
        "n_tails",
        "n_relations",
        F.coalesce("n_null_cells", zero).cast("bigint").alias("n_null_cells"),
        F.coalesce("n_redundant", zero).alias("n_redundant"),
        F.coalesce(F.try_divide(F.col("n_redundant") * 100.0, F.col("n_rows").cast("double")), F.lit(0.0)).cast("double").alias("redundancy_pct"),
    )


def top_values(df: DataFrame, col: str, n: int = 5, *, ascending: bool = False) -> DataFrame:
    """(col, n) of the ``n`` most (or least) frequent values, ties by value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").asc() if ascending else F.col("n").desc(), col).limit(n)


def vocabulary_coverage(df: DataFrame, vocabulary: Sequence[str] = RELATIONS) -> DataFrame:
    """(relation, n, in_vocabulary) of each relation found."""
    return df.where(F.col("relation").isNotNull()).groupBy("relation").agg(F.count("*").alias("n")).withColumn("in_vocabulary", F.col("relation").isin(list(vocabulary)))


def per_law(df: DataFrame) -> DataFrame:
    """(law_id, n_triples), laws without an id left out."""
    return df.where(F.col("law_id").isNotNull()).groupBy("law_id").agg(F.count("*").alias("n_triples"))


def method_share(df: DataFrame) -> DataFrame:
    """(source_method, n, pct) of each method, NULL as 'missing'."""
    c = df.groupBy(F.coalesce("source_method", F.lit("missing")).alias("source_method")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("source_method", "n", (F.col("n") * 100.0 / F.col("total")).cast("double").alias("pct"))  # one row of total


def spot_check(df: DataFrame, laws: Sequence[str], *, sample: int = 5, references: int = 10, seed: int = 42) -> DataFrame:
    """Per law: triples, distinct relations, cross-references, a fixed sample of statements, and the first cross-references.

    The sample holds the ``sample`` smallest distinct statements by a seeded hash; the references are
    the ``references`` smallest by article, head, relation and tail. Both are kept by row numbers that the planner
    limits per task before the shuffle, so a law of any size is never gathered. Without a column
    law_id a law's rows are those whose head begins with its identifier. A law without rows has none here.
    """
    if "law_id" in df.columns:
        rows = df.where(F.col("law_id").isin(list(laws)))
    else:
        rows = df.withColumn("law_id", F.explode(F.filter(F.array(*(F.lit(x) for x in laws)), lambda x: F.startswith(F.col("head"), x))))
    article = F.col("article_number") if "article_number" in df.columns else F.lit(None).cast("string")
    mark = F.xxhash64(F.lit(seed), "head", "relation", "tail", article)
    text = F.concat_ws(" | ", F.coalesce("head", F.lit("")), F.coalesce("relation", F.lit("")), F.coalesce("tail", F.lit("")))
    cross = F.col("relation").isin(list(CROSS_REFERENCES))
    stats = rows.groupBy("law_id").agg(F.count("*").alias("n_triples"), F.count_distinct("relation").alias("n_relations"), F.count_if(cross).alias("n_cross_references"))

    def first(of: DataFrame, order: list[str], n: int, out: str) -> DataFrame:
        ranked = of.withColumn("_n", F.row_number().over(Window.partitionBy("law_id").orderBy(*order))).where(F.col("_n") <= n)
        return ranked.groupBy("law_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "t"))), lambda x: x["t"]).alias(out))

    picked = first(rows.select("law_id", mark.alias("m"), text.alias("t")).distinct(), ["m", "t"], sample, "sample")
    cited = first(rows.where(cross).select("law_id", article.alias("a"), "head", "relation", "tail", text.alias("t")), ["a", "head", "relation", "tail"], references, "cross_references")
    return stats.join(picked, "law_id", "left").join(cited, "law_id", "left").select("law_id", "n_triples", "n_relations", "n_cross_references", "sample", F.coalesce("cross_references", F.array().cast("array<string>")).alias("cross_references"))


def law_summary(laws: DataFrame, text: str = "law_text") -> DataFrame:
    """Each law's length in characters and a 60-character preview on one line."""
    t = F.col(text)
    return laws.withColumn("n_chars", F.length(t)).withColumn("preview", F.substring(F.regexp_replace(t, r"\s+", " "), 1, 60))


def full_eda(df: DataFrame, *, top: int = 5, bins: int = 50) -> dict[str, DataFrame]:
    """Every exploratory report of a triple set, by name, each a lazy plan; the histograms hold the data of the plots."""
    return {
        "basic": basic(df),
        "density": graph.density(df),
        "reciprocity": graph.reciprocity(df),
        "top_relations": top_values(df, "relation", top),
        "rare_relations": top_values(df, "relation", top, ascending=True),
        "top_heads": top_values(df, "head", top),
        "top_tails": top_values(df, "tail", top),
        "relations": store.relation_histogram(df),
        "degrees": graph.degree_histogram(df, "degree", bins),
        "in_degrees": graph.degree_histogram(df, "in_degree", bins),
        "out_degrees": graph.degree_histogram(df, "out_degree", bins),
    }
