"""Queries that write the test tables through every sink into the shared checkpoint folder and read them again through the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MONTHS, TRIPLE_COLS
from ..operators import vector
from ..runtime import scratch, table
from ..sources import files
from .views import KG_EVENTS_SQL, kg_events

#: Words that test embeddings have as dimensions.
DIM = 16


def store_parquet(spark: SparkSession, d: str) -> DataFrame:
    """All triples and the corpus written as a store and read again: the triples."""
    path = scratch(spark)
    files.write_store(table(spark, d, "legislative_triples"), table(spark, d, "legislative_corpus"), path)
    return files.read_triples(spark, f"{path}/triples")


def store_corpus(spark: SparkSession, d: str) -> DataFrame:
    """All triples and the corpus written as a store of CSV files and read again: the corpus, by its digests."""
    path = scratch(spark)
    files.write_store(table(spark, d, "legislative_triples"), table(spark, d, "legislative_corpus"), path, "csv")
    return files.read_corpus(spark, path, "csv").select("law_id", F.md5("law_text").alias("digest"))


def export_csv(spark: SparkSession, d: str) -> DataFrame:
    """All triples exported as CSV and read again with their schema."""
    path = scratch(spark)
    files.write_triples(table(spark, d, "legislative_triples").select(*TRIPLE_COLS), path, "csv")
    return files.read_triples(spark, path, "csv")


def read_documents(spark: SparkSession, d: str) -> DataFrame:
    """Events of each day written as a document graph, one of their relations outside the vocabulary, and loaded again."""
    path = scratch(spark)
    e = kg_events(spark, d).withColumn("relation", F.when(F.col("relation") == "abroga", "distruge").otherwise(F.upper("relation")))
    docs = e.groupBy(F.col("law_id").alias("doc_id")).agg(F.collect_list(F.struct("head", "relation", "tail", "article_number")).alias("triples"))
    docs.withColumn("title", F.concat(F.lit("Ziua "), F.col("doc_id"))).repartition(4).write.json(path)
    got = files.read_documents(spark, path, multi_line=False)
    return got.select("doc_id", "title", "head", "relation", "tail", "article_number", F.array_join("dropped", ",").alias("dropped"))


def sidecars(spark: SparkSession, d: str) -> DataFrame:
    """Headers of orders of odd customers get sidecars, then all that have none yet: the parsed fields of each."""
    o = table(spark, d, "orders")
    months = F.array(*(F.lit(m) for m in MONTHS))
    date = F.concat_ws(" ", F.dayofmonth("o_orderdate").cast("string"), F.get(months, F.month("o_orderdate") - 1), F.year("o_orderdate").cast("string"))
    text = F.concat(F.lit("HOTĂRÂRE nr. "), F.col("o_orderkey").cast("string"), F.lit(" din "), date, F.lit("\nprivind clientul "), F.col("o_custkey").cast("string"))
    laws = o.select(F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("law_id"), text.alias("law_text"), "o_custkey")
    path = scratch(spark)
    files.write_meta(files.missing_meta(laws.where("o_custkey % 2 = 1").select("law_id", F.concat(F.lit("LEGE"), F.substring("law_text", 9, 1000)).alias("law_text")), spark.createDataFrame([], files.META)), path)
    files.write_meta(files.missing_meta(laws, files.read_meta_store(spark, path)), path)
    return files.read_meta_store(spark, path).select("law_id", "tip_act", "numar", "an", "titlu", "data_act", "in_force")


def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """Embedded chunks of all documents appended twice, the second time with the missing ones: keys and dimensions."""
    path = scratch(spark)
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("chunk_id"), "doc_id", "text")
    embedded = vector.embed(docs, "text", lambda texts: vector.hashing_embedding(texts, DIM)).select("chunk_id", "doc_id", "embedding")
    files.append_chunks(embedded.where("doc_id % 2 = 0"), path)
    files.append_chunks(embedded, path)
    return files.read_chunks(spark, path).select("chunk_id", F.size("embedding").alias("n_dims"))


ALL = (store_parquet, store_corpus, export_csv, read_documents, sidecars, vector_store)


def oracle_sql() -> dict[str, str]:
    cols = ", ".join(TRIPLE_COLS)
    return {
        "store_parquet": f"SELECT {cols} FROM legislative_triples",
        "store_corpus": "SELECT law_id, md5(nullif(law_text, '')) AS digest FROM legislative_corpus",
        "export_csv": f"SELECT {cols} FROM legislative_triples",
        "read_documents": f"WITH kg AS ({KG_EVENTS_SQL}) SELECT law_id AS doc_id, 'Ziua ' || law_id AS title, head, relation, tail, article_number, CASE WHEN law_id IN (SELECT law_id FROM kg WHERE relation = 'abroga') THEN 'distruge' ELSE '' END AS dropped FROM kg WHERE relation <> 'abroga'",
        "sidecars": "SELECT 'order_' || o_orderkey AS law_id, CASE WHEN o_custkey % 2 = 1 THEN 'Lege' ELSE 'Hotărâre de guvern' END AS tip_act, o_orderkey::VARCHAR AS numar, year(o_orderdate)::VARCHAR AS an, 'privind clientul ' || o_custkey AS titlu, strftime(o_orderdate, '%Y-%m-%d') AS data_act, true AS in_force FROM orders",
        "vector_store": f"SELECT 'doc_' || doc_id AS chunk_id, {DIM}::INTEGER AS n_dims FROM documents",
    }
