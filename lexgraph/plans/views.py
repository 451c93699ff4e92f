"""Triple tables drawn from the star-schema and event tables, whose every value the SQL side can derive too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table

# The relation each event type stands for.
EVENT_RELATIONS = {"click": "modifică", "view": "colaborează_cu", "purchase": "emis_de", "error": "abroga", "signup": "completează"}

KG_EVENTS_SQL = """
SELECT 'user_' || user_id AS head,
       CASE event_type WHEN 'click' THEN 'modifică' WHEN 'view' THEN 'colaborează_cu' WHEN 'purchase' THEN 'emis_de'
            WHEN 'error' THEN 'abroga' WHEN 'signup' THEN 'completează' END AS relation,
       'user_' || json_extract_string(props, '$.k') AS tail,
       'day_' || strftime(ts, '%Y-%m-%d') AS law_id,
       CAST(hour(ts) AS VARCHAR) AS article_number,
       CASE WHEN event_id % 2 = 0 THEN 'regex' ELSE 'llm' END AS source_method,
       CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence,
       event_id AS seq
FROM events
"""

KG_LINEITEM_SQL = """
SELECT 'supp_' || l_suppkey AS head, 'livrează' AS relation, 'part_' || l_partkey AS tail,
       'order_' || l_orderkey AS law_id, CAST(l_linenumber AS VARCHAR) AS article_number,
       CASE WHEN l_linestatus = 'O' THEN 'llm' ELSE 'regex' END AS source_method,
       CASE WHEN l_linestatus = 'O' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS confidence
FROM lineitem
"""


def kg_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as statements between users; ``seq`` is the ingest order."""
    relation = F.create_map(*(F.lit(x) for k, v in EVENT_RELATIONS.items() for x in (k, v)))
    even = F.col("event_id") % 2 == 0
    return table(spark, d, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("head"),
        F.try_element_at(relation, F.col("event_type")).alias("relation"),
        F.concat(F.lit("user_"), F.get_json_object("props", "$.k")).alias("tail"),
        F.concat(F.lit("day_"), F.date_format("ts", "yyyy-MM-dd")).alias("law_id"),
        F.hour("ts").cast("string").alias("article_number"),
        F.when(even, "regex").otherwise("llm").alias("source_method"),
        F.when(even, 1.0).otherwise(0.7).alias("confidence"),
        F.col("event_id").alias("seq"),
    )


def kg_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Line items as statements of suppliers about parts, with repeats."""
    open_ = F.col("l_linestatus") == "O"
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("head"),
        F.lit("livrează").alias("relation"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("tail"),
        F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("law_id"),
        F.col("l_linenumber").cast("string").alias("article_number"),
        F.when(open_, "llm").otherwise("regex").alias("source_method"),
        F.when(open_, 0.7).otherwise(1.0).alias("confidence"),
    )


def act_texts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as acts: (law_id, law_text) with one article per distinct line number, each citing an act."""
    lines = (
        table(spark, d, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("part"), F.min(F.year("l_shipdate")).alias("y"))
    )
    article = F.concat(F.lit("Articolul "), F.col("l_linenumber").cast("string"), F.lit("\nSe modifică Legea nr. "), F.col("part").cast("string"), F.lit("/"), F.col("y").cast("string"))
    texts = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", article.alias("a")))).alias("xs"))
    return texts.select(F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("law_id"), F.array_join(F.transform("xs", lambda x: x["a"]), "\n").alias("law_text"))


ACT_LINES_SQL = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(year(l_shipdate)) AS y FROM lineitem GROUP BY 1, 2"
