"""Problem 5: references of triples to acts that the register does not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import fold_tables
from ..functions.citations import ACT_FORMS, law_id_key, with_act_key
from ..operators.orphans import find_orphans, orphan_report
from ..runtime import table

KEYS = ["act_type", "number", "year"]


def act_references(triples: DataFrame) -> DataFrame:
    """One row per reference of a triple to an act: fld 'law_id' where not null, fld 'tail' where it names an act."""
    return (
        with_act_key(triples.select("triple_id", "law_id", "tail", "extracted_at"), "tail", "tail_key").select(
            "triple_id",
            "extracted_at",
            F.explode(
                F.array(
                    F.struct(F.lit("law_id").alias("fld"), law_id_key(F.col("law_id")).alias("key")),
                    F.struct(F.lit("tail").alias("fld"), F.col("tail_key").alias("key")),
                )
            ).alias("r"),
        )
        .where(F.col("r.key").isNotNull())
        .select("triple_id", "extracted_at", "r.fld", "r.key.*", F.date_format("extracted_at", "yyyy-MM").alias("ym"))
    )


def orphan_acts(triples: DataFrame, law_meta: DataFrame) -> DataFrame:
    registry = law_meta.select(law_id_key(F.col("law_id")).alias("key"), "registered_at", "withdrawn_at").select("key.*", "registered_at", "withdrawn_at")
    return find_orphans(act_references(triples), registry, KEYS, at="extracted_at", valid_from="registered_at", valid_to="withdrawn_at", match="partial")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orphan_acts(table(spark, sf_dir, "legislative_triples"), table(spark, sf_dir, "law_meta"))
    return found.select("triple_id", "fld", "ym", "orphan_kind")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, field, month and kind."""
    found = orphan_acts(table(spark, sf_dir, "legislative_triples"), table(spark, sf_dir, "law_meta"))
    return orphan_report(found.withColumn("tbl", F.lit("legislative_triples")), ["tbl", "fld", "ym"])


def _sql() -> str:
    """The same references and kinds for an SQL engine that has translate and RE2 patterns."""
    src, dst, multi = fold_tables()
    src, dst = src.replace("'", "''"), dst.replace("'", "''")
    folded = "tail"
    for k, v in multi.items():
        folded = f"replace({folded}, '{k}', '{v}')"
    folded = f"trim(regexp_replace(lower(translate({folded}, '{src}', '{dst}')), '\\s+', ' ', 'g'))"
    number = r"\s*(?:(?:nr|numarul)\b\.?)?\s*([0-9][0-9.]*)\s*(?:/|\bdin\b)\s*([0-9]{4})(?:[^0-9].*)?$"
    cases = "WHEN regexp_matches(t, '^(lege|oug|og|hg)_[0-9]+_[0-9]{4}$') THEN t"
    for prefix, forms in ACT_FORMS.items():
        pattern = f"^(?:{forms}){number}"
        cases += f" WHEN regexp_matches(t, '{pattern}') THEN '{prefix}_' || replace(regexp_extract(t, '{pattern}', 1), '.', '') || '_' || regexp_extract(t, '{pattern}', 2)"
    return f"""
SELECT triple_id, fld, strftime(seen, '%Y-%m') AS ym, CASE WHEN n = 0 THEN 'missing' WHEN n_begun = 0 THEN 'late' ELSE 'deleted' END AS orphan_kind
FROM (
  SELECT r.triple_id, r.fld, r.seen, count(m.law_id) AS n, count(m.law_id) FILTER (m.registered_at <= r.seen) AS n_begun,
         count(m.law_id) FILTER (m.registered_at <= r.seen AND (m.withdrawn_at IS NULL OR r.seen < m.withdrawn_at)) AS n_held
  FROM (
    SELECT triple_id, 'law_id' AS fld, law_id AS act, extracted_at AS seen FROM legislative_triples WHERE law_id IS NOT NULL
    UNION ALL
    SELECT triple_id, 'tail', act, seen FROM (SELECT triple_id, CASE {cases} END AS act, extracted_at AS seen FROM (SELECT triple_id, extracted_at, {folded} AS t FROM legislative_triples)) WHERE act IS NOT NULL
  ) r LEFT JOIN law_meta m ON m.law_id = r.act
  GROUP BY ALL
) WHERE n_held = 0"""


SQL = _sql()
