"""Readers and writers of law texts, metadata sidecars, document graphs and triple stores."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import TRIPLES
from ..functions.text import header_meta, normalize_relation, normalize_ro
from ..operators.resolve import canonicalize
from ..operators.store import conform

META = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("law_id", "tip_act", "numar", "an", "titlu", "emitent", "data_act", "data_publicare", "monitorul_oficial_nr", "source_url")]
    + [T.StructField("in_force", T.BooleanType()), T.StructField("aliases", T.ArrayType(T.StringType()))]
)
DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("triples", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("head", "relation", "tail", "article_number")]))),
    ]
)


#: CSV that keeps every value: blanks at its ends, quotes and line ends inside; an empty text is read back as NULL.
CSV = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}


def _stem() -> Column:
    """File name without its ending."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.meta)?\.[^.]*$", 1)


def read_laws(spark: SparkSession, directory: str) -> DataFrame:
    """(law_id, law_text, meta): each non-empty .txt file, normalised, with its .meta.json sidecar where there is one.

    The identifier is the sidecar's, else the file's stem. A sidecar that is no JSON counts as absent.
    """
    texts = spark.read.option("pathGlobFilter", "*.txt").text(directory, wholetext=True).select(_stem().alias("stem"), F.col("value"))
    texts = texts.where(F.length("value") > 0).select("stem", normalize_ro(F.col("value")).alias("law_text"))
    meta = read_meta(spark, directory)
    joined = texts.join(meta.withColumnRenamed("file_stem", "stem"), "stem", "left")
    fields = [F.col(f.name) if f.name != "law_id" else F.coalesce("law_id", "stem").alias("law_id") for f in META]
    return joined.select(F.coalesce("law_id", "stem").alias("law_id"), "law_text", F.struct(*fields).alias("meta"))


def read_meta(spark: SparkSession, directory: str) -> DataFrame:
    """Sidecars as rows, with the stem of the file each belongs to; broken ones are dropped."""
    broken = "_broken"
    raw = spark.read.schema(T.StructType([*META.fields, T.StructField(broken, T.StringType())])).options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=broken, pathGlobFilter="*.meta.json").json(directory)
    return raw.select(_stem().alias("file_stem"), "*").where(F.col(broken).isNull()).drop(broken)


def missing_meta(laws: DataFrame, meta: DataFrame, text: str = "law_text", *, overwrite: bool = False) -> DataFrame:
    """Sidecar rows for the laws (raw texts, header included) that have none in ``meta``; with ``overwrite`` for all of them."""
    fresh = laws if overwrite else laws.join(meta.select("law_id").where(F.col("law_id").isNotNull()).distinct(), "law_id", "left_anti")
    derived = derive_meta(fresh, text)
    known = {"source_url": F.lit("https://legislatie.just.ro"), "in_force": F.lit(True)}  # Fixed values: what a new sidecar states
    return derived.select(*(known.get(f.name, F.col(f.name) if f.name in derived.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in META))


def write_meta(meta: DataFrame, path: str) -> None:
    """Sidecar rows appended as JSON lines; with ``missing_meta`` the ones that are there stay as they are."""
    meta.write.mode("append").json(path)


def read_meta_store(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_meta`` has written."""
    return spark.read.schema(META).json(path)


def derive_meta(laws: DataFrame, text: str = "law_text") -> DataFrame:
    """Sidecar rows parsed out of the headers of laws that come without one (raw texts, header included)."""
    return laws.select("law_id", header_meta(F.col(text)).alias("m")).select("law_id", "m.*")


def read_documents(spark: SparkSession, directory: str, aliases: DataFrame | None = None, *, multi_line: bool = True) -> DataFrame:
    """Document graphs from JSON files, one a file (or one a line): (doc_id, title, head, relation, tail, article_number, dropped).

    Statements whose relation is not in the vocabulary are left out and their relations listed in
    ``dropped``; entities are canonical; nothing is deduplicated.
    """
    docs = spark.read.schema(DOCUMENT).option("multiLine", multi_line).option("pathGlobFilter", "*.json").json(directory)
    docs = docs.withColumn("title", F.coalesce("title", "doc_id"))
    rows = docs.select("doc_id", "title", F.inline_outer("triples")).withColumn("entry", normalize_relation(F.col("relation")))
    dropped = rows.where(F.col("entry").isNull() & F.col("relation").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_set("relation")).alias("dropped"))
    kept = rows.where(F.col("entry").isNotNull()).select("doc_id", "title", "head", F.col("entry").alias("relation"), "tail", F.coalesce("article_number", F.lit("")).alias("article_number"))
    return canonicalize(kept, ["head", "tail"], aliases).join(dropped, "doc_id", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<string>")))


def read_triples(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A triple store with its fixed schema; columns that the files lack are NULL."""
    if fmt != "csv":
        return conform(spark.read.format(fmt).load(path))
    head = spark.read.options(**CSV).csv(path).columns  # the header line only; no inference of types
    by_name = {f.name: f.dataType for f in TRIPLES}
    schema = T.StructType([T.StructField(c, by_name.get(c, T.StringType())) for c in head])
    return conform(spark.read.options(**CSV).schema(schema).csv(path))


def write_triples(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A triple store, in Parquet clustered by law so that lookups by law read few row groups."""
    w = df.sortWithinPartitions("law_id").write.mode(mode)
    w.parquet(path) if fmt == "parquet" else w.options(**CSV).format(fmt).save(path)


def write_store(triples: DataFrame, corpus: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A whole store, triples and corpus (law_id, law_text) beside each other, overwritten."""
    write_triples(triples, f"{path}/triples", fmt)
    w = corpus.select("law_id", "law_text").write.mode("overwrite")
    w.parquet(f"{path}/corpus") if fmt == "parquet" else w.options(**CSV).format(fmt).save(f"{path}/corpus")


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(law_id, law_text) of a whole store."""
    r = spark.read.schema("law_id string, law_text string")
    return r.parquet(f"{path}/corpus") if fmt == "parquet" else r.options(**CSV).format(fmt).load(f"{path}/corpus")


def write_reports(reports: DataFrame, path: str) -> None:
    """Similarity reports as nested JSON and flat CSV with three decimals."""
    rounded = reports.select(*(F.round(c, 3).alias(c) if t == "double" else F.col(c) for c, t in reports.dtypes))
    rounded.write.mode("overwrite").json(f"{path}/json")
    rounded.select(*(c for c, t in rounded.dtypes if not t.startswith("struct")), "axiom_violations.*").write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def upsert_chunks(new: DataFrame, existing: DataFrame | None, key: str = "chunk_id") -> DataFrame:
    """Chunks of a vector store that are not in it yet, each once."""
    fresh = new.dropDuplicates([key])
    return fresh if existing is None else fresh.join(existing.select(key).distinct(), key, "left_anti")


def append_chunks(new: DataFrame, path: str, key: str = "chunk_id") -> None:
    """Adds to a vector store, a folder of Parquet files, the chunks whose key it does not hold; the first vector of a key stays."""
    held = read_chunks(new.sparkSession, path)
    upsert_chunks(new, held, key).write.mode("append").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    """The chunks of a vector store, None where it has none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


# The sample law, with a header, articles of both kinds and citations.
SAMPLE_LAW = (
    "sample_law_1",
    "LEGE nr. 10 din 5 martie 2020\nprivind evidența actelor normative\nEMITENT\nPARLAMENTUL ROMÂNIEI\nPublicat în MONITORUL OFICIAL nr. 190 din 9 martie 2020\n\n"
    "Articolul 1\nPrezenta lege modifică Legea nr. 24/2000 și abrogă Hotărârea Guvernului nr. 1.226/2007.\n\n"
    "Articolul 2\nMinisterul Justiției este responsabil pentru aplicarea prezentei legi.\n\n"
    "Articolul 3\nLegea intră în vigoare la 30 de zile de la data publicării.",
)


def sample_law(spark: SparkSession) -> DataFrame:
    """(law_id, law_text): one fixed law."""
    return spark.createDataFrame([SAMPLE_LAW], "law_id string, law_text string")


def synthetic_laws(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """(law_id, law_text) of ``n`` invented laws out of four templates."""
    pick = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(4))
    no, year = F.col("id") + 1, 1990 + F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(35))
    other = F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(900)) + 1
    title = F.format_string("LEGE nr. %d din 1 ianuarie %d privind organizarea serviciilor publice", no, year)
    bodies = F.array(
        F.lit("Articolul 1\nPrezenta lege reglementează serviciile publice.\nArticolul 2\nLegea intră în vigoare la 30 de zile de la publicare."),
        F.format_string("Articolul 1\nSe modifică Legea nr. %d/%d.\nArticolul 2\nSe abrogă dispozițiile contrare.", other, year),
        F.format_string("Articol unic\nSe aprobă Ordonanța de urgență a Guvernului nr. %d/%d.", other, year),
        F.format_string("Articolul 1\nCapitolul I\nArticolul 2\nSe completează Hotărârea Guvernului nr. %d/%d.\nArticolul 3\nPrezenta lege se publică în Monitorul Oficial al României.", other, year),
    )
    return spark.range(n).select(F.format_string("lege_%d_%d", no, year).alias("law_id"), F.concat_ws("\n", title, F.get(bodies, pick.cast("int"))).alias("law_text"))
