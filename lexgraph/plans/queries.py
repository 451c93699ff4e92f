"""Queries of the engine over a data directory, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ASYMMETRIC, CROSS_REFERENCES, FUNCTIONAL, IRREFLEXIVE, MONTHS, RELATIONS, SCORE_WEIGHTS, SYMMETRIC, TAIL_DOMAIN, TRANSITIVE
from ..functions import text as tx
from ..operators import axioms, cite, extract, graph, report, resolve, score, segment, store, vector
from ..runtime import table
from . import references, storage, whole
from .pipeline import corpus_triples
from .views import ACT_LINES_SQL, KG_EVENTS_SQL, KG_LINEITEM_SQL, act_texts, kg_events, kg_lineitem

Query = Callable[[SparkSession, str], DataFrame]

USER, LAW, HOUR = "user_7", "day_2024-01-05", "10"
#: Tails that the event graph's issuing statements may have: the first fifty users.
ALLOWED = tuple(f"user_{i}" for i in range(50))
DOMAIN = {"emis_de": ALLOWED}


def _lit(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


KG = f"WITH kg AS ({KG_EVENTS_SQL})"


# ---- text -----------------------------------------------------------------------------------------------------------


def norm_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_meta").select("meta_id", tx.norm_key(F.concat(F.lit(" «"), F.col("titlu"), F.lit("» ;"))).alias("key"))


def ro_date(spark: SparkSession, d: str) -> DataFrame:
    months = F.array(*(F.lit(m) for m in MONTHS))
    o = table(spark, d, "orders")
    return o.select("o_orderkey", tx.ro_date(F.dayofmonth("o_orderdate").cast("string"), F.upper(F.get(months, F.month("o_orderdate") - 1)), F.year("o_orderdate").cast("string")).alias("iso"))


def header_meta(spark: SparkSession, d: str) -> DataFrame:
    """Headers composed of orders' columns and parsed again."""
    o = table(spark, d, "orders")
    months = F.array(*(F.lit(m) for m in MONTHS))
    date = F.concat_ws(" ", F.dayofmonth("o_orderdate").cast("string"), F.get(months, F.month("o_orderdate") - 1), F.year("o_orderdate").cast("string"))
    text = F.concat(
        F.lit("ORDONANȚĂ DE URGENȚĂ nr. "), F.col("o_orderkey").cast("string"), F.lit(" din "), date, F.lit("\n\nprivind clientul "), F.col("o_custkey").cast("string"),
        F.lit(" (*republicată*)\nEMITENT\nGUVERNUL ROMÂNIEI\nPublicat în MONITORUL OFICIAL nr. "), F.col("o_custkey").cast("string"), F.lit(" din "), date, F.lit("\n\nArticolul 1\nText"),
    )
    return o.select("o_orderkey", tx.header_meta(text).alias("m")).select("o_orderkey", "m.*")


def roman_to_int(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers written in Roman numerals and read again."""
    roman = F.array(*(F.lit(x) for x in ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XL", "XCIX", "MCMXCIV")))
    li = table(spark, d, "lineitem")
    return li.select(F.get(roman, F.col("l_linenumber") - 1).alias("label")).groupBy("label").agg(F.count("*").alias("n")).select("label", tx.roman_to_int(F.col("label")).alias("value"), "n")


def relation_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Event types renamed to synonyms, capitals and an unknown word, then normalised."""
    raw = {"click": " Modificată ", "view": "colaborează cu", "purchase": "EMISĂ DE", "error": "abrogă", "signup": "guverneaza"}
    named = F.create_map(*(F.lit(x) for k, v in raw.items() for x in (k, v)))
    e = table(spark, d, "events").select(tx.normalize_relation(F.try_element_at(named, F.col("event_type"))).alias("relation"))
    return e.groupBy("relation").agg(F.count("*").alias("n"))


def segment_articles(spark: SparkSession, d: str) -> DataFrame:
    a = segment.split_into_articles(act_texts(spark, d))
    return a.select("law_id", "article_number", F.col("text").alias("body"))


#: Shapes of acts: headers in one line each, bodies b1, b2, …; N stands for the act's number.
SHAPES = (
    ("Art. I\nb1 N\nArt. 5\nb2\nArt. II\nb3\nART. III\nb4", (("I", "b1 N\nArt. 5\nb2"), ("II", "b3"), ("III", "b4"))),
    ("Art. 1\nb1 N\nArt. 2\nb2\nArt. 14^2\nb3\nArt. 3\nb4\nArt. 3^1\nb5\nArt. 4\nb6", (("1", "b1 N"), ("2", "b2\nArt. 14^2\nb3"), ("3", "b4\nArt. 3^1\nb5"), ("4", "b6"))),
    ("Un preambul care are mai mult de patruzeci de caractere, N.\nArticol unic\nb1\nArt. 7\nb2", (("preambul", "Un preambul care are mai mult de patruzeci de caractere, N."), ("unic", "b1\nArt. 7\nb2"))),
    ("Un text N fără articole.", (("full", "Un text N fără articole."),)),
    ("Scurt.\nArt. IV - N\nArt. 12\n\nArticolul 13\nb1", (("13", "b1"),)),
)


def segment_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Acts of every shape: the prevailing numerals, the longest rising run of headers, the single article, the preamble, empty bodies."""
    shapes = F.array(*(F.lit(t) for t, _ in SHAPES))
    o = table(spark, d, "orders").select("o_orderkey", F.replace(F.get(shapes, F.pmod("o_orderkey", F.lit(len(SHAPES))).cast("int")), F.lit("N"), F.col("o_orderkey").cast("string")).alias("law_text"))
    return segment.split_into_articles(o).select("o_orderkey", "article_number", F.col("text").alias("body"))


def cite_scan(spark: SparkSession, d: str) -> DataFrame:
    a = segment.split_into_articles(act_texts(spark, d))
    c = cite.cited(a.select("law_id", "article_number", "text"), "text")
    return c.select("law_id", "article_number", "surface", "relation")


def cite_compound(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with two joined verbs give both relations."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Se propune modificarea și completarea O.U.G. nr. "), F.col("o_orderkey").cast("string"), F.lit("/2001, cu avizul comisiei.")).alias("t"))
    return cite.cited(o, "t").groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("surface").alias("n_acts"))


#: Nine written forms of citations, short ones with and without their dots and blanks; N stands for the number.
FORMS = ("Legea nr. N/2001", "Legii-cadru nr.N/2001", "Ordonanța de urgență a Guvernului nr. N/2001", "OUG nr. N/2001", "O.U.G.nr. N/2001", "Ordonanței Guvernului nr N/2001", "OG nr. N/2001", "Hotărârii nr. N/2001", "HG nr. N/2001")


def cite_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every written form of a citation, of every order."""
    o = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(*(F.lit(f) for f in FORMS))).alias("form"))
    text = F.concat(F.lit("Se abrogă "), F.replace("form", F.lit("N"), F.col("o_orderkey").cast("string")), F.lit(", cu avizul comisiei."))
    return cite.cited(o.select("o_orderkey", text.alias("t")), "t")


def cite_trigger(spark: SparkSession, d: str) -> DataFrame:
    """The nearest verb decides, on either side; without one the relation is a plain reference."""
    verbs = F.array(F.lit("Se abrogă "), F.lit("Potrivit "), F.lit("Se aprobă și se respectă "))
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.get(verbs, F.pmod("o_orderkey", F.lit(3)).cast("int")), F.lit("Legea nr. "), F.col("o_custkey").cast("string"), F.lit("/1999 în cazuri date.")).alias("t"))
    return cite.cited(o, "t").select("o_orderkey", "relation", "surface")


def cite_self_filter(spark: SparkSession, d: str) -> DataFrame:
    """Acts citing themselves and a number that ends in theirs."""
    o = table(spark, d, "orders").where(F.col("o_orderkey") > 0)
    own = F.concat(F.lit("lege_"), F.col("o_orderkey").cast("string"), F.lit("_2001"))
    t = F.concat(F.lit("Legea nr. "), F.col("o_orderkey").cast("string"), F.lit("/2001 și Legea nr. 1"), F.col("o_orderkey").cast("string"), F.lit("/2001"))
    c = cite.cited(o.select(own.alias("law_id"), t.alias("t")), "t")
    return c.where(~cite.is_self(F.col("law_id"), F.col("surface"))).select("law_id", "surface")


# ---- resolution -----------------------------------------------------------------------------------------------------


def law_id_synthesize(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Hotărârea Guvernului nr. 1."), F.lpad(F.pmod("o_orderkey", F.lit(1000)).cast("string"), 3, "0"), F.lit("/2006")).alias("c"))
    return resolve.resolve(o, "c", None).select("o_orderkey", F.col("resolved").alias("law_id"))


def law_id_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Every registered act cited by its type, number and year is found again."""
    meta = table(spark, d, "law_meta").where(F.col("tip_act").isNotNull() & F.col("numar").isNotNull() & F.col("an").isNotNull())
    cited = meta.select("meta_id", F.concat_ws("", F.col("tip_act"), F.lit(" nr. "), F.col("numar"), F.lit("/"), F.col("an")).alias("c"))
    return resolve.resolve(cited, "c", resolve.alias_dim(meta)).select("meta_id", F.col("resolved").alias("law_id"))


def canonicalize(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as heads stay, citations as tails become identifiers."""
    li = table(spark, d, "lineitem").select("l_linenumber", F.concat(F.lit(" «supp_"), F.col("l_suppkey").cast("string"), F.lit("», ")).alias("head"), F.concat(F.lit("LEGEA   nr."), F.col("l_linenumber").cast("string"), F.lit("/2003 ")).alias("tail"))
    c = resolve.canonicalize(li, ["head", "tail"], None)
    return c.groupBy("head", "tail").agg(F.count("*").alias("n"))


def anaphora(spark: SparkSession, d: str) -> DataFrame:
    e = kg_events(spark, d).withColumn("head", F.when(F.col("source_method") == "llm", "prezenta lege").otherwise("Legea nr. 5/2001")).withColumn("tail", F.lit("codul"))
    return resolve.resolve_anaphora(e, F.col("law_id")).groupBy("law_id", "head", "tail").agg(F.count("*").alias("n"))


def parse_response(spark: SparkSession, d: str) -> DataFrame:
    """Events written as response lines between junk lines, and parsed again."""
    e = kg_events(spark, d).select("seq", F.concat_ws("\n", F.lit("Triplete:"), F.concat(F.lit("["), F.col("head"), F.lit(" | "), F.col("relation"), F.lit(" | "), F.col("tail"), F.lit("]")), F.lit("[a | guverneaza | b]"), F.lit("fără paranteze"), F.lit("['x', emis, y, z]")).alias("response"))
    return extract.parse_responses(e).select("seq", "head", "relation", "tail", "source_method", "confidence")


# ---- store ----------------------------------------------------------------------------------------------------------


def src_union_schema(spark: SparkSession, d: str) -> DataFrame:
    """Two triple sets with different columns as one."""
    e = kg_events(spark, d)
    return store.merge(e.drop("confidence"), kg_lineitem(spark, d)).groupBy("source_method").agg(F.count("*").alias("n"), F.count("confidence").alias("n_confident"))


def merge_best_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = kg_events(spark, d).withColumn("law_id", F.lit("all")).withColumn("article_number", F.lit(None).cast("string"))
    return store.best_confidence(e)


def kb_dedup(spark: SparkSession, d: str) -> DataFrame:
    li = kg_lineitem(spark, d)
    return store.add_triples(li, li)


def kb_by_entity(spark: SparkSession, d: str) -> DataFrame:
    return store.by_entity(kg_events(spark, d), USER)


def kb_by_relation(spark: SparkSession, d: str) -> DataFrame:
    return store.by_relation(kg_events(spark, d), "abroga")


def kb_by_law(spark: SparkSession, d: str) -> DataFrame:
    return store.by_law(kg_events(spark, d), LAW)


def kb_by_article(spark: SparkSession, d: str) -> DataFrame:
    return store.by_article(kg_events(spark, d), LAW, HOUR)


def kb_modified_by(spark: SparkSession, d: str) -> DataFrame:
    return store.laws_modified_by(kg_events(spark, d), USER)


def kb_modifying(spark: SparkSession, d: str) -> DataFrame:
    return store.laws_modifying(kg_events(spark, d), USER)


def kb_emitter(spark: SparkSession, d: str) -> DataFrame:
    return store.law_emitter(kg_events(spark, d), USER, "seq")


def kb_entity_relations(spark: SparkSession, d: str) -> DataFrame:
    return store.entity_relations(kg_events(spark, d), USER)


def kb_statistics(spark: SparkSession, d: str) -> DataFrame:
    return store.statistics(kg_events(spark, d), table(spark, d, "legislative_corpus"))


def kb_relation_histogram(spark: SparkSession, d: str) -> DataFrame:
    return store.relation_histogram(kg_events(spark, d))


def kb_triple_sources(spark: SparkSession, d: str) -> DataFrame:
    return store.triple_sources(kg_lineitem(spark, d), "supp_1", "livrează", "part_1")


def kb_triples_with_sources(spark: SparkSession, d: str) -> DataFrame:
    s = store.triples_with_sources(kg_lineitem(spark, d))
    return s.groupBy("head", "relation", "tail").agg(F.sum("times").alias("n_sources"), F.count("*").alias("n_distinct_sources"))


# ---- graph ----------------------------------------------------------------------------------------------------------


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(kg_events(spark, d))


def graph_law_annotation(spark: SparkSession, d: str) -> DataFrame:
    """Acts of the triples as nodes, by what is known of them."""
    t = table(spark, d, "legislative_triples").select(F.col("law_id").alias("id")).where(F.col("id").isNotNull()).distinct()
    return graph.annotate_laws(t, table(spark, d, "law_meta")).select("id", "node_type", "external")


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(kg_events(spark, d))


def graph_density(spark: SparkSession, d: str) -> DataFrame:
    return graph.density(kg_events(spark, d))


def graph_reciprocity(spark: SparkSession, d: str) -> DataFrame:
    return graph.reciprocity(kg_events(spark, d))


def graph_degree_histogram(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_histogram(kg_events(spark, d))


def graph_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample of the reference's picture: the edges among the first fifty nodes."""
    return graph.sample_subgraph(kg_events(spark, d), "seq", 50).select("head", "relation", "tail", "seq")


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of suppliers and parts: sizes."""
    c = graph.components(kg_lineitem(spark, d))
    return c.groupBy("component").agg(F.count("*").alias("n_nodes"))


# ---- axioms ---------------------------------------------------------------------------------------------------------


def ax_functional(spark: SparkSession, d: str) -> DataFrame:
    return axioms.functional(kg_events(spark, d))


def ax_asymmetric(spark: SparkSession, d: str) -> DataFrame:
    return axioms.asymmetric(kg_events(spark, d))


def ax_irreflexive(spark: SparkSession, d: str) -> DataFrame:
    return axioms.irreflexive(kg_events(spark, d)).select("seq", "head", "relation", "law_id", "article_number", axioms.provenance().alias("provenance"))


def ax_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return axioms.symmetric(kg_events(spark, d))


def ax_domain(spark: SparkSession, d: str) -> DataFrame:
    return axioms.tail_domain(kg_events(spark, d), DOMAIN).select("seq", "head", "relation", "tail")


def ax_transitive_2hop(spark: SparkSession, d: str) -> DataFrame:
    return axioms.two_hops(kg_events(spark, d))


def ax_transitive_count(spark: SparkSession, d: str) -> DataFrame:
    return axioms.two_hop_count(kg_events(spark, d))


def ax_counts(spark: SparkSession, d: str) -> DataFrame:
    return axioms.violation_counts(kg_events(spark, d), (), DOMAIN, [r for r in RELATIONS if r != "completează"])


def ax_all(spark: SparkSession, d: str) -> DataFrame:
    """Violations per axiom and relation."""
    return axioms.violations_by_axiom(kg_events(spark, d))


# ---- similarity -----------------------------------------------------------------------------------------------------


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events of nine residues of the head as documents, the tenth as ontology."""
    e = kg_events(spark, d).withColumn("r", F.pmod(F.substring("head", F.lit(6), F.length("head")).cast("int"), F.lit(10)))
    docs = e.where("r > 0").withColumn("doc_id", F.concat(F.lit("doc_"), F.col("r").cast("string")))
    return docs, e.where("r = 0")


def sim_relation_jaccard(spark: SparkSession, d: str) -> DataFrame:
    docs, onto = _split(spark, d)
    return score.relation_jaccard(docs.where((F.col("r") % 2 == 0) | (F.col("relation") != "abroga")), onto)


def sim_relation_cosine(spark: SparkSession, d: str) -> DataFrame:
    c = score.relation_cosine(*_split(spark, d))
    return c.select("doc_id", F.round("relation_distribution_cosine", 9).alias("relation_distribution_cosine"))


def sim_node_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return score.node_jaccard(*_split(spark, d))


def sim_triple_jaccard(spark: SparkSession, d: str) -> DataFrame:
    docs, onto = _split(spark, d)
    # without their heads the two sides have statements in common
    return score.triple_jaccard(docs.withColumn("head", F.lit("x")), onto.withColumn("head", F.lit("x")))


def sim_compliance(spark: SparkSession, d: str) -> DataFrame:
    docs, onto = _split(spark, d)
    c = score.compliance(docs, onto, domains=DOMAIN)
    return c.select("doc_id", "n_triples", "axiom_violations.total", F.round("axiom_conformance", 9).alias("axiom_conformance"), F.round("compliance_score", 6).alias("compliance_score"))


def sim_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with relations outside the vocabulary compared with a store."""
    docs, onto = _split(spark, d)
    docs = docs.withColumn("dropped", F.when(F.col("r") % 2 == 0, F.array(F.lit("distruge"))).otherwise(F.array().cast("array<string>")))
    c = score.compare_documents(docs, onto.select("head", "relation", "tail"))
    return c.select("doc_id", "n_dropped", "n_triples", *(F.round(x, 9).alias(x) for x in ("relation_jaccard", "relation_distribution_cosine", "node_jaccard", "triple_jaccard", "axiom_conformance")), F.round("compliance_score", 6).alias("compliance_score"), "axiom_violations.*")


# ---- reports --------------------------------------------------------------------------------------------------------


def eda_basic(spark: SparkSession, d: str) -> DataFrame:
    return report.basic(store.conform(table(spark, d, "legislative_triples")))


def eda_top_relations(spark: SparkSession, d: str) -> DataFrame:
    return report.top_values(table(spark, d, "legislative_triples"), "relation", 10)


def eda_top_entities(spark: SparkSession, d: str) -> DataFrame:
    return report.top_values(table(spark, d, "legislative_triples"), "head", 5)


def val_vocab_coverage(spark: SparkSession, d: str) -> DataFrame:
    return report.vocabulary_coverage(table(spark, d, "legislative_triples"))


def val_per_law(spark: SparkSession, d: str) -> DataFrame:
    return report.per_law(table(spark, d, "legislative_triples"))


def val_method_share(spark: SparkSession, d: str) -> DataFrame:
    m = report.method_share(table(spark, d, "legislative_triples"))
    return m.select("source_method", "n", F.round("pct", 9).alias("pct"))


def val_spotcheck(spark: SparkSession, d: str) -> DataFrame:
    s = report.spot_check(kg_events(spark, d), [LAW, "day_2024-01-06"])
    return s.select("law_id", "n_triples", "n_relations", "n_cross_references", F.size("sample").alias("n_sample"), F.array_join("cross_references", "; ").alias("cross_references"))


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest vectors of every hundredth one."""
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % 100 == 0)
    return vector.nearest(e, "vec_id", "embedding", q.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q")), "q_id", "q", 3).select("q_id", "rank", F.col("id").alias("vec_id"))


def pipeline_triples(spark: SparkSession, d: str) -> DataFrame:
    """Laws to triples, whole corpus: statements per relation."""
    t = corpus_triples(table(spark, d, "legislative_corpus").select("law_id", "law_text"), table(spark, d, "law_meta"))
    return t.groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("tail").alias("n_tails"))


def pipeline_acts(spark: SparkSession, d: str) -> DataFrame:
    """Acts composed of line items, one article a line, each citing an act: every triple of the pipeline."""
    return corpus_triples(act_texts(spark, d), table(spark, d, "law_meta").limit(0))


def pipeline_limited(spark: SparkSession, d: str) -> DataFrame:
    """The first two articles of the first ten such acts."""
    return corpus_triples(act_texts(spark, d), table(spark, d, "law_meta").limit(0), max_laws=10, max_articles=2).select("law_id", "article_number", "tail")


_ALL: tuple[Query, ...] = (
    norm_key, ro_date, header_meta, roman_to_int, relation_normalize, segment_articles, segment_shapes, cite_scan, cite_forms, cite_compound, cite_trigger, cite_self_filter,
    law_id_synthesize, law_id_resolve, canonicalize, anaphora, parse_response, src_union_schema, merge_best_confidence, kb_dedup, kb_by_entity, kb_by_relation, kb_by_law,
    kb_by_article, kb_modified_by, kb_modifying, kb_emitter, kb_entity_relations, kb_statistics, kb_relation_histogram, kb_triple_sources, kb_triples_with_sources, graph_nodes,
    graph_law_annotation, graph_degrees, graph_density, graph_reciprocity, graph_degree_histogram, graph_sample, graph_components, ax_functional, ax_asymmetric, ax_irreflexive,
    ax_symmetric, ax_domain, ax_transitive_2hop, ax_transitive_count, ax_counts, ax_all, sim_relation_jaccard, sim_relation_cosine, sim_node_jaccard, sim_triple_jaccard,
    sim_compliance, sim_documents, eda_basic, eda_top_relations, eda_top_entities, val_vocab_coverage, val_per_law, val_method_share, val_spotcheck, knn_topk, pipeline_triples, pipeline_acts, pipeline_limited,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (*_ALL, *whole.ALL, *storage.ALL)} | {"p5_found": references.p5_found, "p5_report": references.p5_report}


def _date(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d')"


def _pairs(relations, where: str = "head <> tail", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"SELECT {k}relation, least(head, tail) AS a, greatest(head, tail) AS b FROM kg WHERE relation IN {_lit(relations)} AND {where} GROUP BY {k}relation, least(head, tail), greatest(head, tail) HAVING bool_or(head <= tail) AND bool_or(head >= tail)"


_SPLIT = f"{KG}, e AS (SELECT *, CAST(substr(head, 6) AS INTEGER) % 10 AS r FROM kg), docs AS (SELECT *, 'doc_' || r AS doc_id FROM e WHERE r > 0), onto AS (SELECT * FROM e WHERE r = 0)"
_COUNTS = f"""
SELECT (SELECT count(*) FROM (SELECT head, relation FROM kg WHERE relation IN {_lit(FUNCTIONAL)} GROUP BY 1, 2 HAVING count(DISTINCT tail) > 1)) AS functional,
       (SELECT count(*) FROM ({_pairs(ASYMMETRIC)})) AS "asymmetric",
       (SELECT count(*) FROM kg WHERE relation IN {_lit(IRREFLEXIVE)} AND head = tail) AS irreflexive,
       (SELECT count(*) FROM kg WHERE relation = 'emis_de' AND tail NOT IN {_lit(ALLOWED)}) AS domain,
       (SELECT count(*) FROM kg WHERE relation NOT IN {_lit([r for r in RELATIONS if r != "completează"])}) AS vocabulary,
       (SELECT count(*) FROM kg) AS n_triples
"""


def _jaccard_sql(cols: str, docs: str, onto: str, out: str) -> str:
    return f"""{_SPLIT}, a AS (SELECT DISTINCT doc_id, {cols} FROM {docs}), b AS (SELECT DISTINCT {cols} FROM {onto}), ids AS (SELECT DISTINCT doc_id FROM docs)
SELECT ids.doc_id, (SELECT count(*) FROM a JOIN b USING ({cols}) WHERE a.doc_id = ids.doc_id)::DOUBLE
       / ((SELECT count(*) FROM a WHERE a.doc_id = ids.doc_id) + (SELECT count(*) FROM b) - (SELECT count(*) FROM a JOIN b USING ({cols}) WHERE a.doc_id = ids.doc_id)) AS {out} FROM ids"""


def _compliance_sql(domains) -> str:
    """Every part of the similarity report of each document."""
    bad = " OR ".join(f"relation = '{r}' AND tail NOT IN {_lit(v)}" for r, v in domains.items())

    def jaccard(n: str, cols: str, a: str, b: str) -> str:
        return f"{n}_a AS (SELECT DISTINCT doc_id, {cols} FROM {a}), {n}_b AS (SELECT DISTINCT {cols} FROM {b}), {n}_j AS (SELECT doc_id, count(*) FILTER (hit)::DOUBLE / (count(*) + (SELECT count(*) FROM {n}_b) - count(*) FILTER (hit)) AS {n}_jaccard FROM (SELECT {n}_a.*, h.hit IS NOT NULL AS hit FROM {n}_a LEFT JOIN (SELECT *, true AS hit FROM {n}_b) h USING ({cols})) GROUP BY 1)"

    return f"""{_SPLIT}, {jaccard('relation', 'relation', 'docs', 'onto')}, {jaccard('node', 'node', _ENDS_D, _ENDS_O)}, {jaccard('triple', 'head, relation, tail', 'docs', 'onto')},
x AS (SELECT doc_id, relation, count(*) AS x FROM docs GROUP BY 1, 2), y AS (SELECT relation, count(*) AS y FROM onto GROUP BY 1),
cosine AS (SELECT doc_id, sum(x * coalesce(y, 0))::DOUBLE / (sqrt(sum(x * x)) * (SELECT sqrt(sum(y * y)) FROM y)) AS relation_distribution_cosine FROM x LEFT JOIN y USING (relation) GROUP BY 1),
rws AS (SELECT doc_id, count(*) AS n_triples, count(*) FILTER (relation IN {_lit(IRREFLEXIVE)} AND head = tail) AS irreflexive, count(*) FILTER ({bad}) AS domain, count(*) FILTER (relation NOT IN {_lit(RELATIONS)}) AS vocabulary FROM docs GROUP BY 1),
fun AS (SELECT doc_id, count(*) AS functional FROM (SELECT doc_id, head, relation FROM docs WHERE relation IN {_lit(FUNCTIONAL)} GROUP BY 1, 2, 3 HAVING count(DISTINCT tail) > 1) GROUP BY 1),
asy AS (SELECT doc_id, count(*) AS "asymmetric" FROM (SELECT doc_id FROM docs WHERE relation IN {_lit(ASYMMETRIC)} AND head <> tail GROUP BY doc_id, relation, least(head, tail), greatest(head, tail) HAVING bool_or(head < tail) AND bool_or(head > tail)) GROUP BY 1),
v AS (SELECT doc_id, n_triples, irreflexive, domain, vocabulary, coalesce(functional, 0) AS functional, coalesce("asymmetric", 0) AS "asymmetric", irreflexive + domain + vocabulary + coalesce(functional, 0) + coalesce("asymmetric", 0) AS total FROM rws LEFT JOIN fun USING (doc_id) LEFT JOIN asy USING (doc_id)),
r AS (SELECT *, greatest(0.0::DOUBLE, 1 - total::DOUBLE / n_triples) AS axiom_conformance FROM v JOIN relation_j USING (doc_id) JOIN node_j USING (doc_id) JOIN triple_j USING (doc_id) JOIN cosine USING (doc_id)),
report AS (SELECT *, {' + '.join(f'{k} * {w}::DOUBLE' for k, w in SCORE_WEIGHTS.items())} AS compliance_score FROM r)"""


_ENDS_D = "(SELECT doc_id, head AS node FROM docs UNION SELECT doc_id, tail FROM docs)"
_ENDS_O = "(SELECT head AS node FROM onto UNION SELECT tail FROM onto)"


def oracle_sql() -> dict[str, str]:
    months = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"
    known = f"relation IN {_lit(RELATIONS)}"
    laws = f"('{LAW}', 'day_2024-01-06')"
    return {
        "norm_key": "SELECT meta_id, lower(strip_accents(titlu)) AS key FROM law_meta",
        "ro_date": f"SELECT o_orderkey, {_date('o_orderdate')} AS iso FROM orders",
        "header_meta": f"SELECT o_orderkey, 'Ordonanță de urgență' AS tip_act, o_orderkey::VARCHAR AS numar, year(o_orderdate)::VARCHAR AS an, 'privind clientul ' || o_custkey AS titlu, 'GUVERNUL ROMÂNIEI' AS emitent, {_date('o_orderdate')} AS data_act, {_date('o_orderdate')} AS data_publicare, o_custkey::VARCHAR AS monitorul_oficial_nr FROM orders",
        "roman_to_int": "SELECT ['I','II','III','IV','V','VI','VII'][l_linenumber] AS label, l_linenumber::INTEGER AS value, count(*) AS n FROM lineitem GROUP BY l_linenumber",
        "relation_normalize": "SELECT CASE event_type WHEN 'click' THEN 'modifică' WHEN 'view' THEN 'colaborează_cu' WHEN 'purchase' THEN 'emis_de' WHEN 'error' THEN 'abroga' END AS relation, count(*) AS n FROM events GROUP BY 1",
        "segment_articles": f"SELECT 'order_' || l_orderkey AS law_id, l_linenumber::VARCHAR AS article_number, 'Se modifică Legea nr. ' || part || '/' || y AS body FROM ({ACT_LINES_SQL})",
        "cite_scan": f"SELECT 'order_' || l_orderkey AS law_id, l_linenumber::VARCHAR AS article_number, 'Legea nr. ' || part || '/' || y AS surface, 'modifică' AS relation FROM ({ACT_LINES_SQL})",
        "cite_compound": "SELECT r AS relation, count(*) AS n, count(DISTINCT o_orderkey) AS n_acts FROM orders CROSS JOIN (VALUES ('modifică'), ('completează')) v(r) GROUP BY r",
        "cite_trigger": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'abroga' WHEN 1 THEN 'face_referire_la' ELSE 'aprobă' END AS relation, 'Legea nr. ' || o_custkey || '/1999' AS surface FROM orders",
        "cite_self_filter": "SELECT 'lege_' || o_orderkey || '_2001' AS law_id, 'Legea nr. 1' || o_orderkey || '/2001' AS surface FROM orders WHERE o_orderkey > 0",
        "law_id_synthesize": "SELECT o_orderkey, 'hg_1' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || '_2006' AS law_id FROM orders",
        "law_id_resolve": "SELECT meta_id, CASE tip_act WHEN 'Lege' THEN 'lege' WHEN 'Hotărâre de guvern' THEN 'hg' WHEN 'Ordonanță de urgență' THEN 'oug' WHEN 'Ordonanță' THEN 'og' END || '_' || numar || '_' || an AS law_id FROM law_meta WHERE tip_act IS NOT NULL AND numar IS NOT NULL AND an IS NOT NULL",
        "canonicalize": "SELECT 'supp_' || l_suppkey AS head, 'lege_' || l_linenumber || '_2003' AS tail, count(*) AS n FROM lineitem GROUP BY 1, 2",
        "anaphora": f"{KG} SELECT law_id, CASE WHEN source_method = 'llm' THEN law_id ELSE 'Legea nr. 5/2001' END AS head, law_id AS tail, count(*) AS n FROM kg GROUP BY 1, 2, 3",
        "parse_response": f"{KG} SELECT seq, head, relation, tail, 'llm' AS source_method, 0.7::DOUBLE AS confidence FROM kg WHERE relation IS NOT NULL UNION ALL SELECT seq, 'x', 'emis_de', 'y, z', 'llm', 0.7 FROM kg",
        "src_union_schema": f"WITH kg AS ({KG_EVENTS_SQL}), li AS ({KG_LINEITEM_SQL}) SELECT source_method, count(*) AS n, count(confidence) AS n_confident FROM (SELECT source_method, NULL::DOUBLE AS confidence FROM kg UNION ALL SELECT source_method, confidence FROM li) GROUP BY 1",
        "merge_best_confidence": f"{KG} SELECT head, relation, tail, 'all' AS law_id, NULL::VARCHAR AS article_number, CASE WHEN max(confidence) = 1 THEN 'regex' ELSE 'llm' END AS source_method, max(confidence) AS confidence FROM kg GROUP BY 1, 2, 3",
        "kb_dedup": f"SELECT DISTINCT * FROM ({KG_LINEITEM_SQL})",
        "kb_by_entity": f"{KG} SELECT * FROM kg WHERE head = '{USER}' OR tail = '{USER}'",
        "kb_by_relation": f"{KG} SELECT * FROM kg WHERE relation = 'abroga'",
        "kb_by_law": f"{KG} SELECT * FROM kg WHERE law_id = '{LAW}'",
        "kb_by_article": f"{KG} SELECT * FROM kg WHERE law_id = '{LAW}' AND article_number = '{HOUR}'",
        "kb_modified_by": f"{KG} SELECT tail FROM kg WHERE relation = 'modifică' AND head = '{USER}'",
        "kb_modifying": f"{KG} SELECT head FROM kg WHERE relation = 'modifică' AND tail = '{USER}'",
        "kb_emitter": f"{KG} SELECT arg_min(tail, seq) AS emitter FROM kg WHERE relation = 'emis_de' AND head = '{USER}'",
        "kb_entity_relations": f"{KG} SELECT 'out' AS direction, relation, tail AS other FROM kg WHERE head = '{USER}' UNION ALL SELECT 'in', relation, head FROM kg WHERE tail = '{USER}'",
        "kb_statistics": f"{KG} SELECT (SELECT count(*) FROM kg) AS total_triples, (SELECT count(*) FROM (SELECT head FROM kg UNION SELECT tail FROM kg)) AS unique_entities, (SELECT count(DISTINCT relation) FROM kg) AS unique_relations, (SELECT count(*) FROM legislative_corpus) AS corpus_size",
        "kb_relation_histogram": f"{KG} SELECT relation, count(*) AS n FROM kg GROUP BY 1",
        "kb_triple_sources": f"WITH li AS ({KG_LINEITEM_SQL}) SELECT law_id, article_number, source_method, confidence FROM li WHERE head = 'supp_1' AND tail = 'part_1'",
        "kb_triples_with_sources": f"WITH li AS ({KG_LINEITEM_SQL}) SELECT head, relation, tail, count(*) AS n_sources, count(DISTINCT law_id || '|' || article_number || '|' || source_method) AS n_distinct_sources FROM li GROUP BY 1, 2, 3",
        "graph_nodes": f"{KG} SELECT head AS id FROM kg UNION SELECT tail FROM kg",
        "graph_law_annotation": "SELECT DISTINCT t.law_id AS id, 'law' AS node_type, CASE WHEN m.law_id IS NULL THEN true END AS external FROM legislative_triples t LEFT JOIN (SELECT DISTINCT law_id FROM law_meta) m ON t.law_id = m.law_id WHERE t.law_id IS NOT NULL",
        "graph_degrees": f"{KG} SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, sum(i + o)::BIGINT AS degree FROM (SELECT head AS id, 0 AS i, 1 AS o FROM kg UNION ALL SELECT tail, 1, 0 FROM kg) GROUP BY 1",
        "graph_density": f"{KG}, n AS (SELECT count(*) AS n FROM (SELECT head FROM kg UNION SELECT tail FROM kg)) SELECT n AS n_nodes, (SELECT count(*) FROM kg) AS n_edges, (SELECT count(*) FROM kg)::DOUBLE / (n * (n - 1)) AS density FROM n",
        "graph_reciprocity": f"{KG} SELECT 2 * sum(least(f, b))::DOUBLE / (SELECT count(*) FROM kg) AS reciprocity FROM (SELECT count(*) FILTER (head < tail) AS f, count(*) FILTER (head > tail) AS b FROM kg GROUP BY least(head, tail), greatest(head, tail))",
        "graph_degree_histogram": f"{KG}, g AS (SELECT id, count(*) AS d FROM (SELECT head AS id FROM kg UNION ALL SELECT tail FROM kg) GROUP BY 1), s AS (SELECT min(d) AS lo, max(d) AS hi FROM g) SELECT CASE WHEN hi = lo THEN 0 ELSE least(49, CAST(floor((d - lo) * 50 / (hi - lo)) AS INTEGER)) END::INTEGER AS bin, count(*) AS n_nodes FROM g, s GROUP BY 1",
        "graph_sample": f"{KG}, f AS (SELECT id, min(place) AS place FROM (SELECT head AS id, seq * 2 AS place FROM kg UNION ALL SELECT tail, seq * 2 + 1 FROM kg) GROUP BY 1), p AS (SELECT id FROM f ORDER BY place, id LIMIT 50) SELECT head, relation, tail, seq FROM kg WHERE head IN (SELECT id FROM p) AND tail IN (SELECT id FROM p)",
        "ax_functional": f"{KG} SELECT head, relation, count(DISTINCT tail) AS n_tails FROM kg WHERE relation IN {_lit(FUNCTIONAL)} GROUP BY 1, 2 HAVING count(DISTINCT tail) > 1",
        "ax_asymmetric": f"{KG} {_pairs(ASYMMETRIC, 'true')}",
        "ax_irreflexive": f"{KG} SELECT seq, head, relation, law_id, article_number, ' (' || law_id || ' / art ' || article_number || ')' AS provenance FROM kg WHERE relation IN {_lit(IRREFLEXIVE)} AND head = tail",
        "ax_symmetric": f"{KG} SELECT DISTINCT head, relation, tail FROM kg k WHERE relation IN {_lit(SYMMETRIC)} AND head <> tail AND NOT EXISTS (SELECT 1 FROM kg r WHERE r.relation = k.relation AND r.head = k.tail AND r.tail = k.head)",
        "ax_domain": f"{KG} SELECT seq, head, relation, tail FROM kg WHERE relation = 'emis_de' AND tail NOT IN {_lit(ALLOWED)}",
        "ax_transitive_2hop": f"{KG} SELECT l.relation, l.head AS a, l.tail AS b, r.tail AS c, count(*) AS n_paths FROM kg l JOIN kg r ON l.tail = r.head AND l.relation = r.relation WHERE l.relation IN {_lit(TRANSITIVE)} GROUP BY 1, 2, 3, 4",
        "ax_transitive_count": f"{KG} SELECT l.relation, count(*) AS n_paths FROM kg l JOIN kg r ON l.tail = r.head AND l.relation = r.relation WHERE l.relation IN {_lit(TRANSITIVE)} GROUP BY 1",
        "ax_counts": f"{KG} SELECT *, functional + \"asymmetric\" + irreflexive + domain + vocabulary AS total FROM ({_COUNTS})",
        "sim_relation_jaccard": _jaccard_sql("relation", "(SELECT * FROM docs WHERE r % 2 = 0 OR relation <> 'abroga')", "onto", "relation_jaccard"),
        "sim_relation_cosine": f"{_SPLIT}, x AS (SELECT doc_id, relation, count(*) AS x FROM docs GROUP BY 1, 2), y AS (SELECT relation, count(*) AS y FROM onto GROUP BY 1) SELECT doc_id, round(sum(x * coalesce(y, 0))::DOUBLE / (sqrt(sum(x * x)) * (SELECT sqrt(sum(y * y)) FROM y)), 9) AS relation_distribution_cosine FROM x LEFT JOIN y USING (relation) GROUP BY 1",
        "sim_node_jaccard": _jaccard_sql("node", _ENDS_D, _ENDS_O, "node_jaccard"),
        "sim_triple_jaccard": _jaccard_sql("relation, tail", "docs", "onto", "triple_jaccard"),
        "sim_compliance": f"{_compliance_sql(DOMAIN)} SELECT doc_id, n_triples, total, round(axiom_conformance, 9) AS axiom_conformance, round(compliance_score, 6) AS compliance_score FROM report",
        "sim_documents": f"{_compliance_sql(TAIL_DOMAIN)} SELECT doc_id, CASE WHEN right(doc_id, 1)::INTEGER % 2 = 0 THEN 1 ELSE 0 END AS n_dropped, n_triples, round(relation_jaccard, 9) AS relation_jaccard, round(relation_distribution_cosine, 9) AS relation_distribution_cosine, round(node_jaccard, 9) AS node_jaccard, round(triple_jaccard, 9) AS triple_jaccard, round(axiom_conformance, 9) AS axiom_conformance, round(compliance_score, 6) AS compliance_score, functional, \"asymmetric\", irreflexive, domain, vocabulary, total FROM report",
        "eda_basic": "SELECT count(*) AS n_rows, count(DISTINCT head) AS n_heads, count(DISTINCT tail) AS n_tails, count(DISTINCT relation) AS n_relations, (sum((head IS NULL)::INT + (relation IS NULL)::INT + (tail IS NULL)::INT + (law_id IS NULL)::INT + (article_number IS NULL)::INT + (source_method IS NULL)::INT + (confidence IS NULL)::INT))::BIGINT AS n_null_cells, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END)::BIGINT AS n_redundant, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*) AS redundancy_pct FROM (SELECT *, count(*) OVER (PARTITION BY head, relation, tail) AS k FROM legislative_triples)",
        "eda_top_relations": "SELECT relation, count(*) AS n FROM legislative_triples WHERE relation IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "eda_top_entities": "SELECT head, count(*) AS n FROM legislative_triples WHERE head IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
        "val_vocab_coverage": f"SELECT relation, count(*) AS n, {known} AS in_vocabulary FROM legislative_triples WHERE relation IS NOT NULL GROUP BY 1",
        "val_per_law": "SELECT law_id, count(*) AS n_triples FROM legislative_triples WHERE law_id IS NOT NULL GROUP BY 1",
        "val_method_share": "SELECT coalesce(source_method, 'missing') AS source_method, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM legislative_triples), 9) AS pct FROM legislative_triples GROUP BY 1",
        "val_spotcheck": f"""{KG}, t AS (SELECT *, relation IN {_lit(CROSS_REFERENCES)} AS x FROM kg WHERE law_id IN {laws}),
c AS (SELECT law_id, string_agg(head || ' | ' || relation || ' | ' || tail, '; ' ORDER BY n) AS cross_references FROM (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY article_number, head, relation, tail) AS n FROM t WHERE x) WHERE n <= 10 GROUP BY 1)
SELECT t.law_id, count(*) AS n_triples, count(DISTINCT relation) AS n_relations, count(*) FILTER (x) AS n_cross_references, least(5, count(DISTINCT head || relation || tail || article_number))::INTEGER AS n_sample, coalesce(any_value(cross_references), '') AS cross_references FROM t LEFT JOIN c ON t.law_id = c.law_id GROUP BY 1""",
        "segment_shapes": "SELECT o_orderkey, article_number, replace(body, 'N', o_orderkey::VARCHAR) AS body FROM orders JOIN (VALUES "
        + ", ".join(f"({n}, '{a}', '{b}')" for n, (_, parts) in enumerate(SHAPES) for a, b in parts)
        + f") v(shape, article_number, body) ON o_orderkey % {len(SHAPES)} = shape",
        "cite_forms": f"SELECT o_orderkey, replace(f, 'N', o_orderkey::VARCHAR) AS surface, 'abroga' AS relation FROM orders, (SELECT unnest([{', '.join(chr(39) + x + chr(39) for x in FORMS)}]) AS f)",
        "ax_all": f"""{KG}, parts AS (
SELECT 'functional' AS axiom, relation FROM (SELECT head, relation FROM kg WHERE relation IN {_lit(FUNCTIONAL)} GROUP BY 1, 2 HAVING count(DISTINCT tail) > 1)
UNION ALL SELECT 'asymmetric', relation FROM ({_pairs(ASYMMETRIC, 'true')})
UNION ALL SELECT 'irreflexive', relation FROM kg WHERE relation IN {_lit(IRREFLEXIVE)} AND head = tail
UNION ALL SELECT 'symmetric', relation FROM (SELECT DISTINCT head, relation, tail FROM kg k WHERE relation IN {_lit(SYMMETRIC)} AND head <> tail AND NOT EXISTS (SELECT 1 FROM kg r WHERE r.relation = k.relation AND r.head = k.tail AND r.tail = k.head))
UNION ALL SELECT 'domain', relation FROM kg WHERE {" OR ".join(f"relation = '{r}' AND tail NOT IN {_lit(v)}" for r, v in TAIL_DOMAIN.items())}
UNION ALL SELECT 'transitive', l.relation FROM kg l JOIN kg r ON l.tail = r.head AND l.relation = r.relation WHERE l.relation IN {_lit(TRANSITIVE)})
SELECT axiom, relation, count(*) AS n FROM parts GROUP BY 1, 2""",
        "graph_components": f"""WITH RECURSIVE li AS (SELECT DISTINCT head, tail FROM ({KG_LINEITEM_SQL})), e AS (SELECT head AS a, tail AS b FROM li UNION ALL SELECT tail, head FROM li),
r AS (SELECT DISTINCT head AS root, head AS id FROM li UNION SELECT r.root, e.b FROM r JOIN e ON r.id = e.a),
c AS (SELECT root, min(id) AS component FROM r GROUP BY 1)
SELECT component, count(*) AS n_nodes FROM (SELECT DISTINCT id, component FROM r JOIN c USING (root)) GROUP BY 1""",
        "pipeline_acts": f"SELECT 'order_' || l_orderkey AS head, 'modifică' AS relation, 'lege_' || part || '_' || y AS tail, 'order_' || l_orderkey AS law_id, l_linenumber::VARCHAR AS article_number, 'regex' AS source_method, 1.0::DOUBLE AS confidence FROM ({ACT_LINES_SQL})",
        "pipeline_limited": f"WITH a AS ({ACT_LINES_SQL}), first AS (SELECT DISTINCT 'order_' || l_orderkey AS law_id FROM a ORDER BY 1 LIMIT 10) SELECT law_id, l_linenumber::VARCHAR AS article_number, 'lege_' || part || '_' || y AS tail FROM (SELECT *, 'order_' || l_orderkey AS law_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM a) JOIN first USING (law_id) WHERE n <= 2",
        "knn_topk": "WITH q AS (SELECT vec_id AS q_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0) SELECT q_id, rank::INTEGER AS rank, vec_id FROM (SELECT q_id, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY list_distance(q::DOUBLE[], embedding::DOUBLE[]), vec_id) AS rank FROM q, embeddings) WHERE rank <= 3",
        **whole.oracle_sql(),
        **storage.oracle_sql(),
        "p5_found": references.SQL,
        "p5_report": f"SELECT 'legislative_triples' AS tbl, fld, ym, orphan_kind, count(*) AS n_refs FROM ({references.SQL}) GROUP BY ALL",
    }

