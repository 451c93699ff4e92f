"""Queries over the whole statutory tables, texts as stored, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ASYMMETRIC, CODE_NAMES, EDGE_PUNCTUATION, FUNCTIONAL, IRREFLEXIVE, LAW_WORDS, RELATIONS, TAIL_DOMAIN
from ..functions import text as tx
from ..operators import axioms, cite, extract, graph, report, resolve
from ..runtime import table

#: Windows of the test queries are smaller than a model's, so that texts have several.
SIZE, OVERLAP = 1000, 100


def norm_ro(spark: SparkSession, d: str) -> DataFrame:
    """Every text of documents and legislative_corpus as stored, normalised."""
    docs = table(spark, d, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"), F.col("text").alias("t"))
    acts = table(spark, d, "legislative_corpus").select(F.lit("legislative_corpus").alias("tbl"), F.col("corpus_id").alias("row_id"), F.col("law_text").alias("t"))
    return docs.unionByName(acts).select("tbl", "row_id", tx.normalize_ro(F.col("t")).alias("norm"))


def law_summary(spark: SparkSession, d: str) -> DataFrame:
    """Length and preview of every act of the corpus."""
    return report.law_summary(table(spark, d, "legislative_corpus")).select("corpus_id", "n_chars", "preview")


def llm_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every window of every document's text, paragraphs packed; a NULL text has none."""
    return extract.windows_of(table(spark, d, "documents").select("doc_id", "text"), size=SIZE, overlap=OVERLAP)


def cite_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The acts that each text of the corpus cites, in their order, as written but for white space."""
    c = table(spark, d, "legislative_corpus").select("corpus_id", cite.scan(tx.comma_below(F.col("law_text"))).alias("c"))
    surfaces = F.transform("c", lambda x: F.regexp_replace(x["surface"], r"(?U)[\s\x1c-\x1f]+", " "))
    return c.select("corpus_id", F.size("c").alias("n_citations"), F.array_join(surfaces, "|").alias("surfaces")).where("n_citations > 0")


def anaphora_triples(spark: SparkSession, d: str) -> DataFrame:
    """Heads and tails of every triple, those that mean the act itself replaced by it."""
    t = table(spark, d, "legislative_triples").select("triple_id", "head", "tail", "law_id")
    return resolve.resolve_anaphora(t, F.col("law_id")).select("triple_id", "head", "tail")


def canonical_triples(spark: SparkSession, d: str) -> DataFrame:
    """Heads and tails of every triple in canonical form, without a register."""
    t = table(spark, d, "legislative_triples").select("triple_id", "head", "tail")
    return resolve.canonicalize(t, ["head", "tail"], None)


def graph_nodes_triples(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of every entity of the triples."""
    return graph.degrees(table(spark, d, "legislative_triples"))


def val_ontology(spark: SparkSession, d: str) -> DataFrame:
    """The axioms on head, relation and tail of every triple."""
    return axioms.violation_counts(table(spark, d, "legislative_triples").select("head", "relation", "tail"))


def known_law_ids(spark: SparkSession, d: str) -> DataFrame:
    return resolve.known_law_ids(table(spark, d, "law_meta"))


def law_registrations(spark: SparkSession, d: str) -> DataFrame:
    """The registration of each act that counts: its latest."""
    return resolve.latest_meta(table(spark, d, "law_meta")).select("law_id", "meta_id", "tip_act", "numar", "an", "titlu", "in_force")


ALL = (norm_ro, law_summary, llm_windows, cite_corpus, anaphora_triples, canonical_triples, graph_nodes_triples, val_ontology, known_law_ids, law_registrations)

# white space as Java and Python know it, for patterns of an engine that knows ASCII only
_S = r"\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _unicode(pattern: str) -> str:
    """A pattern whose blanks and digits are those of Unicode."""
    return pattern.replace("[\\d.]", r"[\p{Nd}.]").replace(r"\s", f"[{_S}]").replace(r"\d", r"\p{Nd}")


_CEDILLA = "translate({}, 'şŞţŢ', 'șȘțȚ')"


def _norm_sql() -> str:
    gazette = _unicode(tx.GAZETTE.removeprefix("(?iU)"))
    steps = "SELECT tbl, row_id, " + _CEDILLA.format("nfc_normalize(t)") + " AS t FROM (SELECT 'documents' AS tbl, doc_id AS row_id, text AS t FROM documents UNION ALL SELECT 'legislative_corpus', corpus_id, law_text FROM legislative_corpus)"
    line = f"(?s)^.*?(?i:{gazette})[^\\n]*\\n*"
    steps = f"SELECT tbl, row_id, regexp_replace(t, {_q(line)}, '') AS t FROM ({steps})"
    return f"""SELECT tbl, row_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[{_S}]+', ''), '[{_S}]+$', '') AS norm FROM ({steps})"""


def _windows_sql() -> str:
    """Paragraphs packed one by one; a long one is cut into overlapping windows."""
    stride = SIZE - OVERLAP
    cut = f"[substr(p, i * {stride} + 1, {SIZE}) for i in range(0, 1 + greatest(0, CAST(ceil((length(p) - {SIZE}) / {stride}.0) AS INTEGER)))]"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents WHERE length(text) > {SIZE}),
w AS (
  SELECT doc_id, 0 AS n, ''::VARCHAR AS buf, []::VARCHAR[] AS ws FROM d
  UNION ALL
  SELECT doc_id, n + 1,
         CASE WHEN length(p) > {SIZE} THEN '' WHEN length(joined) <= {SIZE} THEN joined ELSE p END,
         CASE WHEN length(p) > {SIZE} THEN list_concat(flushed, {cut}) WHEN length(joined) <= {SIZE} THEN ws ELSE flushed END
  FROM (SELECT w.doc_id, w.n, w.ws, p, CASE WHEN buf = '' THEN p ELSE buf || chr(10) || chr(10) || p END AS joined, CASE WHEN buf = '' THEN ws ELSE list_append(ws, buf) END AS flushed
        FROM (SELECT w.*, d.ps[w.n + 1] AS p FROM w JOIN d ON w.doc_id = d.doc_id WHERE w.n < len(d.ps)) w)
),
done AS (SELECT w.doc_id, CASE WHEN buf = '' THEN ws ELSE list_append(ws, buf) END AS ws FROM w JOIN d ON w.doc_id = d.doc_id WHERE w.n = len(d.ps)
         UNION ALL SELECT doc_id, [text] FROM documents WHERE length(text) <= {SIZE})
SELECT doc_id, (i - 1)::INTEGER AS window_no, ws[i] AS "window" FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM done)"""


def _cite_sql() -> str:
    found = f"regexp_extract_all({_CEDILLA.format('law_text')}, {_q('(?i)(?:' + '|'.join(_unicode(f) for f in cite.ACT_FORMS) + ')')})"
    return f"SELECT corpus_id, len(c)::INTEGER AS n_citations, array_to_string([regexp_replace(x, '[{_S}]+', ' ', 'g') for x in c], '|') AS surfaces FROM (SELECT corpus_id, {found} AS c FROM legislative_corpus WHERE law_text IS NOT NULL) WHERE len(c) > 0"


def _anaphora_sql() -> str:
    def own(c: str) -> str:
        return f"CASE WHEN law_id <> '' AND regexp_matches({c}, {_q('(?i)' + resolve.ANAPHORA)}) AND NOT regexp_matches({c}, {_q('(?i)' + resolve.EXPLICIT)}) THEN law_id ELSE {c} END AS {c}"

    return f"SELECT triple_id, {own('head')}, {own('tail')} FROM legislative_triples"


def _canonical_sql() -> str:
    """The canonical form of each distinct value, step by step, joined to the triples."""
    src, dst = tx.accent_tables()
    known = " ".join(f"WHEN k = {_q(k)} THEN {_q(v)}" for k, v in CODE_NAMES.items())
    synth = " ".join(
        f"WHEN regexp_matches(k, {_q(form + resolve.NUMBER)}) THEN {_q(prefix + '_')} || replace(regexp_extract(k, {_q(form + resolve.NUMBER)}, 1), '.', '') || '_' || regexp_extract(k, {_q(form + resolve.NUMBER)}, 2)" for prefix, form in resolve.SYNTH
    )
    edge = _q(EDGE_PUNCTUATION)
    return f"""WITH v AS (SELECT DISTINCT x FROM (SELECT head AS x FROM legislative_triples UNION ALL SELECT tail FROM legislative_triples) WHERE x IS NOT NULL),
a AS (SELECT x, trim(regexp_replace(regexp_replace({_CEDILLA.format('nfc_normalize(x)')}, '[\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}\\x{{a0}}]', ' ', 'g'), '[{_S}]+', ' ', 'g'), {edge}) AS c FROM v),
b AS (SELECT x, c, regexp_replace(regexp_replace(trim(trim(regexp_replace(lower(translate(c, {_q(src)}, {_q(dst)})), '[{_S}]+', ' ', 'g'), ' '), {edge}), '[{_S}]*/[{_S}]*', '/', 'g'), '\\bnr\\.?[{_S}]*([0-9])', 'nr. \\1', 'g') AS k FROM a),
e AS (SELECT x, c, k, CASE WHEN regexp_matches(c, '\\p{{Nd}}') THEN regexp_replace(regexp_replace(c, '(?i)\\bnr[{_S}]*\\.[{_S}]*', 'nr. ', 'g'), '[{_S}]*/[{_S}]*', '/', 'g') ELSE c END AS s FROM b),
f AS (SELECT *, split_part(s, ' ', 1) AS w0, CASE WHEN regexp_matches(c, '\\p{{Nd}}') THEN rtrim(lower(split_part(s, ' ', 1)), '.,') ELSE lower(split_part(s, ' ', 1)) END AS w FROM e),
g AS (SELECT x, CASE WHEN regexp_matches(trim(lower(c)), '^[a-z]+(_[0-9]+){{2,}}$') THEN trim(lower(c)) {known} {synth}
                     WHEN w IN {_list(LAW_WORDS)} THEN upper(w[1]) || substr(w, 2) || substr(s, length(w0) + 1) ELSE s END AS y FROM f)
SELECT triple_id, h.y AS head, t.y AS tail FROM legislative_triples LEFT JOIN g h ON head = h.x LEFT JOIN g t ON tail = t.x"""


def _ontology_sql() -> str:
    pair = "SELECT 1 FROM t WHERE relation IN {} AND head <> tail GROUP BY relation, least(head, tail), greatest(head, tail) HAVING bool_or(head < tail) AND bool_or(head > tail)"
    domain = " OR ".join(f"relation = {_q(r)} AND tail NOT IN {_list(v)}" for r, v in TAIL_DOMAIN.items())
    return f"""WITH t AS (SELECT head, relation, tail FROM legislative_triples),
c AS (SELECT (SELECT count(*) FROM (SELECT head, relation FROM t WHERE relation IN {_list(FUNCTIONAL)} AND head IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT tail) > 1)) AS functional,
             (SELECT count(*) FROM ({pair.format(_list(ASYMMETRIC))})) AS "asymmetric",
             (SELECT count(*) FROM t WHERE relation IN {_list(IRREFLEXIVE)} AND head = tail) AS irreflexive,
             (SELECT count(*) FROM t WHERE head IS NOT NULL AND tail IS NOT NULL AND ({domain})) AS domain,
             (SELECT count(*) FROM t WHERE relation NOT IN {_list(RELATIONS)}) AS vocabulary, (SELECT count(*) FROM t) AS n_triples)
SELECT *, functional + "asymmetric" + irreflexive + domain + vocabulary AS total FROM c"""


def oracle_sql() -> dict[str, str]:
    return {
        "norm_ro": _norm_sql(),
        "law_summary": "SELECT corpus_id, length(law_text)::INTEGER AS n_chars, substr(regexp_replace(law_text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), 1, 60) AS preview FROM legislative_corpus",
        "llm_windows": _windows_sql(),
        "cite_corpus": _cite_sql(),
        "anaphora_triples": _anaphora_sql(),
        "canonical_triples": _canonical_sql(),
        "graph_nodes_triples": "SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, sum(i + o)::BIGINT AS degree FROM (SELECT head AS id, 0 AS i, 1 AS o FROM legislative_triples WHERE tail IS NOT NULL UNION ALL SELECT tail, 1, 0 FROM legislative_triples WHERE head IS NOT NULL) WHERE id IS NOT NULL GROUP BY 1",
        "val_ontology": _ontology_sql(),
        "known_law_ids": "SELECT DISTINCT law_id FROM law_meta WHERE law_id IS NOT NULL",
        "law_registrations": "SELECT law_id, meta_id, tip_act, numar, an, titlu, in_force FROM (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY registered_at DESC NULLS LAST, meta_id DESC) AS n FROM law_meta WHERE law_id IS NOT NULL) WHERE n = 1",
    }
