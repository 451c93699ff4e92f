"""Reference operators on small hand-written inputs."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lexgraph.constants import TRIPLES
from lexgraph.operators import axioms, cite, extract, graph, report, resolve, score, segment, store, vector
from lexgraph.plans.pipeline import corpus_triples
from lexgraph.sources import files
from lexgraph.streaming import ingest


def triples(spark, *rows):
    return spark.createDataFrame([(*r, *(None,) * (7 - len(r))) for r in rows], TRIPLES)


META = "law_id string, tip_act string, numar string, an string, titlu string, in_force boolean, aliases array<string>"


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame([("lege_53_2003", "Lege", "53", "2003", "Codul muncii", True, ["Codul muncii"])], META)


def resolved(spark, aliases, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.resolved for r in resolve.resolve(rows, "c", aliases).orderBy("i").collect()]


def test_resolver(spark, meta):
    a = resolve.alias_dim(meta)
    same = ["Legea nr. 53/2003", "LEGEA 53/2003", "Legea nr.53/2003", "  legea nr. 53 / 2003  ", "Codul muncii", "codul MUNCII", "lege_53_2003"]
    assert resolved(spark, a, *same) == ["lege_53_2003"] * len(same)
    others = ["Legea nr. 999/1999", "O.U.G. nr. 89/2025", "Hotararea Guvernului nr. 1.705/2006", "Codul fiscal", "Constituția României", "random phrase", "", None, "Legii nr. 227/2015"]
    assert resolved(spark, a, *others) == ["lege_999_1999", "oug_89_2025", "hg_1705_2006", "lege_227_2015", "constitutia_romaniei", None, None, None, None]


def test_canonicalize_keeps_rows_and_nulls(spark, meta):
    df = triples(spark, ("LEGEA nr. 53 / 2003", "modifica", "«ACME SRL»"), (None, "x", "hotărârea necunoscută"), ("Codul muncii", "x", None))
    got = resolve.canonicalize(df, ["head", "tail"], resolve.alias_dim(meta)).select("head", "relation", "tail").collect()
    assert {tuple(r) for r in got} == {("lege_53_2003", "modifica", "ACME SRL"), (None, "x", "Hotărârea necunoscută"), ("lege_53_2003", "x", None)}


def citations(spark, text, law="oug_13_2026"):
    df = spark.createDataFrame([(law, text)], "law_id string, t string")
    c = cite.cited(df, "t")
    return {(r.relation, r.surface) for r in c.where(~cite.is_self(F.col("law_id"), F.col("surface"))).collect()}


def test_citations(spark):
    got = citations(spark, "Prezentul act modifică Legea nr. 53/2003 privind Codul muncii și abrogă Hotărârea Guvernului nr. 1.705/2006.")
    assert got == {("modifică", "Legea nr. 53/2003"), ("abroga", "Codul muncii"), ("abroga", "Hotărârea Guvernului nr. 1.705/2006")}
    assert citations(spark, "Pentru modificarea și completarea Legea nr. 53/2003 intră") == {("modifică", "Legea nr. 53/2003"), ("completează", "Legea nr. 53/2003")}
    assert citations(spark, "Fără nicio trimitere.") == set()
    assert citations(spark, "O.U.G. nr. 13/2026 se aplică.") == set()
    assert citations(spark, "O.U.G. nr. 113/2026 se aplică.") == {("face_referire_la", "O.U.G. nr. 113/2026")}
    assert citations(spark, None) == set()


def test_articles():
    split = segment.split_articles
    assert split(None) == [] and split("  ") == []
    assert [a["article_number"] for a in split("Un text fără articole.")] == ["full"]
    assert [a["article_number"] for a in split("x" * 40 + "\nArticol unic\nSe aprobă.\nArticolul 1\nceva")] == ["preambul", "unic"]
    assert [a["article_number"] for a in split("Art. 1\na\nArt. 2\nb\nArt. 14^2\nc\nArt. 3\nd\nArt. 4\ne")] == ["1", "2", "3", "4"]
    assert [a["article_number"] for a in split("Art. I\na\nArt. II\nb\nArt. 5\nc")] == ["I", "II"]
    assert [a["article_number"] for a in split("Art. I\na\nArt. 5\nc")] == ["5"]
    assert split("Articolul 1\n\nArticolul 2\ntext") == [{"article_number": "2", "header": "Articolul 2", "text": "text"}]


def test_rising_is_longest():
    rnd = random.Random(3)
    for _ in range(200):
        v = [rnd.randrange(8) for _ in range(rnd.randrange(10))]
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = max([best[j] + 1 for j in range(i) if v[j] < v[i]], default=1)
        got = segment.rising(v)
        assert len(got) == max(best, default=0)
        assert all(a < b and v[a] < v[b] for a, b in zip(got, got[1:], strict=False))


def test_windows(spark):
    texts = ["", "a" * 4000, "a" * 4001, "p" * 3000 + "\n\n" + "q" * 900 + "\n\n" + "r" * 500, "s\n\n" + "t" * 5000 + "\n\nu"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", segment.llm_windows(F.col("t")).alias("w")).collect()}
    assert got[0] == [""] and got[1] == ["a" * 4000] and [len(x) for x in got[2]] == [4000, 201]
    assert [len(x) for x in got[3]] == [3902, 500]
    assert [len(x) for x in got[4]] == [1, 4000, 1200, 1] and got[9] is None


def test_responses(spark):
    text = "[lege_53_2003 | modifica | oug_13_2026]\nfără\n['A', emis, B, C]\n[a | guverneaza | b]\n[a | emis]\n[ | emis | b]\n[lege_53_2003 | modifica | oug_13_2026]\n[x|emis|y|z]"
    got = {(r.head, r.relation, r.tail, r.source_method, r.confidence) for r in extract.parse_responses(spark.createDataFrame([(1, text), (2, ""), (3, None)], "i int, response string")).collect()}
    assert got == {("lege_53_2003", "modifică", "oug_13_2026", "llm", 0.7), ("A", "emis_de", "B, C", "llm", 0.7), ("x", "emis_de", "y", "llm", 0.7)}


def test_pluggable_model(spark):
    w = extract.windows_of(spark.createDataFrame([(1, "text")], "i int, text string"))
    r = extract.respond(w, "window", lambda prompts: [f"[a | emis | {len(p) > 0}]" for p in prompts])
    assert [x.tail for x in extract.parse_responses(r).collect()] == ["True"]


def test_best_confidence_and_store(spark):
    df = triples(spark, ("a", "r", "b", "l", "1", "llm", 0.7), ("a", "r", "b", "l", "1", "regex", 1.0), ("a", "r", "b", "l", "2", None, None), ("a", "r", "b", None, None, "llm", None))
    got = {(r.law_id, r.article_number, r.source_method, r.confidence) for r in store.best_confidence(df).collect()}
    assert got == {("l", "1", "regex", 1.0), ("l", "2", None, None), (None, None, "llm", None)}
    assert store.add_triples(df, df).count() == 4
    bare = store.conform(df.select("head", "relation", "tail", F.lit(3).alias("extra")))
    assert bare.schema.fieldNames() == TRIPLES.fieldNames() and bare.where("confidence IS NULL").count() == 4
    assert store.triples_with_sources(df).count() == 4
    s = store.triples_with_sources(df, nested=True).first()
    assert s.n_sources == 4 and len(s.sources) == 4


def test_axioms_on_the_negative_document(spark):
    rows = [
        ("lege_1_2001", "emis_de", "Parlamentul României"), ("lege_1_2001", "emis_de", "Guvernul României"), ("h", "promulgat_de", "Klaus Iohannis"), ("h", "promulgat_de", "Altcineva"),
        ("a", "modifică", "b"), ("b", "modifică", "a"), ("c", "abroga", "c"), ("x", "colaborează_cu", "y"), ("z", "publicat_în", "Ziar"), (None, "modifică", "q"),
    ]
    df = triples(spark, *rows)
    v = axioms.violation_counts(df).first()
    assert (v.functional, v["asymmetric"], v.irreflexive, v.domain, v.vocabulary, v.total) == (2, 1, 1, 2, 0, 6)
    assert {tuple(r) for r in axioms.asymmetric(df).collect()} == {("modifică", "a", "b"), ("abroga", "c", "c")}
    assert [tuple(r) for r in axioms.symmetric(df).collect()] == [("x", "colaborează_cu", "y")]
    assert axioms.two_hops(df).count() == 2 and axioms.two_hop_count(df).first().n_paths == 2
    assert axioms.violation_counts(triples(spark)).first().total == 0
    assert axioms.all_violations(df).count() == 2 + 2 + 1 + 1 + 2 + 2


def test_graph(spark, meta):
    df = triples(spark, ("lege_53_2003", "r", "oug_1_2020"), ("lege_53_2003", "r", "oug_1_2020"), ("oug_1_2020", "r", "lege_53_2003"), ("x", "r", "x"), ("y", "r", None))
    assert {r.id for r in graph.nodes(df).collect()} == {"lege_53_2003", "oug_1_2020", "x"}
    law = {r.id: r for r in graph.annotate_laws(graph.nodes(df), meta).collect()}
    assert law["lege_53_2003"].tip_act == "Lege" and law["lege_53_2003"].external is None and law["oug_1_2020"].external and law["x"].node_type is None
    assert {r.id: (r.in_degree, r.out_degree) for r in graph.degrees(df).collect()} == {"lege_53_2003": (1, 2), "oug_1_2020": (2, 1), "x": (1, 1)}
    assert graph.reciprocity(df).first().reciprocity == pytest.approx(0.5)
    assert graph.density(triples(spark)).first().density == 0.0 and graph.reciprocity(triples(spark)).first().reciprocity is None
    chain = triples(spark, *[(f"n{i:02d}", "r", f"n{i + 1:02d}") for i in range(40)], ("z1", "r", "z2"))
    assert {r.component: r["count"] for r in graph.components(chain).groupBy("component").count().collect()} == {"n00": 41, "z1": 2}


def test_score_of_identical_sets(spark):
    onto = triples(spark, ("a", "modifică", "b"), ("b", "abroga", "c"))
    r = score.compliance(onto.withColumn("doc_id", F.lit("d")), onto).first()
    assert r.relation_jaccard == r.node_jaccard == r.triple_jaccard == 1.0 and r.relation_distribution_cosine == pytest.approx(1.0) and r.compliance_score == pytest.approx(1.0)
    r = score.compliance(onto.withColumn("doc_id", F.lit("d")), triples(spark)).first()
    assert r.triple_jaccard == 0.0 and r.relation_distribution_cosine == 0.0


def test_nearest_in_turns(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id int, v array<double>")
    q = df.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    whole = {tuple(r) for r in vector.nearest(df, "id", "v", q, "qid", "qv", 2).collect()}
    monkeypatch.setattr(vector, "MAX_QUERIES", 2)
    assert {tuple(r) for r in vector.nearest(df, "id", "v", q, "qid", "qv", 2).collect()} == whole and len(whole) == 18
    assert vector.nearest(df, "id", "v", q.limit(0), "qid", "qv", 2).count() == 0


def test_nearest_matches_brute_force(spark):
    rnd = random.Random(1)
    v = [(i, [rnd.random() for _ in range(4)]) for i in range(50)] + [(50, None), (51, [0.5])]
    df = spark.createDataFrame(v, "id int, v array<double>")
    q = df.where("id IN (3, 7)").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    got = {(r.qid, r["rank"]): r.id for r in vector.nearest(df, "id", "v", q, "qid", "qv", 4).collect()}
    for k in (3, 7):
        order = sorted((sum((a - b) ** 2 for a, b in zip(x, v[k][1], strict=True)), i) for i, x in v[:50])
        assert [got[k, n] for n in range(1, 5)] == [i for _, i in order[:4]]
    assert vector.embed(spark.createDataFrame([("a b",), (None,)], "t string"), "t", vector.hashing_embedding).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "lege_1_2020.txt").write_text("LEGE nr. 1 din 3 mai 2020\nprivind ceva\nEMITENT\nPARLAMENTUL\nPublicat în MONITORUL OFICIAL nr. 12 din 4 mai 2020\n\nArticolul 1\nSe abrogă Legea nr. 2/2001.", encoding="utf-8")
    (tmp_path / "hg_2_2020.txt").write_text("Articolul 1\nText.", encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "lege_1_2020.meta.json").write_text(json.dumps({"law_id": "lege_1_2020", "tip_act": "Lege", "numar": "1", "an": "2020"}))
    (tmp_path / "hg_2_2020.meta.json").write_text("{broken")
    laws = {r.law_id: r for r in files.read_laws(spark, str(tmp_path)).collect()}
    assert set(laws) == {"lege_1_2020", "hg_2_2020"} and laws["lege_1_2020"].meta.tip_act == "Lege" and laws["hg_2_2020"].meta.tip_act is None
    assert laws["lege_1_2020"].law_text.startswith("Articolul 1")
    raw = spark.createDataFrame([("lege_1_2020", (tmp_path / "lege_1_2020.txt").read_text(encoding="utf-8"))], "law_id string, law_text string")
    m = files.derive_meta(raw).first()
    assert (m.tip_act, m.numar, m.an, m.emitent, m.data_act, m.monitorul_oficial_nr) == ("Lege", "1", "2020", "PARLAMENTUL", "2020-05-03", "12")
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "d.json").write_text(json.dumps({"doc_id": "d", "triples": [{"head": "Legea nr. 1/2020", "relation": "modifica", "tail": "x"}, {"head": "a", "relation": "guverneaza", "tail": "b"}]}))
    r = files.read_documents(spark, str(docs)).collect()
    assert [(x.head, x.relation, x.article_number, x.dropped) for x in r] == [("lege_1_2020", "modifică", "", ["guverneaza"])]


def test_store_files_and_stream(spark, tmp_path):
    df = triples(spark, ("a", "r", "b", "l", "1", "llm", 0.7), ("a", "r", "c", None, "2", None, None))
    files.write_triples(df, str(tmp_path / "csv"), "csv")
    assert {tuple(r) for r in files.read_triples(spark, str(tmp_path / "csv"), "csv").collect()} == {tuple(r) for r in df.collect()}
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest(ingest.triple_stream(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
        df.write.mode("append").parquet(str(tmp_path / "in"))
    assert files.read_triples(spark, str(tmp_path / "store")).count() == 2


def test_pipeline(spark, meta):
    laws = spark.createDataFrame([("oug_1_2020", "Articolul 1\nSe modifică Legea nr. 53/2003.\nArticolul 2\nPotrivit Codul muncii și O.U.G. nr. 1/2020."), ("x", None), ("y", "")], "law_id string, law_text string")
    got = {(r.head, r.relation, r.tail, r.article_number) for r in corpus_triples(laws, meta).collect()}
    assert got == {("oug_1_2020", "modifică", "lege_53_2003", "1"), ("oug_1_2020", "face_referire_la", "lege_53_2003", "2")}
    assert files.synthetic_laws(spark, 8).count() == 8


def reference_form(value, known):
    """The canonical form of an entity in plain Python."""
    import re
    import unicodedata

    words = {w: w[0].upper() + w[1:] for w in ("legea", "codul", "hotărârea", "ordonanța", "decretul", "constituția", "monitorul", "parlamentul", "guvernul", "președintele", "ministerul")}
    s = unicodedata.normalize("NFC", value).translate(str.maketrans("şŞţŢ", "șȘțȚ"))
    s = re.sub(r"\s+", " ", re.sub(r"[​-‏⁠﻿ ]", " ", s)).strip(" \t\n\r.,;:\"'`«»“”’()[]{}")
    if s in known:
        return known[s]
    first, sep, rest = s.partition(" ")
    if re.search(r"\d", s):
        s = re.sub(r"\s*/\s*", "/", re.sub(r"\bnr\s*\.\s*", "nr. ", s, flags=re.I))
        first, sep, rest = s.partition(" ")
        low = first.lower().rstrip(".,")
    else:
        low = first.lower()
    return words[low] + sep + rest if low in words else s


def test_display_forms(spark):
    values = [
        "guvernul României", "GUVERNUL României", "parlamentul", "ministerul  Dreptăţii", "monitorul Oficial", "președintele României", "PREŞEDINTELE", "lege specială", "legii 5", "ordonanței",
        "legea, nr.5 / 2001 bis", "legea., anexa 3", "Anexa nr . 4 / 5", "nr 5", "«guvernul»", "hotărârea​necunoscută", "codul rutier", "a b", "", "guvernul.", "decretul\nregal",
    ]
    got = resolve.canonicalize(triples(spark, *((str(i), "x", v) for i, v in enumerate(values))), ["tail"], None)
    assert {int(r["head"]): r.tail for r in got.collect()} == {i: reference_form(v, {}) for i, v in enumerate(values)}


@pytest.mark.parametrize(
    "form",
    [
        "Legea nr. 5/2001", "Legii nr.5/2001", "Legea-cadru nr. 153/2017", "Ordonanța de urgență a Guvernului nr. 89/2025", "Ordonanței de urgenței nr. 89/2025", "O.U.G. nr. 89/2025", "OUG nr. 89/2025",
        "O.U.G.nr. 89/2025", "oug nr 89/2025", "Ordonanța Guvernului nr. 81/2003", "Ordonanța nr. 81/2003", "O.G. nr. 81/2003", "OG nr. 81/2003", "O. G. nr.81/2003", "Hotărârea Guvernului nr. 1.705/2006",
        "Hotărârii nr. 1705/2006", "H.G. nr. 1705/2006", "HG nr. 1.705/2006", "HGnr.1/2006", "Codul de procedură civilă", "codul fiscal", "Constituția României", "Constituției României",
    ],
)
def test_every_form_of_a_citation(spark, form):
    assert citations(spark, f"Se abrogă {form}, cu aviz.") == {("abroga", form)}


def test_what_is_no_citation(spark):
    for text in ("Legea 5/2001", "Legea nr. 5 / 2001", "Decretul nr. 5/2001", "Codul rutier", "OUG 89/2025"):
        assert citations(spark, text) == set()


def test_many_citations_keep_their_windows(spark):
    text = "\x01" + " ".join(f"{'Se abrogă' if i % 3 else 'Potrivit'} HGnr{i}/2006{'x' * (i % 90)}." for i in range(300))
    got = citations(spark, text)
    assert len({s for _, s in got}) == 300 and {r for r, _ in got} == {"abroga", "face_referire_la"}


def test_anaphora_forms(spark):
    own = ["prezenta lege", "Prezentul cod fiscal", "PREZENTA", "Hotărârea", "hotararea de mai sus", "Hotarârea Guvernului", "legea", "Ordonanța de urgență", "ordonanta", "Codul muncii", "prezental x", "legea​"]
    other = ["prezent", "prezentei legi", "legea nr. X", "Legea 5", "hotărâri", " legea", "legeax", "lege", "ordonanţa", "", "legea\nb"]
    df = triples(spark, *((v, "x", str(i)) for i, v in enumerate(own + other)), (None, "x", "99"))
    got = {int(r.tail): r["head"] for r in resolve.resolve_anaphora(df, F.lit("L"), ("head",)).collect()}
    assert [got[i] for i in range(len(own))] == ["L"] * len(own)
    assert [got[len(own) + i] for i in range(len(other))] == other and got[99] is None


def test_hubs_are_split_and_chains_whole(spark):
    rows = [(f"a{i}", "modifică", "hub") for i in range(30)] + [("hub", "modifică", f"c{i}") for i in range(20)] + [("a1", "modifică", "hub"), ("hub", "modifică", "hub"), ("c1", "modifică", "d")]
    df = triples(spark, *rows)
    whole = {tuple(r) for r in axioms.two_hops(df).collect()}
    assert whole == {tuple(r) for r in axioms.two_hops(df, per_task=7).collect()} and sum(r[4] for r in whole) == axioms.two_hop_count(df).first().n_paths


def test_spot_check_in_full(spark):
    df = triples(spark, *((f"l{i % 2}", "modifică" if i % 3 else "emis_de", f"t{i}", f"l{i % 2}", str(i)) for i in range(40)))
    s = {r.law_id: r for r in report.spot_check(df, ["l0", "l1", "l9"]).collect()}
    assert set(s) == {"l0", "l1"} and len(s["l0"].sample) == 5 and len(s["l0"].cross_references) == 10
    assert all(" | modifică | " in x for x in s["l1"].cross_references)
    bare = report.spot_check(df.select("head", "relation", "tail"), ["l0"]).first()
    assert bare.n_triples == 20 and len(bare.cross_references) == 10


def test_full_eda(spark):
    r = report.full_eda(triples(spark, ("a", "r", "b"), ("b", "r", "a"), ("a", "q", None)))
    assert {k: v.count() for k, v in r.items()} == {"basic": 1, "density": 1, "reciprocity": 1, "top_relations": 2, "rare_relations": 2, "top_heads": 2, "top_tails": 2, "relations": 2, "degrees": 1, "in_degrees": 1, "out_degrees": 1}


def test_sidecars_are_written_once(spark, tmp_path):
    head = "LEGE nr. 5 din 3 mai 2001\nprivind apele"
    laws = spark.createDataFrame([("a", head), ("b", None), ("c", "")], "law_id string, law_text string")
    path = str(tmp_path / "meta")
    files.write_meta(files.missing_meta(laws.where("law_id = 'a'"), spark.createDataFrame([], files.META)), path)
    files.write_meta(files.missing_meta(laws, files.read_meta_store(spark, path)), path)
    got = {r.law_id: (r.tip_act, r.numar, r.an, r.in_force, r.aliases) for r in files.read_meta_store(spark, path).collect()}
    assert got == {"a": ("Lege", "5", "2001", True, None), "b": (None, None, None, True, None), "c": (None, None, None, True, None)}
    assert files.missing_meta(laws, files.read_meta_store(spark, path), overwrite=True).count() == 3


def test_store_and_reports(spark, tmp_path):
    from lexgraph.operators import score

    df = triples(spark, (" a ", "emis_de", 'b "c"\nd', "l", "1", "regex", 1.0), ("x", "straină", "y"))
    corpus = spark.createDataFrame([("l", ' "text",\nrând '), ("m", None)], "law_id string, law_text string")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        files.write_store(df, corpus, path, fmt)
        assert {tuple(r) for r in files.read_triples(spark, f"{path}/triples", fmt).collect()} == {tuple(r) for r in df.collect()}
        assert {tuple(r) for r in files.read_corpus(spark, path, fmt).collect()} == {tuple(r) for r in corpus.collect()}
    docs = df.select("head", "relation", "tail", F.lit("d").alias("doc_id"), F.array(F.lit("alta")).alias("dropped"))
    report_ = score.compare_documents(docs, df)
    files.write_reports(report_, str(tmp_path / "reports"))
    whole = spark.read.json(str(tmp_path / "reports" / "json")).first()
    flat = spark.read.option("header", True).csv(str(tmp_path / "reports" / "csv")).first()
    assert whole.doc_id == "d" and whole.n_dropped == 1 and whole.axiom_violations.domain == 1 and flat.domain == "1" and flat.triple_jaccard == "0.333"
    with pytest.raises(ValueError, match="empty"):
        score.compare_documents(docs, df.limit(0))


def test_vector_store_appends(spark, tmp_path):
    path = str(tmp_path / "v")
    a = spark.createDataFrame([("c1", 1), ("c1", 1), ("c2", 2)], "chunk_id string, x int")
    files.append_chunks(a, path)
    files.append_chunks(a.withColumn("x", F.col("x") + 10).unionByName(spark.createDataFrame([("c3", 3)], "chunk_id string, x int")), path)
    assert {tuple(r) for r in files.read_chunks(spark, path).collect()} == {("c1", 1), ("c2", 2), ("c3", 3)}
    assert files.read_chunks(spark, str(tmp_path / "none")) is None


def test_recorded_responses_and_prompts(spark):
    w = spark.createDataFrame([(1, "unu"), (2, "doi"), (3, None)], "i int, window string")
    recorded = spark.createDataFrame([("unu", "[a | emis | b]"), ("unu", "[z | emis | b]"), ("alt", "x")], "t string, response string").select(extract.window_hash(F.col("t")).alias("window_hash"), "response")
    got = {r.i: r.response for r in extract.respond(w, "window", responses=recorded).collect()}
    assert got == {1: "[a | emis | b]", 2: None, 3: None}
    with pytest.raises(ValueError, match="recorded"):
        extract.respond(w, "window")
    p = extract.prompt("TEXT", {"emis_de": "organul emitent"})
    assert "- emis_de: organul emitent\n" in p and "- abroga\n" in p and p.count("\n- ") == 16 and "TEXT" in p


def test_limits_of_laws_and_articles(spark, meta):
    text = "Articolul 1\nSe modifică Legea nr. {0}1/2003.\nArticolul 2\nSe modifică Legea nr. {0}2/2003."
    laws = spark.createDataFrame([(f"lege_{i}_2020", text.format(i)) for i in (3, 1, 2)], "law_id string, law_text string")
    assert {r.tail for r in corpus_triples(laws, meta, max_laws=2, max_articles=1).collect()} == {"lege_11_2003", "lege_21_2003"}
    assert corpus_triples(laws, meta, max_laws=0).count() == 6


def test_register(spark):
    rows = [("a", 1, 1), ("a", 2, 3), ("b", None, 2), (None, 9, 9)]
    m = spark.createDataFrame(rows, "law_id string, registered_at int, meta_id int")
    assert {r.law_id for r in resolve.known_law_ids(m).collect()} == {"a", "b"}
    assert [tuple(r) for r in resolve.get_meta(m, "a").collect()] == [("a", 2, 3)] and resolve.get_meta(m, "q").count() == 0


def test_late_arrivals(spark, tmp_path):
    from datetime import datetime

    rows = [(datetime(2024, 1, 1, h), datetime(2024, 1, 1, h + 2)) for h in range(3)]
    spark.createDataFrame(rows, "extracted_at timestamp, loaded_at timestamp").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("extracted_at timestamp, loaded_at timestamp").parquet(str(tmp_path / "in"))
    q = ingest.late_arrivals(s, "extracted_at", "loaded_at").writeStream.format("memory").queryName("late").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.n, r.mean_hours_late) for r in spark.table("late").collect()] == [(3, 2.0)]
    assert files.sample_law(spark).count() == 1
