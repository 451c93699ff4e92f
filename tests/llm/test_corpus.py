"""Leakage and subject areas against brute force and held-out samples; the entry module without the subpackage."""

from __future__ import annotations

import os
import random
import re
import shutil
import subprocess
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgraph.llm import leakage, queries, subjects
from lexgraph.llm.edits import fold_text
from lexgraph.llm.wordhash import words_of
from lexgraph.runtime import table
from tests.compare import connect, differing

TEXT = st.text(alphabet="aăàbА1٣.,-’\n​́ ﬁ𝐚", max_size=60)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_are_the_folded_words(texts):
    w = words_of(texts)
    for i, t in enumerate(texts):
        want = re.findall(r"[^\W_]+", fold_text((t or "").replace("𝐚", " ")).replace("́", ""))
        if "𝐚" not in (t or ""):
            assert int((w.text == i).sum()) == len(want)
    same = words_of(["Hotărârea", "HOTARAREA", "Ноtărârea", "ho​tararea", "ｈotararea"]).hash
    assert len(set(same.tolist())) == 1


def brute_leaks(texts, passages, least):
    word = re.compile(r"[a-z0-9]+")
    out = set()
    for d, t in enumerate(texts):
        a = word.findall(fold_text(t or ""))
        for i, p in enumerate(passages):
            b = word.findall(fold_text(p or ""))
            for shift in range(-len(b), len(a)):
                eq = [0 <= q + shift < len(a) and a[q + shift] == b[q] for q in range(len(b))]
                for s in range(len(b)):
                    e = last = s
                    while eq[s] and e < len(b) and (eq[e] or (e + 1 < len(b) and eq[e + 1])):
                        last = e if eq[e] else last
                        e += 1
                    if eq[s] and last - s + 1 >= least:
                        out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rnd = random.Random(7)
    lex = [f"cuvânt{i}" for i in range(40)]
    passages = [" ".join(rnd.choices(lex, k=40)) for _ in range(4)] + ["scurt " * 3, None]
    texts = [None, "", "nimic"]
    for _ in range(60):
        p = rnd.choice(passages[:4]).split()
        n = rnd.choice([10, 28, 30, 35, 40])
        a = rnd.randrange(0, 41 - n)
        q = p[a : a + n]
        for k in range(rnd.randrange(8), n, rnd.choice([9, 15])):
            q[k] = "altul"
        sep = rnd.choice([" ", "\n", ", "])
        texts.append(" ".join(rnd.choices(lex, k=20)) + sep + sep.join(q).upper() + " " + " ".join(rnd.choices(lex, k=15)))
    texts += texts[3:6]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id bigint, passage string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "passage").collect()}
    assert got == brute_leaks(texts, passages, 30) and len(got) > 20
    cut = {r.doc_id: r.clean_text for r in leakage.remove_leaks(docs, "text", items, "item_id", "passage").collect()}
    assert cut[0] is None and cut[1] == "" and cut[2] == "nimic"
    for d, t in enumerate(texts):
        assert (cut[d] == t) == (d not in {x for x, _ in got})
    left = spark.createDataFrame(list(cut.items()), "doc_id bigint, text string")
    assert leakage.find_leaks(left, "doc_id", "text", items, "item_id", "passage").count() == 0
    assert leakage.find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "passage").count() == 0
    assert leakage.find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0


@pytest.mark.parametrize("every", [2, 3, 4, 5, 6, 7])
def test_every_pattern_of_single_replaced_words(every):
    rnd = random.Random(every)
    item = [f"c{i}" for i in range(31)]
    index = leakage.ItemIndex([5], [" ".join(item)], 30)
    for start in range(1, every + 1):
        q = [w if (i - start) % every else "altul" for i, w in enumerate(item)]
        equal = [i for i, w in enumerate(q) if w != "altul"]
        want = equal[-1] - equal[0] + 1 >= 30
        assert bool(leakage.leaks([" ".join(["a", *q, "b"])], index, 30)[1]) == want
    for _ in range(100):
        gone = [i for i in range(1, 30) if rnd.random() < 0.6]
        gone = [i for k, i in enumerate(gone) if not k or i - gone[k - 1] > 1]
        q = ["altul" if i in gone else w for i, w in enumerate(item)]
        if all(b - a > 1 for a, b in zip(gone, gone[1:], strict=False)):
            assert leakage.leaks([" ".join(q)], index, 30)[1]


@pytest.mark.parametrize("least", [3, 5, 9, 13, 19, 30])
def test_no_stretch_avoids_the_seeds(least):
    pats = leakage.seed_patterns(least)
    gaps = (least + 1) // 2 - 1
    forms = {tuple(b - a for a, b in zip(p, p[1:], strict=False)) for p in pats}
    n = len(pats[0]) - 1
    for seq in range(1 << min(gaps, 14)):
        s = [1 + (seq >> k & 1) for k in range(min(gaps, 14))]
        assert any(tuple(s[k : k + n]) in forms for k in range(len(s) - n + 1))
        if sum(s) >= least - 1:
            assert sum(tuple(s[k : k + n]) in forms for k in range(len(s) - n + 1)) >= leakage.seeds_agreeing(pats, least)


def test_leaks_in_shards_and_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    passages = [" ".join(rnd.choices([f"w{i}" for i in range(6)], k=35)) for _ in range(12)]
    texts = [" ".join(rnd.sample(passages, 2)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id bigint, passage string")
    got = [{tuple(r) for r in leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "passage", most=m).collect()} for m in (10**6, 300)]
    assert got[0] == got[1] == brute_leaks(texts, passages, 30)
    index = leakage.ItemIndex(range(12), passages, 30)
    whole = leakage.leaks(texts, index, 30)[1]
    monkeypatch.setattr(leakage, "BLOCK", 7)
    assert leakage.leaks(texts, index, 30)[1] == whole


def test_removal_leaves_the_rest_as_it_is(spark):
    p = " ".join(f"cuvânt{i}" for i in range(32))
    text = "ﬁe\u0000ce ﬂuviu: " + p.replace("cuvânt3 ", "ﬁn ") + " ﬁnal\u0000."
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, p)], "item_id bigint, passage string")
    assert leakage.remove_leaks(docs, "text", items, "item_id", "passage").first().clean_text == "ﬁe\u0000ce ﬂuviu:  ﬁnal\u0000."


def test_sentences():
    w = words_of(["Conform art. 5 alin. (2), nu. Da! Așa e?\n\nCapitol nou\nrând. mic", None, "Al doilea. „Citat.” Fin"])
    s = subjects.sentences_of(w)
    assert [int((s == k).sum()) for k in range(int(s[-1]) + 1)] == [6, 1, 2, 4, 2, 1, 1]
    assert len(subjects.sentences_of(words_of([]))) == 0


@pytest.mark.parametrize(
    ("held", "least"),
    [
        (lambda i, k: i // k % 5 == 0, 0.9),  # the samples go round the subjects: whole rounds, each subject loses alike
        (lambda i, k: i % 3 == 0, 0.8),
        (lambda i, k: i % 4 == 0, 0.5),  # half of the samples of five subjects, none of the others
    ],
)
def test_held_out_subjects(spark, data_dir, held, least):
    """Accuracy on samples that neither the first nor the widened models have seen."""
    larger = os.path.join(os.path.dirname(data_dir), "sf0.01")
    d = larger if os.path.isdir(larger) else data_dir
    rows = sorted(table(spark, d, "subject_samples").select("sample_id", "text", "subject").collect())
    names = sorted({r.subject for r in rows})
    out = [held(i, len(names)) for i in range(len(rows))]
    train = spark.createDataFrame([r for r, o in zip(rows, out, strict=True) if not o], "sample_id bigint, text string, subject string")
    test = [r for r, o in zip(rows, out, strict=True) if o]
    m = subjects.train_models(subjects.tokenised(table(spark, d, "documents"), None, "text"), train, "text", "subject", names)
    areas = subjects.document_areas(m, subjects.tokens_of([r.text for r in test]), subjects.SHARE)
    assert subjects.LOWEST <= m.accept.min() and m.accept.max() < 0.3 and len(set(m.accept.tolist())) > 1
    assert np.mean([a == [r.subject] for r, a in zip(test, areas, strict=True)]) >= (least if d == larger else 0.5)


def test_areas_edges(spark, data_dir):
    samples, subs = table(spark, data_dir, "subject_samples"), table(spark, data_dir, "subjects")
    fiscal = " ".join(r.text for r in samples.where("subject = 'fiscal'").select("text").collect())
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, fiscal), (4, fiscal), (5, "Anexa nr. 3 face parte integrantă.")], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in subjects.find_areas(docs, "doc_id", "text", samples, subs, rounds=1).collect())
    assert got == [(4, "fiscal"), (4, "fiscal")]
    assert subjects.find_areas(docs.limit(0), "doc_id", "text", samples, subs, rounds=1).count() == 0


COLUMNS = {
    "p1_found": [("corpus_id", "bigint")],
    "p2_found": [("name_a", "string"), ("name_b", "string")],
    "p3_found": [("group_id", "bigint"), ("source_id", "bigint"), ("confidence_id", "bigint"), ("article_id", "bigint")],
    "p4_found": [("tbl", "string"), ("row_id", "bigint"), ("fld", "string")],
    "p6_found": [("tbl", "string"), ("row_id", "bigint"), ("fld", "string"), ("target", "string")],
    "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p9_found": [("doc_id", "bigint"), ("subject", "string")],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries(spark, data_dir, name):
    df = queries.queries()[name](spark, data_dir)
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    sql = queries.oracle_sql().get(name)
    if sql:
        assert differing(df, connect(data_dir), sql) == ""
    else:
        assert df.count() > 0


def test_the_rest_stands_alone(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(os.path.join(root, "lexgraph"), tmp_path / "lexgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p5_found' in q and 'p1_found' not in q and e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
