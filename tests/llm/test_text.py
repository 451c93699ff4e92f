"""Splitting, consistent form, encoding and their edge cases."""

from __future__ import annotations

import os
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexgraph.functions import chars
from lexgraph.llm import encoding, splitter, textform

PROSE = st.text(alphabet="ab .!?\n€șA1", max_size=3000)


@given(PROSE, st.integers(50, 400), st.integers(0, 20))
@settings(max_examples=60, deadline=None)
def test_pieces_put_together(text, limit, overlap):
    spans = splitter.cut(text, limit, overlap)
    if not text:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for s, e in spans:
        assert 0 < e - s <= limit
    for (_, e), (s, _) in zip(spans, spans[1:], strict=False):
        assert s == e - overlap


def brute_cost(text, limit, overlap):
    """Cheapest cuts by trying every chain of boundaries."""
    room = limit - overlap
    at, pen = splitter.boundaries(text, max(1, room // 8))
    cand = [(int(a), float(p)) for a, p in zip(at, pen, strict=True) if a > overlap] + [(len(text), 0.0)]
    share = (len(text) - overlap) / -(-(len(text) - overlap) // room)
    best = {}
    for j, (e, p) in enumerate(cand):
        options = [splitter.BALANCE * ((e - overlap - share) / share) ** 2] if e <= limit else []
        options += [best[i] + splitter.BALANCE * ((e - cand[i][0] - share) / share) ** 2 for i in range(j) if i in best and e - cand[i][0] <= room]
        if options:
            best[j] = min(options) + p
    return best[len(cand) - 1], cand, share


@given(st.text(alphabet="ab. A\n", min_size=300, max_size=900))
@settings(max_examples=30, deadline=None)
def test_cuts_are_the_cheapest(text):
    limit, overlap = 200, 20
    want, cand, share = brute_cost(text, limit, overlap)
    pen = dict(cand)
    spans = splitter.cut(text, limit, overlap)
    got, last = 0.0, overlap
    for _, e in spans:
        got += pen[e] + splitter.BALANCE * ((e - last - share) / share) ** 2
        last = e
    assert got == pytest.approx(want)


def test_cuts_prefer_articles():
    body = "Se prevede ceva. " * 60
    text = "".join(f"Articolul {i}\n{body}\n\n" for i in range(1, 8))
    spans = splitter.cut(text, 4000, 200)
    assert all(text[e:].startswith("Articolul") for _, e in spans[:-1])
    with pytest.raises(ValueError):
        splitter.cut("x" * 100, 10, 5)


def test_split_table_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n ", 0), (4, "x" * 4000, 0), (5, "x" * 4001, 0), (5, "x" * 4001, 0), (6, "𝄞" * 4000, 0)]
    df = spark.createDataFrame(rows, "corpus_id bigint, law_text string, start int")
    got = sorted((r.corpus_id, r.piece_no, r.n_pieces, len(r.piece)) for r in splitter.split_texts(df, "law_text").collect())
    assert [x for x in got if x[0] != 5] == [(3, 1, 1, 3), (4, 1, 1, 4000), (6, 1, 1, 4000)]
    five = [x for x in got if x[0] == 5]
    assert [x[1:3] for x in five] == [(1, 2), (1, 2), (2, 2), (2, 2)] and five[0][3] + five[2][3] == 4201
    assert [r.corpus_id for r in splitter.find_oversized(df).collect()] == [5, 5]
    assert splitter.split_texts(df.limit(0), "law_text").count() == 0
    assert "_start" in splitter.split_texts(df, "law_text").columns


CASES = [
    ("Ordonanţa", "Ordonanța"),
    ("Hota\u0306ra\u0302rea", "Hotărârea"),
    ("Ｌｅｇｅａ ｎｒ．５／２００１", "Legea nr.5/2001"),
    ("l​e­ge_1_2000﻿", "lege_1_2000"),
    ("Legea nr. 1　din 2", "Legea nr. 1 din 2"),
    ("Oﬁciul Ⅳ", "Oficiul IV"),
    ("Guνеrnuluі", "Guvernului"),
    ("lеgе_5_2001", "lege_5_2001"),
    ("ӑnа Mӑr", "ӑnа Măr"),
]


@pytest.mark.parametrize(("raw", "want"), CASES[:-1])
def test_table_form(raw, want):
    assert textform.table_form(raw) == want
    assert textform.consistent_text(raw, textform.SpellingTrie(["Guvernului", "Oficiul"])) == want


@pytest.mark.parametrize("same", ["", "Großbirk 5 m²", "„citat” – ½ pagină…", "Жудецул Дубровий", "László Ștefan", "café naïve", "判決"])
def test_what_is_consistent_stays(same):
    assert textform.table_form(same) == same


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_form_is_stable(text):
    once = textform.table_form(text)
    assert textform.table_form(once) == once
    assert not set(once) & set(chars.invisible())
    assert unicodedata.normalize("NFC", once) == once or "̈́" in text


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_clean_values_never_need_python(text):
    import re

    if not re.search(chars.suspicious_class(), text) and all(ord(c) < 0x10000 for c in text):
        assert textform.table_form(text) == text or unicodedata.normalize("NFC", text) != text


def test_trie_budget():
    t = textform.SpellingTrie(["lege", "legea", "loc"])
    assert t.match("lеge") == "lege" and t.match("lexe") is None
    assert t.match("lexe", 1) == "lege" and t.match("legeaa", 1) == "legea" and t.match("lc", 1) == "loc"


@pytest.mark.parametrize(
    ("raw", "by_vocabulary", "by_table"),
    [
        ("GuvernuІ României", "Guvernul României", "GuvernuI României"),
        ("Minisтeгul", "Ministerul", "Minisтeгul"),
        ("υerde", "verde", "uerde"),
        ("ＧuvernuӀ,", "Guvernul,", "GuvernuI,"),
        ("Іon", "Ion", "Ion"),
        ("lunar υniс", "lunar unic", "lunar unic"),
        ("Жудец Miniжter", "Жудец Miniжter", "Жудец Miniжter"),
    ],
)
def test_the_vocabulary_decides_what_the_table_cannot(raw, by_vocabulary, by_table):
    words = ["Guvernul", "Ministerul", "verde", "vnic", "unic", "Ion"]
    assert textform.consistent_text(raw, textform.SpellingTrie(words)) == by_vocabulary
    assert textform.consistent_text(raw, textform.SpellingTrie([])) == by_table


def test_unresolved_mixed_words_are_reported(spark):
    df = spark.createDataFrame([(1, "Miniжter"), (2, "Жудец"), (3, "Minisтeгul"), (4, "5 μ")], "triple_id bigint, head string")
    got = {r.row_id: r.form for r in textform.find_inconsistent(df, "triple_id", ["head"], "t", ["Ministerul"]).collect()}
    assert got == {1: "Miniжter", 3: "Ministerul"}


def test_find_inconsistent(spark):
    df = spark.createDataFrame([(1, "lege", None, 5), (2, "lеge", "Guvernul Roma\u0302niei", 5), (2, "lеge", "", 5)], "triple_id bigint, head string, tail string, value int")
    got = [(r.tbl, r.row_id, r.fld, r.form) for r in textform.find_inconsistent(df, "triple_id", ["head", "tail"], "t", ["lege"]).collect()]
    assert sorted(got) == [("t", 2, "head", "lege"), ("t", 2, "head", "lege"), ("t", 2, "tail", "Guvernul României")]
    formed = textform.with_form(df, "tail", "f", []).orderBy("triple_id", "f").collect()
    assert [r.f for r in formed] == [None, "", "Guvernul României"]
    assert textform.find_inconsistent(df.limit(0), "triple_id", ["head"], "t", []).count() == 0
    assert textform.clean_vocabulary(df, ["head", "tail"], most=3) == ["lege"]


needs_tokenizer = pytest.mark.skipif(not os.path.isfile(os.path.join(encoding.TOKENIZER_DIR, "byte_bpe_50k.tiktoken")), reason="no vocabulary files")


@needs_tokenizer
def test_encoding_round_trip_in_chunks(spark):
    texts = [None, "", " ", "<|endoftext|> ca text", "Ștefan's  \n\n\n vineyard — 12 m² 判決 👍🏽 don't", "a" * 700, " \n" * 300, ("cuvânt 12, " * 80) + "\n\n  x", "x" * 100 + " " * 200 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[4])], "doc_id bigint, text string")
    enc = encoding.encoder(os.path.join(encoding.TOKENIZER_DIR, "byte_bpe_50k.tiktoken"))
    want = sorted((i, tuple(enc.encode_ordinary(t or ""))) for i, t in [*enumerate(texts), (3, texts[4])])
    for chunk, lap in ((8192, 256), (64, 24), (50, 7)):
        got = encoding.encode_corpus(df, "doc_id", "text", chunk=chunk, lap=lap)
        assert sorted((r.doc_id, tuple(r.ids)) for r in got.collect()) == want
    back = encoding.decode(encoding.encode_corpus(df.where("doc_id <> 3"), "doc_id", "text"), "ids")
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts) if i != 3}
    assert encoding.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    assert encoding.subword_counts(got).agg(F.sum("n_docs")).first()[0] == len(texts) + 1


@needs_tokenizer
def test_both_libraries_agree():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(encoding.TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    enc = encoding.encoder(os.path.join(encoding.TOKENIZER_DIR, "byte_bpe_50k.tiktoken"))
    for text in ("Hotărârea nr. 5", "<|endoftext|>", "  două   spații \t\n", "it's 1999's"):
        assert t.encode(text, add_special_tokens=False).ids == enc.encode_ordinary(text)
