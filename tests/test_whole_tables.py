"""Queries over whole tables against brute force: every row and every character is used."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F

from lexgraph.functions import text as tx
from lexgraph.plans import queries as core
from lexgraph.runtime import table


def test_summary_of_every_act(spark, data_dir):
    acts = {r.corpus_id: r.law_text for r in table(spark, data_dir, "legislative_corpus").select("corpus_id", "law_text").collect()}
    assert any(t and re.search(r"[^\x00-\x7FăâîșțĂÂÎȘȚ]", t) for t in acts.values())
    got = {r.corpus_id: (r.n_chars, r.preview) for r in core.queries()["law_summary"](spark, data_dir).collect()}
    assert got == {i: (None, None) if t is None else (len(t), re.sub(r"[ \t\n\x0b\f\r]+", " ", t)[:60]) for i, t in acts.items()}


GAZETTE = re.compile(r"MONITORUL\s+OFICIAL\s+nr\.?\s*[0-9][0-9.]*\s+din\s+(?:data\s+(?:de\s+)?)?[0-9]{1,2}\s+[^\W\d_]+\s+[0-9]{4}", re.IGNORECASE)


def slow_normalize(t):
    if t is None:
        return None
    t = unicodedata.normalize("NFC", t)
    for a, b in zip("şŞţŢ", "șȘțȚ", strict=True):
        t = t.replace(a, b)
    if m := GAZETTE.search(t):
        t = t[m.end() :].partition("\n")[2].lstrip("\n")
    t = "\n".join(x.rstrip(" \t") for x in t.split("\n"))
    while "\n\n\n" in t:
        t = t.replace("\n\n\n", "\n\n")
    return t.strip()


def slow_windows(t, size, overlap):
    if t is None:
        return []
    if len(t) <= size:
        return [t]
    out, held = [], ""
    for p in t.split("\n\n"):
        joined = held + "\n\n" + p if held else p
        if len(p) > size:
            out += [held] if held else []
            held, at = "", 0
            while True:
                out.append(p[at : at + size])
                if at + size >= len(p):
                    break
                at += size - overlap
        elif len(joined) <= size:
            held = joined
        else:
            out.append(held)
            held = p
    return out + [held] if held else out


def test_normalised_texts_of_every_row(spark, data_dir):
    want = {("documents", r.doc_id): slow_normalize(r.text) for r in table(spark, data_dir, "documents").collect()}
    want |= {("legislative_corpus", r.corpus_id): slow_normalize(r.law_text) for r in table(spark, data_dir, "legislative_corpus").collect()}
    got = {(r.tbl, r.row_id): r.norm for r in core.queries()["norm_ro"](spark, data_dir).collect()}
    assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {} and len(got) == len(want)


def test_normalised_edges(spark):
    head = "LEGE nr. 1\nPublicat în MONITORUL OFICIAL nr. 12 din 3 mai 2001 ziua\n\n\n"
    texts = [None, "", " \n", "Å Ω \u212b \u2126", "a\u0306 s\u0327", head + "Previziuni şi  \t\n\n\n\nţinte", head, "\u00a0x\u2003\n", "a \t\r\n\n\n\nb\u2028 \nc \u0085", ("x" * 5000 + " \n\n\n") * 60 + head + "y" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.n for r in df.select("i", tx.normalize_ro(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [slow_normalize(t) for t in texts]


def test_windows_of_every_text(spark, data_dir):
    rows = table(spark, data_dir, "documents").select("doc_id", "text").collect()
    want = sorted((r.doc_id, i, w) for r in rows for i, w in enumerate(slow_windows(r.text, 1000, 100)))
    got = sorted((r.doc_id, r.window_no, r.window) for r in core.queries()["llm_windows"](spark, data_dir).collect())
    assert got == want
    assert any(len(r.text or "") > 1000 and "\n\n" in r.text for r in rows)


def slow_articles(t):
    """Articles by definition: the first longest strictly rising run of the prevailing headers, found by the quadratic recurrence."""
    if t is None or not t.strip():
        return []
    head = re.compile(r"^[ \t]*(?:(?:art|articolul)\.?[ \t]+(\d+(?:\^\d+)?|[ivxlcdm]+)\b|articol[ \t]+(unic)\b)[^\n]*$", re.I | re.M)
    met = [(m.start(), m.end(), m[1] or "unic") for m in head.finditer(t)]
    if not met:
        return [("full", t.strip())]
    if any(x == "unic" for _, _, x in met):
        met = [next(m for m in met if m[2] == "unic")]
    else:
        roman = [m for m in met if set(m[2]) <= set("IVXLCDM")]
        other = [m for m in met if m not in roman]
        met = roman if len(roman) > len(other) else other
        value = [sum(-v if any(w > v for w in vs[i + 1 : i + 2]) else v for i, v in enumerate(vs)) if (vs := [{"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.get(c, 0) for c in m[2]]) and m in roman else int(m[2].split("^")[0]) if m[2][0].isdigit() else -1 for m in met]
        best, back = [1] * len(met), [None] * len(met)
        for i in range(len(met)):
            for j in range(i):
                if value[j] < value[i] and best[j] + 1 > best[i]:
                    best[i], back[i] = best[j] + 1, j
        at, run = best.index(max(best)), []
        while at is not None:
            run.append(met[at])
            at = back[at]
        met = run[::-1]
    out = [("preambul", p)] if len(p := t[: met[0][0]].strip()) >= 40 else []
    for (_, e, label), nxt in zip(met, [m[0] for m in met[1:]] + [len(t)], strict=True):
        if body := t[e:nxt].strip():
            out.append((label, body))
    return out


def test_articles_of_every_act(spark, data_dir):
    from lexgraph.operators import segment

    rows = table(spark, data_dir, "legislative_corpus").select("corpus_id", "law_text").collect()
    want = {r.corpus_id: slow_articles(r.law_text) for r in rows}
    got: dict = {i: [] for i in want}
    for r in segment.split_into_articles(table(spark, data_dir, "legislative_corpus")).orderBy("corpus_id", "pos").collect():
        got[r.corpus_id].append((r.article_number, r.text))
    assert got == want and max(map(len, want.values())) > 3
