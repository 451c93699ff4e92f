"""Orphan references against a brute-force version, and their edge cases."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexgraph.functions.citations import with_act_key
from lexgraph.operators.orphans import find_orphans, orphan_report
from lexgraph.plans.references import act_references

REFS = "rid int, a string, b string, at timestamp, salt string"
REG = "a string, b string, s timestamp, e timestamp, note string"
T0 = datetime(2024, 1, 1)


def brute(refs, reg, match):
    out = set()
    for rid, a, b, at, _ in refs:
        key = (a, b)
        if all(k is None for k in key):
            continue
        if None in key and match == "simple":
            continue
        if None in key and match == "full":
            out.add((rid, "missing"))
            continue
        rows = [r for r in reg if all(k is None or k == r[i] for i, k in enumerate(key))]
        if not rows:
            out.add((rid, "missing"))
        elif at is None:
            continue
        elif all(r[2] is not None and r[2] > at for r in rows):
            out.add((rid, "late"))
        elif not any((r[2] is None or r[2] <= at) and (r[3] is None or at < r[3]) for r in rows):
            out.add((rid, "deleted"))
    return out


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_against_brute_force(spark, match):
    rnd = random.Random(5)
    day = lambda: T0 + timedelta(days=rnd.randrange(60))
    pick = lambda n: rnd.choice([None, *"abcdefgh"[:n]])
    reg = []
    for _ in range(40):
        s = rnd.choice([None, day(), day()])
        reg.append((pick(5), pick(5), s, rnd.choice([None, (s or T0) + timedelta(days=rnd.randrange(20))]), "x"))
    refs = [(i, pick(7), pick(7), rnd.choice([None, day(), day(), day()]), "s") for i in range(400)]
    got = find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(reg, REG), ["a", "b"], at="at", valid_from="s", valid_to="e", match=match)
    assert {(r.rid, r.orphan_kind) for r in got.collect()} == brute(refs, reg, match)


def test_repeated_rows_hot_key_and_empty_tables(spark):
    refs = spark.createDataFrame([(i % 3, "hot", "k", T0, str(i)) for i in range(300)], REFS)
    empty = spark.createDataFrame([], REG)
    got = find_orphans(refs, empty, ["a", "b"], at="at", valid_from="s", valid_to="e")
    assert got.count() == 300 and got.columns == [*refs.columns, "orphan_kind"]
    none = find_orphans(refs.limit(0), empty, ["a", "b"], at="at", valid_from="s", valid_to="e")
    assert none.count() == 0
    rep = orphan_report(got, ["a"]).collect()
    assert [(r.a, r.orphan_kind, r.n_refs) for r in rep] == [("hot", "missing", 300)]


def test_helper_names_may_clash(spark):
    refs = spark.createDataFrame([(1, "a", "b", T0, "s")], REFS).withColumn("_mask", F.lit(1)).withColumn("_SALT", F.lit(2))
    reg = spark.createDataFrame([("a", "b", T0 + timedelta(days=1), None, "n")], REG)
    row = find_orphans(refs, reg, ["a", "b"], at="at", valid_from="s", valid_to="e").collect()
    assert [(r.orphan_kind, r._mask, r._SALT) for r in row] == [("late", 1, 2)]


def test_unknown_match_is_refused(spark):
    with pytest.raises(ValueError):
        find_orphans(spark.createDataFrame([], REFS), spark.createDataFrame([], REG), ["a"], at="at", valid_from="s", valid_to="e", match="loose")


@pytest.mark.parametrize(
    ("text", "act"),
    [
        ("lege_53_2003", "lege_53_2003"),
        ("Legii nr. 1.234/2009", "lege_1234_2009"),
        ("legea nr. 9 / 2001", "lege_9_2001"),
        ("Legea nr.9 din 2001", "lege_9_2001"),
        ("O.U.G. nr. 5/2020", "oug_5_2020"),
        ("Ordonanței de urgență a Guvernului nr. 5/2020", "oug_5_2020"),
        ("ORDONANŢA GUVERNULUI nr. 7/1999", "og_7_1999"),
        ("Hotărârea de Guvern nr. 3.567/1997", "hg_3567_1997"),
        ("Ｈ．Ｇ． ｎｒ． ４/２００１", "hg_4_2001"),
        ("l​ege_2_2000", "lege_2_2000"),
        ("Нotărârea Guνernului nr. 1/2000", "hg_1_2000"),
        ("Directiva (UE) 2018/1233", None),
        ("art. 2^1", None),
        ("prezenta lege", None),
        ("", None),
        (None, None),
    ],
)
def test_citations(spark, text, act):
    row = with_act_key(spark.createDataFrame([(text,)], "v string"), "v", "k").select(F.concat_ws("_", "k.act_type", "k.number", "k.year").alias("id")).first()
    assert (row.id or None) == act


def test_references_of_triples(spark):
    t = spark.createDataFrame([(1, None, "Legea nr. 1/2000", T0), (2, "constitutia_romaniei", "nimic", None)], "triple_id bigint, law_id string, tail string, extracted_at timestamp")
    got = {(r.triple_id, r.fld, r.act_type, r.number, r.ym) for r in act_references(t).collect()}
    assert got == {(1, "tail", "lege", "1", "2024-01"), (2, "law_id", "constitutia_romaniei", None, None)}
