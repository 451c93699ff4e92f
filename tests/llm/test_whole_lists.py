"""Abbreviations in lists with many words of one letter."""

from __future__ import annotations

import pytest

from lexgraph.llm import vocabmap

MANY = ["Ministerul Energiei Regenerabile", "Casa Pensiilor Ocupaționale", "Oficiul pentru Tarife și Accize"] + [f"{w} {x}" for w in ("Magistratura", "Manualele", "Medicina", "Medicamentele", "Minele", "Camera", "Cabinetul", "Cadastrul", "Calea") for x in ("Euroregiunii", "Raionului", "Portului")]


@pytest.mark.parametrize(
    ("value", "entry"),
    [
        ("M. Energiei Regenerabile", "Ministerul Energiei Regenerabile"),
        ("C. Pensiilor Ocupaționale", "Casa Pensiilor Ocupaționale"),
        ("C. P. O.", "Casa Pensiilor Ocupaționale"),
        ("Regen., M. Energiei", "Ministerul Energiei Regenerabile"),
        ("M. Enregiei Regenerabile", "Ministerul Energiei Regenerabile"),
        ("Of. pt. Tarife și Acc.", "Oficiul pentru Tarife și Accize"),
        ("M. Sănătății", None),
    ],
)
def test_abbreviation_among_many_words(value, entry):
    assert vocabmap.EntryIndex(MANY).lookup(value) == entry


def test_seven_abbreviations():
    words = [f"{a}{b}xyz" for a in "bcdfghj" for b in "aeiou"]
    entry = " ".join(w for w in words if w[1] == "u")
    assert vocabmap.EntryIndex([entry, *words]).lookup("b. c. d. f. g. h. j.") == entry
