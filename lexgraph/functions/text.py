"""Normalisation of legal text as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import EDGE_PUNCTUATION, MONTHS, RELATION_SYNONYMS, RELATIONS

# How the line of the official gazette is written.
GAZETTE = r"(?iU)MONITORUL\s+OFICIAL\s+nr\.?\s*[0-9][0-9.]*\s+din\s+(?:data\s+(?:de\s+)?)?[0-9]{1,2}\s+\p{L}+\s+[0-9]{4}"

# Combining marks, and the ranges around the other characters that composition changes (Greek, Indic, Tibetan, Hebrew, Hangul, spaces, signs, compatibility ideographs).
_UNCOMPOSED = r"[\p{M}\u0374\u037E\u0387\u0958-\u095F\u09DC-\u09DF\u0A33-\u0A5E\u0B5C-\u0B5D\u0F43-\u0F69\u1160-\u11FF\u1F00-\u1FFF\u2000\u2001\u2126\u212A\u212B\u2329\u232A\u2ADC\uF900-\uFAFF\uFB1D-\uFB4E\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1F}]"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))


def nfc(c: Column) -> Column:
    """Composed characters; only values with a combining mark, or a character that is replaced or joined without one, leave the JVM."""
    return F.coalesce(_nfc(F.when(c.rlike(_UNCOMPOSED), c)), c)


def comma_below(c: Column) -> Column:
    """The old cedilla letters in their comma-below forms."""
    return F.translate(c, "şŞţŢ", "șȘțȚ")


def strip_gazette_header(c: Column) -> Column:
    """Drops everything through the first line that names the official gazette's number and date; unchanged without one."""
    line = f"(?s)^.*?{GAZETTE}[^\\n]*\\n*"
    return F.when(c.rlike(GAZETTE), F.regexp_replace(c, line, "")).otherwise(c)


def tidy_whitespace(c: Column) -> Column:
    """No blanks at line ends, at most one empty line in a row, none at the edges."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+(?=\n|\z)", ""), r"\n{3,}", "\n\n"), r"(?U)\A[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def normalize_ro(c: Column) -> Column:
    """A law text ready for segmentation: composed, comma-below, without gazette header and stray white space. NULL stays NULL."""
    return tidy_whitespace(strip_gazette_header(comma_below(nfc(c))))


def strip_accents(c: Column) -> Column:
    """Base letters of Latin letters with marks."""
    return F.translate(c, *accent_tables())


@lru_cache(maxsize=1)
def accent_tables() -> tuple[str, str]:
    """Letters with marks (and then the marks themselves, which vanish), and their base letters."""
    src, dst = [], []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and d[0].isascii():
            src.append(chr(cp))
            dst.append(d[0])
    return "".join(src) + "".join(chr(x) for x in range(0x300, 0x370)), "".join(dst)


def norm_key(c: Column) -> Column:
    """Lookup key: no accents, lower case, single spaces, no punctuation at the edges. An empty key for blank values."""
    spaced = F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"(?U)\s+", " "))
    return F.btrim(spaced, F.lit(EDGE_PUNCTUATION))


def ro_date(day: Column, month: Column, year: Column) -> Column:
    """ISO date of a day, a Romanian month name and a year; an unknown month gives the first of January."""
    m = F.lower(F.trim(month))
    number = reduce(lambda acc, p: acc.when(m == p[1], f"{p[0]:02d}"), enumerate(MONTHS, 1), F.when(F.lit(False), ""))
    return F.when(number.isNull(), F.concat(year, F.lit("-01-01"))).otherwise(F.concat_ws("-", year, number, F.lpad(F.trim(day), 2, "0")))


# How titles begin, and the act type each means.
_TITLE_TYPES = (  # longest first, so that an emergency ordinance is no ordinance
    (r"^ORDONANȚĂ\s+DE\s+URGENȚĂ", "Ordonanță de urgență"),
    (r"^ORDONANȚĂ", "Ordonanță"),
    (r"^HOTĂRÂRE", "Hotărâre de guvern"),
    (r"^LEGE", "Lege"),
    (r"^DECRET", "Decret"),
    (r"^CONSTITUȚIA", "Constituția"),
)


def header_meta(text: Column) -> Column:
    """struct(tip_act, numar, an, titlu, emitent, data_act, data_publicare, monitorul_oficial_nr) of a law text's first 15 non-empty lines.

    A missing field is NULL; NULL and empty texts give a struct of NULLs.
    """
    lines = F.slice(F.filter(F.transform(F.split(comma_below(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\([*]+[^)]*[*]+\)", ""))), lambda x: x != ""), 1, 15)
    joined = F.array_join(lines, "\n")
    first = F.get(lines, F.lit(0))
    tip = reduce(lambda acc, p: acc.when(F.upper(first).rlike("(?U)" + p[0]), p[1]), _TITLE_TYPES, F.when(F.lit(False), ""))
    dated = r"(?iU)\bdin\s+(?:data\s+de\s+)?([0-9]{1,2})\s+(\p{L}+)\s+([0-9]{4})"
    gazette = r"(?iU)MONITORUL\s+OFICIAL\s+nr\.?\s*([0-9][0-9.]*)\s+din\s+(?:data\s+(?:de\s+)?)?([0-9]{1,2})\s+(\p{L}+)\s+([0-9]{4})"
    code = r"(?iU)\(\s*Legea\s+nr\.?\s*([0-9]+)/([0-9]{4})\s*\)"
    head3 = F.array_join(F.slice(lines, 1, 3), "\n")

    def found(source: Column, pattern: str, group: int) -> Column:
        return F.when(source.rlike(pattern), F.regexp_extract(source, pattern, group))

    issuer_at = F.array_position(F.transform(lines, lambda x: F.upper(x)), "EMITENT")
    return F.struct(
        tip.alias("tip_act"),
        F.coalesce(found(first, r"(?iU)\bnr\.?\s*([0-9]+)", 1), found(head3, code, 1)).alias("numar"),
        F.coalesce(found(first, dated, 3), found(head3, code, 2)).alias("an"),
        F.get(lines, F.lit(1)).alias("titlu"),
        F.when(issuer_at > 0, F.get(lines, issuer_at.cast("int"))).alias("emitent"),
        F.when(first.rlike(dated), ro_date(F.regexp_extract(first, dated, 1), F.regexp_extract(first, dated, 2), F.regexp_extract(first, dated, 3))).alias("data_act"),
        F.when(joined.rlike(gazette), ro_date(F.regexp_extract(joined, gazette, 2), F.regexp_extract(joined, gazette, 3), F.regexp_extract(joined, gazette, 4))).alias("data_publicare"),
        found(joined, gazette, 1).alias("monitorul_oficial_nr"),
    )


def roman_to_int(c: Column) -> Column:
    """Value of an upper-case Roman numeral, -1 for anything else; NULL stays NULL."""
    values = F.create_map(*(x for k, v in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in (F.lit(k), F.lit(v))))
    digits = F.reverse(F.filter(F.split(c, ""), lambda x: x != ""))
    total = F.aggregate(
        digits,
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("prev")),
        lambda a, d: F.struct(
            F.when(F.element_at(values, d) < a["prev"], a["total"] - F.element_at(values, d)).otherwise(a["total"] + F.element_at(values, d)).alias("total"),
            F.greatest(F.element_at(values, d), a["prev"]).alias("prev"),
        ),
        lambda a: a["total"],
    )
    return F.when(c.isNull(), None).when(c.rlike("^[IVXLCDM]+$"), total).otherwise(-1)


def normalize_relation(c: Column) -> Column:
    """The vocabulary entry of a relation by itself or by a synonym, else NULL."""
    key = F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))
    known = F.create_map(*(F.lit(x) for r in RELATIONS for x in (r, r)), *(F.lit(x) for k, v in RELATION_SYNONYMS.items() for x in (k, v)))
    return F.try_element_at(known, key)
