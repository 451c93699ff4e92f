"""Citations of acts in running text, with the relation their wording gives; column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import REGEX_CONFIDENCE
from ..functions.text import comma_below

_N = r"nr\.?\s*\d[\d.]*/\d{4}"
# The written forms of a citation, in the order in which they are tried; dots and blanks of short forms may be missing.
ACT_FORMS = (
    rf"Leg(?:ea|ii)(?:-cadru)?\s+{_N}",
    rf"Ordonanț(?:a|ei)\s+de\s+urgenț(?:ă|ei)\s+(?:a\s+Guvernului\s+)?{_N}",
    rf"O\.?\s*U\.?\s*G\.?\s*{_N}",
    rf"Ordonanț(?:a|ei)\s+(?:Guvernului\s+)?{_N}",
    rf"O\.?\s*G\.?\s*{_N}",
    rf"Hotărâr(?:ea|ii)\s+(?:Guvernului\s+)?{_N}",
    rf"H\.?\s*G\.?\s*{_N}",
    r"Codul\s+(?:fiscal|muncii|administrativ|civil|penal|de\s+procedur(?:ă|ei)\s+civil(?:ă|ei)|de\s+procedur(?:ă|ei)\s+penal(?:ă|ei))",
    r"Constituți(?:a|ei)\s+României",
)
ACT = "(?iU)(?:" + "|".join(ACT_FORMS) + ")"

# Verb stems and endings that name a relation.
_COMMON = ("ă", "area", "are", "at", "ată")
TRIGGERS: dict[str, tuple[str, tuple[str, ...]]] = {
    "modifică": ("modific", _COMMON),
    "completează": ("complet", ("ează", "area", "are", "at", "ată")),
    "abroga": ("abrog", _COMMON),
    "introduce": ("introduc", ("", "e", "ere", "erea")),
    "republică": ("republic", _COMMON),
    "aprobă": ("aprob", _COMMON),
    "transpune": ("transpun", ("e", "ere", "erea", "s", "să")),
}
_FORMS = {rel: f"{stem}(?:{'|'.join(sorted(ends, key=len, reverse=True))})" for rel, (stem, ends) in TRIGGERS.items()}
_ANY = "(?:" + "|".join(_FORMS.values()) + ")"
TRIGGER = rf"(?iU)\b{_ANY}\b"
COMPOUND = rf"(?iU)\b({_ANY})\s+(?:și|sau)\s+({_ANY})\b"
DEFAULT_RELATION = "face_referire_la"
WINDOW = 80

# What a citation of an act of each prefix must contain.
SELF_TOKENS = {"lege": "leg", "oug": "o.u.g|oug|ordonanț", "og": "o.g|ordonanț", "hg": "h.g|hotărâr", "decret": "decret"}


def relation_of(word: Column) -> Column:
    """The relation a trigger word names, NULL for any other word."""
    out = F.when(F.lit(False), "")
    for rel, form in _FORMS.items():
        out = out.when(word.rlike(f"(?iU)^{form}$"), rel)
    return out


_MARK = "\x01"


def scan(text: Column, *, window: int = WINDOW) -> Column:
    """array<struct(surface, before, after)> of the citations in a text: leftmost, not overlapping, with up to ``window`` characters on each side.

    One pass of the pattern marks the citations; each then takes the few pieces around it that can
    reach into its windows, so the cost is linear in text and citations.
    """
    parts = F.split(F.regexp_replace(F.translate(text, _MARK, " "), ACT, f"{_MARK}$0{_MARK}"), _MARK)
    near = 2 * (window // 10) + 3  # a citation has ten characters or more, so no window reaches further

    def one(p: Column, j: Column) -> Column:
        before = F.array_join(F.slice(p, F.greatest(j - near + 1, F.lit(1)), F.least(j, F.lit(near))), "")
        after = F.array_join(F.slice(p, j + 2, F.lit(near)), "")
        return F.struct(F.get(p, j).alias("surface"), F.right(before, F.lit(window)).alias("before"), F.left(after, F.lit(window)).alias("after"))

    # the pieces are bound as a variable of an outer lambda, else each citation would mark the text anew
    cited_at = lambda p: F.filter(F.transform(p, lambda _, j: j), lambda j: j % 2 == 1)
    return F.get(F.transform(F.array(parts), lambda p: F.transform(cited_at(p), lambda j: one(p, j))), F.lit(0))


def cited(docs: DataFrame, text: str, *, window: int = WINDOW) -> DataFrame:
    """One row per citation and relation: the columns of ``docs`` but the text, surface, relation.

    Within ``window`` characters, "A și B" names both relations and wins; else the nearest trigger
    does, the left one on a tie, its distance taken from its beginning; a trigger on the right that
    another act precedes does not count. Without a trigger the relation is the plain reference.
    """
    rest = [c for c in docs.columns if c != text]
    marked = docs.select(*rest, F.explode(scan(comma_below(F.col(text)), window=window)).alias("_m"))
    one = marked.select(*rest, F.col("_m.surface").alias("surface"), F.col("_m.before").alias("_l"), F.col("_m.after").alias("_r"))
    both = F.concat("_l", "surface", "_r")
    # a greedy prefix leaves the rightmost trigger
    one = one.withColumn("_c", F.regexp_extract(both, COMPOUND, 1)).withColumn("_c2", F.regexp_extract(both, COMPOUND, 2))
    rightmost = rf"(?siU)^(.*)\b({_ANY})\b"
    one = one.withColumn("_lw", F.regexp_extract("_l", rightmost, 2)).withColumn("_lat", F.length(F.regexp_extract("_l", rightmost, 1)))
    one = one.withColumn("_rw", F.regexp_extract("_r", TRIGGER, 0)).withColumn("_rat", F.regexp_instr("_r", F.lit(TRIGGER)) - 1).withColumn("_act", F.regexp_instr("_r", F.lit(ACT)) - 1)
    far = F.lit(1_000_000)
    ld = F.when(F.col("_lw") != "", F.length("_l") - F.col("_lat")).otherwise(far)
    rd = F.when((F.col("_rw") != "") & ((F.col("_act") < 0) | (F.col("_act") > F.col("_rat"))), F.col("_rat")).otherwise(far)
    nearest = F.when((ld == far) & (rd == far), F.lit(DEFAULT_RELATION)).when(ld <= rd, relation_of(F.col("_lw"))).otherwise(relation_of(F.col("_rw")))
    relations = F.when(F.col("_c") != "", F.array_distinct(F.array(relation_of(F.col("_c")), relation_of(F.col("_c2"))))).otherwise(F.array(nearest))
    return one.select(*rest, F.regexp_replace("surface", r"(?U)\s+", " ").alias("surface"), F.explode(relations).alias("relation"))


def is_self(law_id: Column, surface: Column, *, strict: bool = True) -> Column:
    """A citation of the current act: its number and year, and its kind.

    ``strict`` compares the whole number; without it 24/2026 is also found in 124/2026. An
    identifier of fewer than three parts cites nothing.
    """
    parts = F.split(law_id, "_")
    prefix, number, year = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    plain = F.replace(F.lower(surface), F.lit("."), F.lit(""))
    place = F.concat_ws("/", number, year)
    squeezed = F.regexp_replace(plain, r"\s*/\s*", "/")
    same = F.concat(F.lit(" "), F.regexp_replace(squeezed, "[^0-9/]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), place, F.lit(" "))) if strict else squeezed.contains(place)
    kind = F.lit(False)
    for p, tokens in SELF_TOKENS.items():
        hit = F.lit(False)
        for token in tokens.split("|"):
            hit = hit | F.lower(surface).contains(token)
        kind = kind | ((prefix == p) & hit)
    other = ~prefix.isin(list(SELF_TOKENS)) & F.lower(surface).contains(prefix)
    return F.coalesce((F.size(parts) >= 3) & same & (kind | other), F.lit(False))


def tagged(df: DataFrame) -> DataFrame:
    """The provenance of regular-expression triples."""
    return df.withColumn("source_method", F.lit("regex")).withColumn("confidence", F.lit(REGEX_CONFIDENCE))
