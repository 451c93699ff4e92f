"""References to acts, by law_id or by citation in words, as composite keys; JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import unclash
from .chars import fold

# How the four kinds of act are cited, after folding (lower case, no accents).
ACT_FORMS: dict[str, str] = {
    "lege": r"leg(?:ea|ii|e)(?:-cadru)?",
    "oug": r"ordonant(?:ei|a|e) de urgenta(?: a guvernului)?|o ?\. ?u ?\. ?g ?\.?|oug",
    "og": r"ordonant(?:ei|a|e)(?: a)?(?: guvernului)?|o ?\. ?g ?\.?|og",
    "hg": r"hotarar(?:ea|ii|e)(?: (?:de guvern|a guvernului|guvernului))?|h ?\. ?g ?\.?|hg",
}
_NUMBER = r"\s*(?:(?:nr|numarul)\b\.?)?\s*([0-9][0-9.]*)\s*(?:/|\bdin\b)\s*([0-9]{4})(?![0-9])"
_REFERENCE = (
    r"(?s)^(?:(lege|oug|og|hg)_([0-9]+)_([0-9]{4})$|("
    + "|".join(ACT_FORMS[k] for k in ("lege", "oug", "og", "hg"))
    + f"){_NUMBER}.*)"
)
_MARK = "\u0001"


def folded_reference(c: Column) -> Column:
    """The fold of a value with white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(fold(c), r"\s+", " "))


def with_act_key(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds struct(act_type, number, year) of a reference, NULL where it names no act.

    A law_id must be the whole value; a citation in words must begin it. Thousands dots are
    dropped. NULL and empty values give NULL. A plain law_id is taken apart as it stands, and a value
    without a digit cites nothing; only the others are folded and matched. The steps are separate projections, so that the
    planner computes the fold and the match once per row.
    """
    f, p = unclash(df, "_folded", "_parts")
    c = F.col(value)
    plain = c.rlike(r"\A(?:lege|oug|og|hg)_[0-9]+_[0-9]{4}\z")
    form = F.col(p)[0]
    act_type = (
        F.when(form.startswith("l"), "lege")
        .when(form.startswith("h"), "hg")
        .when(form.rlike("urgenta|u"), F.when(form.startswith("ord") & ~form.contains("urgenta"), "og").otherwise("oug"))
        .otherwise("og")
    )
    return (
        df.withColumn(f, folded_reference(F.when(~plain & c.rlike(r"\p{Nd}"), c)))
        .withColumn(p, F.split(F.regexp_replace(F.col(f), _REFERENCE, f"$1$4{_MARK}$2$5{_MARK}$3$6"), _MARK))
        .withColumn(
            out,
            F.when(plain, F.struct(*(F.substring_index(x, "_", n).alias(name) for x, n, name in ((c, 1, "act_type"), (F.substring_index(c, "_", 2), -1, "number"), (c, -1, "year"))))).when(
                F.size(p) == 3,
                F.struct(act_type.alias("act_type"), F.replace(F.col(p)[1], F.lit("."), F.lit("")).alias("number"), F.col(p)[2].alias("year")),
            ),
        )
        .drop(f, p)
    )


def key_to_id(key: Column) -> Column:
    """The law_id of an act key."""
    return F.when(key.isNotNull(), F.concat_ws("_", key["act_type"], key["number"], key["year"]))


def law_id_key(law_id: Column) -> Column:
    """struct(act_type, number, year) of a stored law_id; one of another shape keeps its text in act_type, with a NULL number and year."""
    shape = r"^([a-z]+)_([0-9]+)_([0-9]{4})$"
    return F.when(
        law_id.rlike(shape),
        F.struct(*(F.regexp_extract(law_id, shape, i).alias(n) for i, n in ((1, "act_type"), (2, "number"), (3, "year")))),
    ).when(law_id.isNotNull(), F.struct(law_id.alias("act_type"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("year")))
