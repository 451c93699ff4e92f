"""Citations and entities resolved to identifiers by joins with an alias dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ACT_PREFIX, CODE_NAMES, EDGE_PUNCTUATION, LAW_ID_SHAPE, LAW_WORDS
from ..functions.text import comma_below, nfc, norm_key
from ..runtime import unclash


def act_prefix(tip: Column) -> Column:
    """Identifier prefix of an act type: by its whole key, else by its first word, else NULL."""
    known = F.create_map(*(F.lit(x) for k, v in ACT_PREFIX.items() for x in (k, v)))
    key = norm_key(tip)
    return F.coalesce(F.try_element_at(known, key), F.try_element_at(known, F.get(F.split(key, " "), F.lit(0))))


# The textual forms of an act by prefix; N and Y stand for its number and year.
CITATION_FORMS = {
    "lege": ("legea nr. N/Y", "legea N/Y", "lege nr. N/Y"),
    "oug": ("ordonanta de urgenta nr. N/Y", "ordonanta de urgenta a guvernului nr. N/Y", "oug nr. N/Y", "o.u.g. nr. N/Y", "o.u.g. N/Y"),
    "og": ("ordonanta nr. N/Y", "ordonanta guvernului nr. N/Y", "og nr. N/Y", "o.g. nr. N/Y"),
    "hg": ("hotararea nr. N/Y", "hotararea guvernului nr. N/Y", "hg nr. N/Y", "h.g. nr. N/Y", "h.g. N/Y"),
    "decret": ("decretul nr. N/Y", "decret nr. N/Y"),
}


def alias_dim(meta: DataFrame) -> DataFrame:
    """(key, law_id): each registered act by its identifier, its textual forms and its declared aliases.

    A key claimed by several acts goes to the smallest identifier, so the result does not depend on
    the order of registration. Extra columns are ignored; aliases may be absent.
    """
    declared = F.coalesce(F.col("aliases"), F.array().cast("array<string>")) if "aliases" in meta.columns else F.array().cast("array<string>")
    prefix = act_prefix(F.col("tip_act"))
    forms = F.array().cast("array<string>")
    for p, texts in CITATION_FORMS.items():
        filled = F.array(*(F.replace(F.replace(F.lit(t), F.lit("N"), F.col("numar")), F.lit("Y"), F.col("an")) for t in texts))
        forms = F.when(prefix == p, filled).otherwise(forms)
    named = F.when(F.col("numar").isNotNull() & F.col("an").isNotNull(), forms).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.array("law_id"), named, declared)
    return meta.where(F.col("law_id").isNotNull()).select(F.explode(keys).alias("k"), "law_id").select(norm_key(F.col("k")).alias("key"), "law_id").where("key <> ''").groupBy("key").agg(F.min("law_id").alias("law_id"))


# Forms from which an identifier can be made.
SYNTH = (
    ("oug", r"^(?:ordonanta de urgenta(?: a guvernului)?|o\.?\s?u\.?\s?g\.?)"),
    ("og", r"^(?:ordonanta(?: a? ?guvernului)?|o\.?\s?g\.?)"),
    ("hg", r"^(?:hotararea? (?:a |de )?guvern(?:ului)?|h\.?\s?g\.?)"),
    ("lege", r"^(?:legea|lege)"),
)
NUMBER = r"\s*(?:nr\.?)?\s*([0-9][0-9.]*)\s*/\s*([0-9]{4})$"


def synthesize(key: Column) -> Column:
    """Identifier of a well-formed citation of an unregistered act (its whole key), thousands dots dropped; else NULL."""
    out = F.when(F.lit(False), "")
    for prefix, form in SYNTH:
        p = form + NUMBER
        out = out.when(key.rlike(p), F.concat_ws("_", F.lit(prefix), F.replace(F.regexp_extract(key, p, 1), F.lit("."), F.lit("")), F.regexp_extract(key, p, 2)))
    return out


def code_name(key: Column) -> Column:
    known = F.create_map(*(F.lit(x) for k, v in CODE_NAMES.items() for x in (k, v)))
    return F.try_element_at(known, key)


def resolve(df: DataFrame, col: str, aliases: DataFrame | None, out: str = "resolved") -> DataFrame:
    """Adds the identifier of a citation: itself, else a registered alias, else a named code, else synthesized, else NULL.

    The alias dimension meets the rows in one left join; the planner broadcasts it only when its
    size is below the session's threshold. Slashes are compared without blanks around them.
    """
    k, raw, a = unclash(df, "_key", "_raw", "_alias")
    keyed = df.withColumn(k, F.regexp_replace(norm_key(comma_below(F.col(col))), r"\s*/\s*", "/")).withColumn(k, F.regexp_replace(k, r"\bnr\.?\s*(?=[0-9])", "nr. "))
    keyed = keyed.withColumn(raw, F.trim(F.lower(F.col(col))))
    if aliases is not None:
        dim = aliases.select(F.col("key").alias(f"{k}2"), F.col("law_id").alias(a))
        keyed = keyed.join(dim, F.col(k) == F.col(f"{k}2"), "left").drop(f"{k}2")
    else:
        keyed = keyed.withColumn(a, F.lit(None).cast("string"))
    literal = F.when(F.col(raw).rlike(LAW_ID_SHAPE), F.col(raw))
    return keyed.withColumn(out, F.coalesce(literal, F.col(a), code_name(F.col(k)), synthesize(F.col(k)))).drop(k, raw, a)


def known_law_ids(meta: DataFrame) -> DataFrame:
    """(law_id) of every registered act, once."""
    return meta.where(F.col("law_id").isNotNull()).select("law_id").distinct()


def latest_meta(meta: DataFrame) -> DataFrame:
    """One registration of each act: the latest, then the one of the greatest meta_id (where the columns exist); a combinable maximum."""
    order = [F.col(c) for c in ("registered_at", "meta_id") if c in meta.columns] or [F.lit(0)]
    whole = F.struct(*meta.columns)
    return meta.where(F.col("law_id").isNotNull()).groupBy(F.col("law_id").alias("_id")).agg(F.max_by(whole, F.struct(*order)).alias("_m")).select("_m.*")


def get_meta(meta: DataFrame, law_id: str) -> DataFrame:
    """The latest registration of one act: one row, none for an unknown act."""
    return latest_meta(meta.where(F.col("law_id") == law_id))


# Characters that count as blanks in entities, besides white space.
_BLANKS = r"[\u200b-\u200f\u2060\ufeff\u00a0]"


def cleaned(c: Column) -> Column:
    """Composed, comma-below, single ordinary spaces, no punctuation at the edges."""
    spaced = F.regexp_replace(F.regexp_replace(comma_below(nfc(c)), _BLANKS, " "), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.btrim(spaced, F.lit(EDGE_PUNCTUATION))


def surface_form(c: Column) -> Column:
    """Display form of an entity that is no known act: a leading law word capitalised; in one with a number the blanks around 'nr.' and '/' even, and no mark after the law word."""
    numbered = c.rlike(r"(?U)\d")
    even = F.regexp_replace(F.regexp_replace(c, r"(?iU)\bnr\s*\.\s*", "nr. "), r"(?U)\s*/\s*", "/")
    base = F.when(numbered, even).otherwise(c)
    first = F.substring_index(base, " ", 1)
    word = F.when(numbered, F.rtrim(F.lower(first), F.lit(".,"))).otherwise(F.lower(first))
    titled = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)), F.substring(base, F.length(first) + 1, F.length(base)))
    return F.when(word.isin(list(LAW_WORDS)), titled).otherwise(base)


def canonicalize(df: DataFrame, cols: list[str], aliases: DataFrame | None) -> DataFrame:
    """Entity columns in canonical form: an identifier where the value names an act, else its display form.

    Identifiers, the hottest values, are canonical as they stand and take no part. The distinct other
    values of all columns are resolved once and joined back, so the cost of the regular expressions
    follows the entities and not the rows; rows without such a value are spread over the join's
    tasks, and other hot values are left to adaptive skew handling. NULL stays NULL.
    """
    values = df.select(F.explode(F.array(*cols)).alias("_v")).where(F.col("_v").isNotNull() & ~F.col("_v").rlike(LAW_ID_SHAPE)).distinct()
    known = resolve(values.withColumn("_c", cleaned(F.col("_v"))), "_c", aliases, "_id").select("_v", F.coalesce("_id", surface_form(F.col("_c"))).alias("_canon"))
    out = df
    aside = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*(F.col(c) for c, t in df.dtypes if not t.startswith("map"))), F.lit(4096)).cast("string"))
    for i, c in enumerate(cols):
        k = unclash(out, "_k")[0]
        one = known.select(F.col("_v").alias(f"_v{i}"), F.col("_canon").alias(f"_canon{i}"))
        keyed = out.withColumn(k, F.when(F.col(c).isNull() | F.col(c).rlike(LAW_ID_SHAPE), aside).otherwise(F.col(c)))
        out = keyed.join(one, F.col(k) == F.col(f"_v{i}"), "left").withColumn(c, F.coalesce(f"_canon{i}", c)).drop(f"_v{i}", f"_canon{i}", k)
    return out


# How a text speaks of itself, with and without diacritics.
ANAPHORA = r"^(?:prezent[au]l?|hot[ăa]r[âa]rea|legea|ordonan[țt]a|codul)(?:[^\p{L}\p{N}_\n].*)?$"
EXPLICIT = r"\p{Nd}|(?:^|[^\p{L}\p{N}_])nr\."


def resolve_anaphora(df: DataFrame, law: Column, cols: tuple[str, ...] = ("head", "tail")) -> DataFrame:
    """Cells that mean the current act ('prezenta lege', 'legea') and carry no number become its identifier; without one nothing changes."""
    out = df
    for c in cols:
        own = F.col(c).rlike("(?iud)" + ANAPHORA) & ~F.col(c).rlike("(?iu)" + EXPLICIT) & law.isNotNull() & (law != "")
        out = out.withColumn(c, F.when(own, law).otherwise(F.col(c)))
    return out
