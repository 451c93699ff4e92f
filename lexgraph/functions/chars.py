"""Character tables and JVM-side folding shared by the text operators.

The tables are derived by rule from the Unicode database wherever a rule exists; only the
look-alike letters are listed by hand.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Greek and Cyrillic letters that look like a Latin letter.
LOOKALIKES: dict[str, str] = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικνορτυχϲϳ",
        "ABEZHIKMNOPTYXaeikvoptuxcj",
        strict=True,
    )
) | dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԚԜӀаеѕіјорсухһԛԝүӏԁɡ",
        "ABESIJKMHOPCTYXYQWIaesijopcyxhqwyldg",
        strict=True,
    )
)

# The old Romanian cedilla letters and their comma-below forms.
CEDILLA: dict[str, str] = dict(zip("şţŞŢ", "șțȘȚ", strict=True))

#: Blocks in which letters of the two look-alike scripts stand.
OTHER_SCRIPT_RANGES = (("Ͱ", "Ͽ"), ("Ѐ", "ԯ"), ("ᲀ", "᲏"), ("ἀ", "῿"))


@lru_cache(maxsize=1)
def _by_rule() -> tuple[str, str, dict[str, str], dict[str, str]]:
    """Invisible characters, space-like characters, width variants, joined and numeral letters."""
    invisible, spaces, width, joined = [], [], {}, {}
    for cp in range(0xA0, min(sys.maxunicode, 0xE01EF) + 1):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Cn":
            continue
        if cat == "Cf" or 0xFE00 <= cp <= 0xFE0F or cp == 0x034F:
            invisible.append(ch)
        elif cat == "Zs":
            spaces.append(ch)
        else:
            d = unicodedata.decomposition(ch)
            if d.startswith(("<wide>", "<narrow>")):
                width[ch] = unicodedata.normalize("NFKC", ch)
            elif d.startswith("<compat>") and cat in ("Ll", "Lu", "Lt", "Nl"):
                plain = unicodedata.normalize("NFKC", ch)
                if plain.isalpha() and all("LATIN" in unicodedata.name(c, "") for c in plain):
                    joined[ch] = plain
    return "".join(invisible), "".join(spaces), width, joined


def invisible() -> str:
    return _by_rule()[0]


def spaces() -> str:
    return _by_rule()[1]


def width_variants() -> dict[str, str]:
    return _by_rule()[2]


def joined_letters() -> dict[str, str]:
    return _by_rule()[3]


@lru_cache(maxsize=1)
def to_plain() -> dict[int, str]:
    """str.translate table of every context-free step of the consistent form."""
    t = {ord(k): v for k, v in (width_variants() | joined_letters() | CEDILLA).items()}
    t |= {ord(c): " " for c in spaces()}
    t |= {ord(c): "" for c in invisible()}
    return t


@lru_cache(maxsize=1)
def suspicious_class() -> str:
    """A Java and Python character class of every character that can break the consistent form."""
    chars = "".join(c for c in [*width_variants(), *joined_letters(), *CEDILLA, *spaces(), *invisible()] if ord(c) < 0x10000)
    points = sorted({ord(c) for c in chars} | set(range(0x300, 0x370)) | {cp for a, b in OTHER_SCRIPT_RANGES for cp in range(ord(a), ord(b) + 1)} | {ord("ɡ")})
    out, start, prev = [], points[0], points[0]
    for p in [*points[1:], None]:
        if p is not None and p == prev + 1:
            prev = p
            continue
        out.append(f"\\u{start:04X}" if start == prev else f"\\u{start:04X}-\\u{prev:04X}")
        start = prev = p
    return "[" + "".join(out) + "]"


def is_suspicious(c: Column) -> Column:
    """True where a value may not be in the consistent form; a JVM test that spares clean rows any Python."""
    return c.rlike(suspicious_class())


@lru_cache(maxsize=1)
def _fold_pairs() -> tuple[str, str]:
    src, dst, gone = [], [], list(invisible())
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and d[0].isascii():
            src.append(chr(cp))
            dst.append(d[0])
    for k, v in (LOOKALIKES | {k: v for k, v in width_variants().items() if len(v) == 1}).items():
        src.append(k)
        dst.append(v)
    for s in spaces():
        src.append(s)
        dst.append(" ")
    gone += [chr(cp) for cp in range(0x300, 0x370)]
    # astral characters would be two UTF-16 units in translate's tables
    keep = [(a, b) for a, b in zip(src, dst, strict=True) if ord(a) < 0x10000]
    return "".join(a for a, _ in keep) + "".join(c for c in gone if ord(c) < 0x10000), "".join(b for _, b in keep)


def fold(c: Column) -> Column:
    """Lower case, base letters, plain widths and spaces, no invisible characters; entirely in the JVM.

    Every look-alike becomes Latin, also in words wholly of another script, so this is a
    comparison key and not the consistent form. NULL stays NULL, an empty text stays empty.
    """
    src, dst, multi = fold_tables()
    wide = c
    for k, v in multi.items():
        wide = F.replace(wide, F.lit(k), F.lit(v))
    wide = F.when(c.rlike("[" + "".join(multi) + "]"), wide).otherwise(c)
    return F.lower(F.when(c.rlike("[^\\x00-\\x7F]"), F.translate(wide, src, dst)).otherwise(c))


def fold_tables() -> tuple[str, str, dict[str, str]]:
    """What ``fold`` translates: characters, their replacements (the rest are deleted), and the ones that become several."""
    src, dst = _fold_pairs()
    singles = {k: v for k, v in joined_letters().items() if len(v) == 1}
    return "".join(singles) + src, "".join(singles.values()) + dst, {k: v for k, v in joined_letters().items() if len(v) > 1}
