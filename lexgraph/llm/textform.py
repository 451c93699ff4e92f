"""Problem 4: one consistent form for visually identical texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chars
from ..runtime import unclash

#: Bound of the broadcast vocabulary; the most frequent spellings are kept, rarer ones fall to the table.
MAX_VOCABULARY = 20_000

_OTHER = "".join(f"{a}-{b}" for a, b in chars.OTHER_SCRIPT_RANGES) + "ɡ"
_HAS_OTHER = re.compile(f"[{_OTHER}]")
# Other Latin letters that a look-alike of the tables may stand for; the vocabulary decides.
AMBIGUOUS: dict[str, str] = {"Ι": "l", "І": "l", "Ӏ": "l", "ӏ": "I", "υ": "vy", "ν": "u", "ү": "v", "Ү": "V"}
#: A word is a run of letters and combining marks.
_WORD = re.compile(r"(?:[^\W\d_]|[̀-ͯ])+")
_HAS_LATIN = re.compile("[A-Za-zÀ-ɏḀ-ỿ]")
_PIECE = re.compile(r"\S+")


class SpellingTrie:
    """Vocabulary trie walked by a weighted edit automaton.

    Equal characters, look-alikes (each letter they may stand for), width variants and joined
    letters cost nothing, and so do ignorable characters of the token; any other insertion,
    deletion or substitution costs 1. With ``strange`` only characters of another script that
    no table knows may be substituted.
    """

    __slots__ = ("_root", "size")

    def __init__(self, spellings: Iterable[str]):
        self._root: dict = {}
        self.size = 0
        for rank, word in enumerate(spellings):
            node = self._root
            for ch in word:
                node = node.setdefault(ch, {})
            if "" not in node:
                node[""] = (rank, word)
                self.size += 1

    def __contains__(self, word: str) -> bool:
        node = self._root
        for ch in word:
            if (node := node.get(ch)) is None:
                return False
        return "" in node

    def match(self, token: str, budget: int = 0, *, strange: bool = False) -> str | None:
        """The cheapest vocabulary spelling within ``budget``; ties go to the earlier (more frequent) one."""
        token = unicodedata.normalize("NFC", token)
        frontier: dict[int, tuple[dict, int]] = {id(self._root): (self._root, 0)}
        for ch in token:
            forms = _forms(ch)
            unknown = strange and ch not in _KNOWN_OTHER and _HAS_OTHER.match(ch) is not None
            step: dict[int, tuple[dict, int]] = {}

            def reach(node: dict, cost: int, step: dict = step) -> None:
                old = step.get(id(node))
                if cost <= budget and (old is None or cost < old[1]):
                    step[id(node)] = (node, cost)

            for node, cost in frontier.values():
                for form in forms:
                    at: dict | None = node
                    for c in form:
                        at = at.get(c)
                        if at is None:
                            break
                    if at is not None:
                        reach(at, cost)
                if cost < budget and (unknown or not strange):
                    if not strange:
                        reach(node, cost + 1)
                    for c, child in node.items():
                        if c:
                            reach(child, cost + 1)
            if budget and not strange:
                self._open(step, budget)
            if not step:
                return None
            frontier = step
        ends = [(cost, *node[""]) for node, cost in frontier.values() if "" in node]
        return min(ends)[2] if ends else None

    @staticmethod
    def _open(step: dict, budget: int) -> None:
        queue = list(step.values())
        while queue:
            node, cost = queue.pop()
            if cost < budget:
                for c, child in node.items():
                    if c and (id(child) not in step or step[id(child)][1] > cost + 1):
                        step[id(child)] = (child, cost + 1)
                        queue.append((child, cost + 1))


@lru_cache(maxsize=4096)
def _forms(ch: str) -> tuple[str, ...]:
    """What a character may stand for at no cost; the empty string for an ignorable one."""
    plain = chars.to_plain().get(ord(ch), ch)
    if plain == "":
        return ("",)
    forms = {plain}
    base = unicodedata.normalize("NFD", plain)
    swapped = "".join(chars.LOOKALIKES.get(c, c) for c in base)
    if swapped != base:
        forms.add(unicodedata.normalize("NFC", swapped))
    forms.update(AMBIGUOUS.get(ch, ""))
    return tuple(sorted(forms))


def _by_table(word: str) -> str:
    """A word with Latin letters and look-alikes, all in Latin; one wholly of another script as it stands."""
    if not (_HAS_OTHER.search(word) and _HAS_LATIN.search(word)):
        return word
    d = unicodedata.normalize("NFD", word)
    d = "".join(chars.LOOKALIKES.get(c, c) for c in d)
    return unicodedata.normalize("NFC", d).translate(_CEDILLA)


_CEDILLA = {ord(k): v for k, v in chars.CEDILLA.items()}


def table_form(text: str) -> str:
    """The consistent form by the character tables alone."""
    out = text.translate(chars.to_plain())
    if not out.isascii():
        out = unicodedata.normalize("NFC", out).translate(_CEDILLA)
        if _HAS_OTHER.search(out):
            out = _WORD.sub(lambda m: _by_table(m[0]), out)
    return out


def consistent_text(text: str, trie: SpellingTrie, memo: dict[str, str] | None = None) -> str:
    """The consistent form of one text, word by word: by table where that gives a vocabulary spelling, else the spelling the automaton reaches, else by table."""
    memo = {} if memo is None else memo
    spaced = text.translate(_SPACES)

    def one(m: re.Match) -> str:
        token = m[0]
        if token.isascii():
            return token
        got = memo.get(token)
        if got is None:
            plain = table_form(token)
            if plain == token and not any(is_mixed(w[0]) for w in _WORD.finditer(token)):
                got = token
            else:
                # words apart, so that punctuation at a token's edge does not hide a spelling
                got = _WORD.sub(lambda w: _spell(w[0], trie), _merge_ignorable(token))
                if table_form(got) != got or len(got) < len(plain) // 2:
                    got = plain
            if len(memo) < 100_000:
                memo[token] = got
        return got

    return _PIECE.sub(one, spaced)


_SPACES = {ord(c): " " for c in chars.spaces()}
_IGNORABLE = {ord(c): "" for c in chars.invisible()}


def _merge_ignorable(token: str) -> str:
    return unicodedata.normalize("NFC", token.translate(_IGNORABLE))


_KNOWN_OTHER = frozenset(chars.LOOKALIKES) | frozenset(AMBIGUOUS)


def is_mixed(word: str) -> bool:
    """A word of Latin letters that holds a letter of another script."""
    return _HAS_OTHER.search(word) is not None and _HAS_LATIN.search(word) is not None


def _spell(word: str, trie: SpellingTrie) -> str:
    """The table's reading where it is a known spelling, else the spelling that the automaton reaches, else the table's reading.

    A look-alike of several letters (a Cyrillic I for I or l) is so decided by the vocabulary, and a
    letter of another script that no table knows costs one substitution by the letter of a known spelling.
    """
    plain = table_form(word)
    if plain == word and not is_mixed(word) or plain in trie:
        return plain
    unknown = sum(c not in _KNOWN_OTHER and _HAS_OTHER.match(c) is not None for c in unicodedata.normalize("NFC", word))
    return trie.match(word) or (unknown and is_mixed(plain) and trie.match(word, unknown, strange=True)) or plain


def is_consistent(text: str, form: str) -> bool:
    """Whether a value is in the consistent form: its form is itself, and no word in it is mixed (whatever its form could not resolve)."""
    return text == form and not (_HAS_OTHER.search(text) and any(is_mixed(m[0]) for m in _WORD.finditer(text)))


def form_udf(vocabulary: list[str]):
    """Pandas UDF string -> consistent form, NULL to NULL. The vocabulary travels with the function; each worker builds its trie once."""

    @F.pandas_udf(T.StringType())
    def consistent(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie, memo = SpellingTrie(vocabulary), {}
        for s in batches:
            yield s.map(lambda v: None if v is None else consistent_text(v, trie, memo))

    return consistent


def clean_vocabulary(df: DataFrame, cols: list[str], *, most: int = MAX_VOCABULARY) -> list[str]:
    """The ``most`` frequent words of the values that are surely in the consistent form, most frequent first.

    The count is distributed and combined on the map side; only the bounded head comes to the driver.
    """
    w = unclash(df, "w")[0]
    words = F.explode(F.flatten(F.array(*(F.when(~chars.is_suspicious(F.col(c)), F.split(F.col(c), r"[^\p{L}]+")).otherwise(F.array().cast("array<string>")) for c in cols))))
    counted = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols]).select(words.alias(w)).where(F.length(w) > 1).groupBy(w).count()
    return [r[0] for r in counted.orderBy(F.col("count").desc(), w).limit(most).collect()]


def with_form(df: DataFrame, col: str, out: str, vocabulary: list[str]) -> DataFrame:
    """Adds ``out``, the consistent form of ``col``.

    Values without any suspicious character are their own form and never leave the JVM; NULL
    stays NULL, an empty text stays empty, texts of any length are taken whole.
    """
    f = form_udf(vocabulary)
    c = F.col(col)
    return df.withColumn(out, F.coalesce(f(F.when(chars.is_suspicious(c), c)), c))


def find_inconsistent(df: DataFrame, id_col: str, cols: list[str], tbl: str, vocabulary: list[str]) -> DataFrame:
    """(tbl, row_id, fld, value, form) of each value that is not in the consistent form, mixed words of letters that no table and no spelling resolves included.

    One scan; only values with a suspicious character reach Python. NULLs and empty texts are
    consistent. Repeated rows are reported for each row.
    """
    fields = F.array(*(F.struct(F.lit(c).alias("fld"), F.col(c).alias("value")) for c in cols))
    values = df.select(F.col(id_col).alias("row_id"), F.explode(fields).alias("v")).select("row_id", "v.*").where(chars.is_suspicious(F.col("value")))

    def changed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, memo = SpellingTrie(vocabulary), {}
        for b in batches:
            b["form"] = [consistent_text(v, trie, memo) for v in b["value"]]
            yield b[[not is_consistent(v, f) for v, f in zip(b["value"], b["form"], strict=True)]]

    # a map and not a UDF with a filter, which the planner would compute twice
    return values.mapInPandas(changed, "row_id bigint, fld string, value string, form string").select(F.lit(tbl).alias("tbl"), "row_id", "fld", "value", "form")
