"""Problem 6: freely entered values mapped to the entries of a closed list."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import unclash
from .edits import damerau, fold_text

#: Lists of up to this many entries travel with the function; longer ones are sharded.
MAX_BROADCAST_ENTRIES = 5_000
UNMATCHED = "unmatched"
#: Letters from which on a word may hold two words of a list written together.
LONG = 14

# Other ways in which the relations of the vocabulary are named.
RELATION_ALIASES: dict[str, tuple[str, ...]] = {
    "emis_de": ("emisă de", "emise de", "emis", "emisă", "emis de către", "este emis de", "este emisă de", "emitent", "emitere de către", "issued by", "emis prin"),
    "promulgat_de": ("promulgată de", "este promulgat de", "este promulgată de", "promulgare de către", "promulgat de către", "promulgat", "promulgare", "promulgated by"),
    "publicat_în": ("publicată în", "publicate în", "publicat", "publicată", "publicare în", "apare în", "se publică în", "published in"),
    "modifică": ("modifică pe", "modificată", "modificat", "modifica", "se modifică", "modificare", "modificarea", "aduce modificări la", "aduce modificări", "amends", "modifies", "modificare la"),
    "completează": ("completată", "completată de", "completat", "completează pe", "se completează", "completare", "completare la", "aduce completări", "aduce completări la", "supplements", "completarea"),
    "abroga": ("abrogă", "abrogată", "abrogat", "se abrogă", "abrogare", "abrogarea", "scoate din vigoare", "repeals", "abrogă pe"),
    "introduce": ("se introduce", "introducere", "introducerea", "introduce articolul", "introduces", "introdus", "introdusă"),
    "republică": ("republicată", "republicat", "se republică", "republicare", "republicarea", "republishes"),
    "aprobă": ("aprobată", "aprobat", "se aprobă", "aprobare", "aprobarea", "aprobată prin", "aprobat prin", "approves"),
    "face_referire_la": ("se referă la", "referă la", "referire la", "face trimitere la", "trimite la", "trimitere la", "refers to", "face referire"),
    "intră_în_vigoare": ("intra în vigoare", "intră în vigoare la", "intrare în vigoare", "in vigoare de la", "intrarea în vigoare", "enters into force"),
    "are_sediul_în": ("sediu în", "sediul în", "cu sediul în", "sediul se află în", "are sediu în", "located in", "seated in"),
    "responsabil_pentru": ("responsabilă pentru", "răspunde de", "răspunzător pentru", "responsible for", "răspunde pentru", "responsabil de", "răspunzătoare pentru"),
    "colaborează_cu": ("colaborare cu", "cooperează cu", "lucrează împreună cu", "cooperare cu", "collaborates with", "cooperates with"),
    "se_aplică": ("se aplică pentru", "aplicabil la", "aplicare la", "aplicabil", "se aplică la", "applies to", "aplicabilă la"),
    "transpune": ("transpusă din", "transpus din", "transpunere a", "transpunere", "transpunerea", "preia prevederile", "transposes", "transpusă"),
}

_WORDS = re.compile(r"[a-z0-9]+")
_PARENS = re.compile(r"\([^()]*\)")
_CONNECTIVES = frozenset("a al ale de din in la pe pentru pt si".split())
# Words beside which a relation's own word stands in other forms (folded), and Romanian endings, longest first.
_LIGHT = _CONNECTIVES | frozenset("se este sunt e are au cu prin catre asupra unui unei o un face aduce".split())
_ENDINGS = ("eaza", "area", "erea", "irea", "abila", "abil", "are", "ere", "ire", "ari", "eri", "ata", "ate", "ati", "ita", "ite", "uta", "ute", "ului", "ilor", "elor", "at", "it", "ut", "ul", "ea", "ei", "ii", "le", "a", "e", "i", "u")


def stems(words: list[str]) -> tuple[str, ...]:
    """The words of a value without light ones and endings, sorted; a stem keeps four letters or more."""
    out = set()
    for w in words:
        if w not in _LIGHT:
            out.add(next((w[: -len(x)] for x in _ENDINGS if w.endswith(x) and len(w) - len(x) >= 4), w))
    return tuple(sorted(out))


def keyed(text: str) -> list[str]:
    """Folded words of a value: lower case, no accents, no punctuation, plain characters."""
    return _WORDS.findall(fold_text(text))


def _shortens(short: str, word: str) -> bool:
    """The letters of an abbreviation stand in the word in their order, the first one first."""
    if not word.startswith(short[:1]):
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def deletions(word: str, edits: int = 2) -> set[str]:
    """A word and its forms with up to ``edits`` characters deleted; two words within ``edits`` edits share one."""
    out = last = {word}
    for _ in range(edits):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


def radius(n: int) -> int:
    """Edits allowed for a key of ``n`` characters: none below 4, one below 12, two below 30, else three."""
    return 0 if n < 4 else 1 if n < 12 else 2 if n < 30 else 3


class BKTree:
    """Burkhard-Keller trees over strings under the unrestricted Damerau-Levenshtein metric, one tree per key length.

    No distance is below the difference of the lengths, so a search visits only the trees of
    near lengths; within a tree the triangle inequality prunes. Nor is it below the number of
    letters one string has beyond the other's, which spares most full computations.
    """

    def __init__(self) -> None:
        self._roots: dict[int, list] = {}

    def add(self, key: str) -> None:
        node = self._roots.setdefault(len(key), [key, {}, Counter(key)])
        while (d := damerau(key, node[0])) > 0:
            if d not in node[1]:
                node[1][d] = [key, {}, Counter(key)]
                return
            node = node[1][d]

    def within(self, key: str, most: int) -> list[tuple[int, str]]:
        """Every (distance, entry key) within ``most``."""
        found: list[tuple[int, str]] = []
        stack = [self._roots[n] for n in range(len(key) - most, len(key) + most + 1) if n in self._roots]
        letters = Counter(key)
        while stack:
            other, children, bag = stack.pop()
            if len(children) <= 4 and max((letters - bag).total(), (bag - letters).total()) > most:
                stack.extend(children.values())
                continue
            d = damerau(key, other)
            if d <= most:
                found.append((d, other))
            stack.extend(child for edge, child in children.items() if d - most <= edge <= d + most)
        return found


@dataclass
class EntryIndex:
    """Entries with their acronyms and other names, searchable within an edit radius."""

    entries: Sequence[str]
    acronyms: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, Sequence[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.exact: dict[str, tuple[int, str]] = {}
        self.short: dict[str, str] = {"".join(keyed(a)): e for a, e in sorted(self.acronyms.items(), reverse=True)}
        self.tree = BKTree()
        # form -> words, and the forms with each word, to which abbreviated values are matched
        self.by_word: dict[str, set[str]] = {}
        self.by_size: dict[int, set[str]] = {}
        for e in sorted(self.entries):
            words = keyed(e)
            for form in self._forms(words):
                self._put(form, 0, e)
        by_stems: dict[tuple[str, ...], set[str]] = {}
        for e in self.entries:
            by_stems.setdefault(stems(keyed(e)), set()).add(e)
        self.by_stems = {k: next(iter(v)) for k, v in by_stems.items() if k and len(v) == 1}
        for e in sorted(self.aliases):
            for a in self.aliases[e]:
                words = keyed(a)
                self._put(" ".join(words), 1, e)
        for key in sorted(self.exact):
            self.tree.add(key)
            words = key.split(" ")
            self.by_size.setdefault(len(words), set()).add(key)
            for w in words:
                self.by_word.setdefault(w, set()).add(key)
        self.deletions = {x for w in self.by_word if w not in _CONNECTIVES for x in deletions(w)}
        self.lone = any(" " not in k for k in self.exact)
        self._near: dict[str, bool] = {}
        self.by_letter: dict[str, list[str]] = {}
        for w in sorted(self.by_word):
            self.by_letter.setdefault(w[0], []).append(w)

    def _hopeful(self, reading: str) -> bool:
        """False where no key can be within three edits, so that the trees need not be searched.

        A word that is not within two edits of any word of the list takes three edits or more, unless
        it is part of a word torn apart (then its join with a neighbour is near one) or holds two words written together
        (LONG letters or more); two such words are too many. Values of one or two words, and lists with keys of one, are
        always searched. Nearness is decided by a symmetric-delete set over the list's words.
        """
        words = [w for w in reading.split(" ") if w not in _CONNECTIVES]
        if len(words) < 3 or self.lone:
            return True
        unknown = 0
        for n, w in enumerate(words):
            if len(w) < LONG and not self._is_near(w) and not any(self._is_near(x) for x in ("".join(words[n : n + 2]), "".join(words[max(n - 1, 0) : n + 1])) if x != w):
                unknown += 1
                if unknown > 1:
                    return False
        return True

    def _is_near(self, word: str) -> bool:
        near = self._near.get(word)
        if near is None:
            if len(self._near) > _MEMO_LIMIT:
                self._near.clear()
            near = self._near[word] = not self.deletions.isdisjoint(deletions(word))
        return near

    def _put(self, key: str, rank: int, entry: str) -> None:
        if key and (key not in self.exact or (rank, entry) < self.exact[key]):
            self.exact[key] = (rank, entry)

    @staticmethod
    def _forms(words: list[str]) -> list[str]:
        """A name as it stands, with its first word last, both without connectives, and its words sorted."""
        turned = words[1:] + words[:1]
        bare = [x for x in words if x not in _CONNECTIVES]
        return [" ".join(w) for w in (words, turned, bare, [x for x in turned if x not in _CONNECTIVES], sorted(bare))]

    def _spelled(self, short: str, loose: bool) -> list[str]:
        """Every word that an abbreviation may stand for: those it begins, and if ``loose`` those with its letters in their order."""
        same = self.by_letter.get(short[:1], [])
        return [x for x in same if x.startswith(short) or loose and len(short) > 2 and _shortens(short, x)]

    def _written_out(self, marked: list[tuple[str, bool]], loose: bool) -> tuple[list[str], list[str]]:
        """The readings of a value whose words marked True are abbreviations: in its own order, and in any order, sorted.

        The list's forms are narrowed by the value's words and by all words that its abbreviations
        may stand for, then matched word by word; connectives may be skipped. A word that the list
        does not have (misspelled) fits any and stays as it is, for the tree to correct.
        """
        options: list[set[str] | None] = []
        forms: set[str] | None = None
        for w, short in marked:
            o = set(self._spelled(w, loose)) if short else {w} & self.by_word.keys()
            options.append(o or None)
            if o and w not in _CONNECTIVES:
                with_word = set().union(*(self.by_word[x] for x in o))
                forms = with_word if forms is None else forms & with_word
        least = sum(w not in _CONNECTIVES for w, _ in marked)
        sizes = range(max(least, 1), len(marked) + 1)
        near = [f for f in forms if f.count(" ") + 1 in sizes] if forms is not None else [f for n in sizes for f in self.by_size.get(n, ())]
        ordered, sorted_ = [], []
        for form in sorted(near):
            words = form.split(" ")
            if (r := _in_order(marked, options, words)) is not None:
                ordered.append(" ".join(r))
            if words == sorted(words) and (r := _in_any_order(marked, options, words)) is not None:
                sorted_.append(" ".join(sorted(r)))
        return ordered, sorted_

    def _readings(self, value: str) -> list[list[str]]:
        """What a value may read as: as it stands, without a bracketed remark and connectives; then with
        abbreviations written out by words they begin, in its order and in any; then so by words with their letters."""
        stages: list[list[str]] = [[] for _ in range(5)]
        for text in dict.fromkeys((value, _PARENS.sub(" ", value))):
            raw = re.findall(r"[a-z0-9]+\.?", fold_text(text))
            marked = [(w.rstrip("."), w.endswith(".")) for w in raw]
            words = [w for w, _ in marked]
            bare = [w for w in words if w not in _CONNECTIVES]
            stages[0] += [" ".join(words), " ".join(bare), " ".join(sorted(bare))]
            if any(short for _, short in marked):
                for n, loose in ((1, False), (3, True)):
                    for m, found in enumerate(self._written_out(marked, loose)):
                        stages[n + m] += found
        return [[r for r in dict.fromkeys(x) if r] for x in stages]

    def nearest(self, value: str) -> tuple[int, int, int, str] | None:
        """(stage, distance, rank, entry) of the entry meant, or None: the smallest counts.

        Stages: 0 a reading as it stands, 1 an acronym, 2 to 5 abbreviations written out, 6 readings within the
        edit radius, nearest first, 7 the same stems. Rank 1 is another name, behind an entry itself; then by code
        points. Every stage looks at the index's own words only, so that the smallest answer of several
        parts of a list is that of the whole list.
        """
        stages = self._readings(value)
        for n, readings in enumerate(stages):
            hits = [self.exact[r] for r in readings if r in self.exact]
            if hits:
                return (n + (n > 0), 0, *min(hits))
            if not n:
                for text in (value, _PARENS.sub(" ", value)):
                    if (letters := "".join(keyed(text))) in self.short:
                        return (1, 0, 0, self.short[letters])
        best: tuple[int, int, int, str] | None = None
        for r in dict.fromkeys(r for x in stages for r in x):
            if not self._hopeful(r):
                continue
            for d, key in self.tree.within(r, radius(len(r))):
                rank, entry = self.exact[key]
                # another name must be closer than an entry itself, and is never bent by more than one edit
                if rank and (d > 1 or len(key) < 8):
                    continue
                if best is None or (6, d, rank, entry) < best:
                    best = (6, d, rank, entry)
        if best is None and (same := self.by_stems.get(stems(keyed(value)))):
            best = (7, 0, 0, same)
        return best

    def lookup(self, value: str) -> str | None:
        """The entry meant, or None."""
        best = self.nearest(value)
        return best[3] if best else None


def _in_order(marked: list[tuple[str, bool]], options: list[set[str] | None], words: list[str]) -> list[str] | None:
    """A value's words read as those of a form one by one, connectives of the value skipped where they are none of the form's; None if they do not fit."""
    failed: set[tuple[int, int]] = set()
    stack: list[tuple[int, int, tuple[str, ...]]] = [(0, 0, ())]
    while stack:
        i, j, read = stack.pop()
        if (i, j) in failed:
            continue
        failed.add((i, j))
        if i == len(marked):
            if j == len(words):
                return list(read)
            continue
        w, o = marked[i][0], options[i]
        if w in _CONNECTIVES:
            stack.append((i + 1, j, read))
        if j < len(words) and (o is None or words[j] in o):
            stack.append((i + 1, j + 1, (*read, words[j] if o is not None else w)))
    return None


def _in_any_order(marked: list[tuple[str, bool]], options: list[set[str] | None], words: list[str]) -> list[str] | None:
    """As ``_in_order`` for words in any order: a matching of the value's words, its connectives left out, with all words of a form."""
    rows = [k for k, (w, _) in enumerate(marked) if w not in _CONNECTIVES]
    if len(rows) != len(words):
        return None
    known = [k for k in rows if options[k] is not None]
    owner: dict[int, int] = {}

    def place(k: int, seen: set[int]) -> bool:
        for j, x in enumerate(words):
            if j not in seen and x in options[k]:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = k
                    return True
        return False

    if not all(place(k, set()) for k in known):
        return None
    return [words[j] for j in owner] + [marked[k][0] for k in rows if options[k] is None]


_SHARED: dict[str, tuple[EntryIndex, dict[str, str | None]]] = {}
_MEMO_LIMIT = 200_000


def shared_lookup(spec: tuple, value: str) -> str | None:
    """Lookup with an index and memo kept by the Python worker across tasks; the memo is bounded."""
    key = repr(spec)
    if key not in _SHARED:
        entries, acronyms, aliases = spec
        _SHARED[key] = (EntryIndex(entries, dict(acronyms), {k: list(v) for k, v in aliases}), {})
    index, memo = _SHARED[key]
    if value not in memo:
        if len(memo) >= _MEMO_LIMIT:
            memo.clear()
        memo[value] = index.lookup(value)
    return memo[value]


@dataclass
class Listing:
    """A reference list: rows (entry, acronym), and other names of entries."""

    rows: DataFrame
    aliases: dict[str, Sequence[str]] = field(default_factory=dict)

    def spec(self, rows: Sequence) -> tuple:
        """Entries, acronyms and other names as plain values, to build an index from; an acronym of several entries means the smallest."""
        entries = sorted({r[0] for r in rows})
        acronyms = {r[1]: r[0] for r in sorted(rows, key=lambda r: (r[1] or "", r[0]), reverse=True) if r[1]}
        return tuple(entries), tuple(sorted(acronyms.items())), tuple((k, tuple(v)) for k, v in sorted(self.aliases.items()) if k in set(entries))


def relations(vocab: DataFrame) -> Listing:
    """The relation vocabulary with its other names."""
    return Listing(vocab.select(F.col("relation").alias("entry"), F.lit(None).cast("string").alias("acronym")), RELATION_ALIASES)


def bodies(issuers: DataFrame) -> Listing:
    """The issuing bodies with their acronyms."""
    return Listing(issuers.select(F.col("name").alias("entry"), "acronym"))


def with_mapped(df: DataFrame, value: Column, listing: Listing, out: str, *, most: int = MAX_BROADCAST_ENTRIES) -> DataFrame:
    """Adds ``out``: the entry meant by a value, 'unmatched' where there is none, NULL for NULL.

    A list of up to ``most`` entries travels with the function, and a value that is itself an entry
    is decided in the JVM; a longer list goes through ``map_sharded``. Both give the same entries.
    """
    rows = listing.rows.where(F.col("entry").isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        return map_sharded(df, value, listing, out, most=most)
    spec = listing.spec(rows)

    @F.pandas_udf(T.StringType())
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else (shared_lookup(spec, v) or UNMATCHED))

    listed = value.isin(list(spec[0]))
    return df.withColumn(out, F.when(value.isNull(), None).when(listed, value).otherwise(mapped(F.when(~listed, value))))


def map_sharded(df: DataFrame, value: Column, listing: Listing, out: str, *, most: int = MAX_BROADCAST_ENTRIES, per_task: int = 50_000) -> DataFrame:
    """``with_mapped`` for a reference list too long to broadcast.

    The list falls into shards of about ``most`` entries by their hash, each with its acronyms and
    other names; the distinct values go to every shard, in buckets of about ``per_task`` (both counted
    first). A shard's index returns its best (stage, distance, rank, entry), and the smallest of
    all shards counts.
    """
    v = unclash(df, "_v")[0]
    entries = listing.rows.where(F.col("entry").isNotNull()).distinct()
    vals = df.select(value.alias("v")).where(F.col("v").isNotNull()).distinct()
    shards = -(-entries.count() // most) or 1
    buckets = -(-vals.count() // per_task) or 1
    left = vals.select("v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), F.pmod(F.xxhash64("v"), F.lit(buckets)).cast("int").alias("b"))
    right = entries.select("entry", "acronym", F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("b"))
    aliases = listing.aliases

    def winners(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names, acronyms, others = Listing(None, aliases).spec([(r.entry, r.acronym) for r in b.itertuples()])
        index = EntryIndex(names, dict(acronyms), {k: list(x) for k, x in others})
        return pd.DataFrame([(x, *found) for x in a["v"] if (found := index.nearest(x))], columns=["v", "stage", "d", "rank", "entry"])

    won = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInPandas(winners, "v string, stage int, d int, rank int, entry string")
    best = won.groupBy("v").agg(F.min(F.struct("stage", "d", "rank", "entry")).alias("w")).select(F.col("v").alias(v), F.col("w.entry").alias("_t"))
    joined = df.withColumn(f"{v}x", value).join(best, F.col(f"{v}x") == F.col(v), "left")
    return joined.withColumn(out, F.when(F.col(f"{v}x").isNull(), None).otherwise(F.coalesce("_t", F.lit(UNMATCHED)))).drop(v, f"{v}x", "_t")


def map_relations(triples: DataFrame, vocab: DataFrame, out: str = "relation_entry") -> DataFrame:
    """Adds the vocabulary entry of each relation, 'unmatched', or NULL for NULL."""
    return with_mapped(triples, F.col("relation"), relations(vocab), out)


def find_mapped(triples: DataFrame, law_meta: DataFrame, vocab: DataFrame, issuers: DataFrame, *, most: int = MAX_BROADCAST_ENTRIES) -> DataFrame:
    """(tbl, row_id, fld, target) of each non-null value that is not itself an entry of its list; lists of more than ``most`` entries are sharded."""
    rel = with_mapped(triples.select("triple_id", "relation", "tail"), F.col("relation"), relations(vocab), "r", most=most)
    rel = rel.withColumn("t", F.when(F.col("r") == "emis_de", F.col("tail")))
    # one pass over the triples gives both fields
    both = with_mapped(rel, F.col("t"), bodies(issuers), "i", most=most).select(
        F.col("triple_id").alias("row_id"),
        F.explode(
            F.array(
                F.struct(F.lit("relation").alias("fld"), F.col("relation").alias("value"), F.col("r").alias("target")),
                F.struct(F.lit("tail").alias("fld"), F.col("t").alias("value"), F.col("i").alias("target")),
            )
        ).alias("x"),
    )
    from_triples = both.where(F.col("x.value").isNotNull() & (F.col("x.value") != F.col("x.target"))).select(F.lit("legislative_triples").alias("tbl"), "row_id", "x.fld", "x.target")
    em = with_mapped(law_meta.select("meta_id", "emitent").where(F.col("emitent").isNotNull()), F.col("emitent"), bodies(issuers), "target", most=most)
    from_meta = em.where(F.col("emitent") != F.col("target")).select(F.lit("law_meta").alias("tbl"), F.col("meta_id").alias("row_id"), F.lit("emitent").alias("fld"), "target")
    return from_triples.unionByName(from_meta)
