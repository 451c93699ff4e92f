"""Problem 7: a whole corpus encoded with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import unclash

#: Where the vocabulary files are unless told otherwise.
TOKENIZER_DIR = os.environ.get("LEXGRAPH_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts up to this many characters are encoded whole; longer ones in chunks of it.
CHUNK = 8192
#: Characters that a chunk reads beyond its end, in which it must agree with the next one.
LAP = 256

_LOADED: dict[str, object] = {}


def encoder(path: str):
    """The encoding of a rank file, loaded once per Python worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def pretoken_ends(text: str, start: int, stop: int, final: bool) -> list[int]:
    """Ends of the pre-tokens of text[start:stop] that end in a letter or digit, as positions in the whole text.

    Only at such ends may a text be cut: white space at the end of a piece would be split otherwise
    than before the text that follows it. Where the window does not end the text, its last
    pre-tokens could go on, so the last two are left out.
    """
    import regex

    pattern = _LOADED.setdefault("pattern", regex.compile(PATTERN))
    met = list(pattern.finditer(text[start:stop]))
    return [start + m.end() for m in (met if final else met[:-2]) if m[0][-1].isalnum()]


ZONE = T.ArrayType(T.IntegerType())


def _rank_path(vocabulary: str, folder: str | None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, f"{vocabulary}.tiktoken")


def encode_corpus(
    df: DataFrame,
    id_col: str,
    text_col: str,
    *,
    vocabulary: str = "byte_bpe_50k",
    folder: str | None = None,
    chunk: int = CHUNK,
    lap: int = LAP,
) -> DataFrame:
    """(id, ids): the ids of each text, without special tokens; strings that look like special tokens are ordinary text.

    A NULL text and an empty one have the empty list; a row whose id is NULL or repeated keeps a
    row of its own. Texts up to ``chunk`` characters are encoded whole. A longer one is cut into
    chunks that read ``lap`` characters into the next; chunks are pre-tokenised in parallel, and
    neighbours are stitched at the first position in their lap where both have a pre-token
    boundary: as the pattern only looks ahead, both go on alike from there. The pieces between
    such positions are encoded in parallel and their ids put together in order, which is exact,
    since no merge crosses a pre-token. Neighbours without a common boundary form one piece.
    """
    path = _rank_path(vocabulary, folder)
    text = F.col(text_col)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for b in batches:
            yield b.map(lambda v: enc.encode_ordinary(v) if v else [])

    short = df.where(text.isNull() | (F.length(text) <= chunk)).select(F.col(id_col), ids_of(text).alias("ids"))
    long = df.where(F.length(text) > chunk).select(F.col(id_col), text.alias("text"))
    return short.unionByName(_encode_long(long, id_col, path, chunk, lap))


def _encode_long(long: DataFrame, id_col: str, path: str, chunk: int, lap: int) -> DataFrame:
    row, no = "__row", "__no"

    @F.pandas_udf(T.StructType([T.StructField("low", ZONE), T.StructField("high", ZONE)]))
    def zones(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        """Boundaries of a chunk within its first lap (from its start) and within the lap beyond its end."""
        for window, at, last in batches:
            low, high = [], []
            for w, a, final in zip(window, at, last, strict=True):
                ends = [a + e for e in pretoken_ends(w, 0, len(w), bool(final))]
                low.append([e for e in ends if e <= a + lap])
                high.append([e for e in ends if e > a + chunk])
            yield pd.DataFrame({"low": low, "high": high})

    # one row per text and chunk; the row key keeps repeated ids apart. Each step works on the rows of the step
    # before and no step reads the input again, so keys that a retried task gives anew meet only each other
    rows = long.withColumn(row, F.concat_ws("-", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.monotonically_increasing_id().cast("string")))
    rows = rows.withColumn("__n", F.length("text"))
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / chunk).cast("int")), lambda i: i * chunk)
    windows = F.transform(starts, lambda s: F.struct(s.alias("at"), F.substring(F.col("text"), s + 1, F.lit(chunk + lap)).alias("w")))
    read = rows.select(id_col, row, "__n", F.posexplode(windows).alias(no, "c")).select(
        id_col, row, no, F.col("c.w").alias("w"), F.col("c.at").alias("at"), (F.col("c.at") + chunk + lap >= F.col("__n")).alias("last")
    )
    # the chunks of one text go to different tasks
    zoned = read.repartition(row, no).select(id_col, row, no, "at", F.substring("w", 1, chunk).alias("own"), zones("w", "at", "last").alias("z"))

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("no", T.IntegerType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])))
    def stitched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """The pieces of a text from the zones of its chunks: cut where neighbours agree."""
        for b in batches:
            out = []
            for cs in b:
                cs = sorted(cs, key=lambda c: c["no"])
                cuts = [0]
                for left, right in zip(cs, cs[1:], strict=False):
                    common = sorted(set(left["high"]) & set(right["low"]))
                    if common:
                        cuts.append(common[0])
                n = cs[-1]["n"]
                cuts = sorted({c for c in cuts if c < n}) + [n]
                out.append([{"no": i, "s": s, "e": e} for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))])
            yield pd.Series(out)

    stitched = stitched.asNondeterministic()  # never computed twice
    zone = F.struct(F.col(no).alias("no"), F.col("z.low").alias("low"), F.col("z.high").alias("high"), (F.col("at") + F.length("own")).alias("n"))
    texts = zoned.groupBy(row).agg(F.first(id_col).alias(id_col), F.array_sort(F.collect_list(F.struct(zone.alias("z"), "own"))).alias("cs"))
    texts = texts.select(row, id_col, F.col("cs.own").alias("owns"), stitched("cs.z").alias("ps"))
    # a piece takes its characters from the chunks it touches only
    begin = F.floor(F.col("p.s") / chunk).cast("int")
    touched = F.array_join(F.slice("owns", begin + 1, F.floor((F.col("p.e") - 1) / chunk).cast("int") - begin + 1), "")
    joined = texts.select(row, id_col, "owns", F.explode("ps").alias("p")).select(row, id_col, F.col("p.no").alias("no"), F.substring(touched, F.col("p.s") - begin * chunk + 1, F.col("p.e") - F.col("p.s")).alias("piece")).repartition(row, "no")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for b in batches:
            yield b.map(lambda v: enc.encode_ordinary(v) if v else [])

    encoded = joined.select(row, "no", id_col, ids_of("piece").alias("piece_ids"))
    return (
        encoded.groupBy(row)
        .agg(F.first(id_col).alias(id_col), F.array_sort(F.collect_list(F.struct("no", "piece_ids"))).alias("ps"))
        .select(id_col, F.flatten(F.transform("ps", lambda p: p["piece_ids"])).alias("ids"))
    )


def decode(df: DataFrame, ids_col: str, *, vocabulary: str = "byte_bpe_50k", folder: str | None = None, out: str = "text") -> DataFrame:
    """Adds the text of a list of ids: the raw bytes of the ids put together, read as UTF-8 (broken sequences become U+FFFD). NULL stays NULL."""
    path = _rank_path(vocabulary, folder)

    @F.pandas_udf(T.StringType())
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for b in batches:
            yield b.map(lambda v: None if v is None else b"".join(enc.decode_single_token_bytes(int(i)) for i in v).decode("utf-8", "replace"))

    return df.withColumn(unclash(df, out)[0], text_of(ids_col))


def subword_counts(encoded: DataFrame) -> DataFrame:
    """Documents and ids of an encoded corpus per order of magnitude of the length."""
    n = F.size("ids")
    return encoded.groupBy(F.floor(F.log10(F.greatest(n, F.lit(1)))).cast("int").alias("magnitude")).agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_ids"))
