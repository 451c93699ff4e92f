"""Ontology axioms as declarative checks. Rows with a NULL head, relation or tail take no part."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ASYMMETRIC, FUNCTIONAL, IRREFLEXIVE, RELATIONS, SYMMETRIC, TAIL_DOMAIN, TRANSITIVE

EDGE = ["head", "relation", "tail"]


def _edges(df: DataFrame, relations: Sequence[str]) -> DataFrame:
    return df.where(F.col("relation").isin(list(relations)) & F.col("head").isNotNull() & F.col("tail").isNotNull())


def functional(df: DataFrame, relations: Sequence[str] = FUNCTIONAL) -> DataFrame:
    """(head, relation, n_tails) of each head with more than one tail under a functional relation."""
    pairs = _edges(df, relations).select(*EDGE).distinct()
    return pairs.groupBy("head", "relation").agg(F.count("*").alias("n_tails")).where("n_tails > 1")


def asymmetric(df: DataFrame, relations: Sequence[str] = ASYMMETRIC, *, count_self_loops: bool = True) -> DataFrame:
    """(relation, a, b), a <= b: each unordered pair linked both ways by an asymmetric relation.

    Edges are folded onto their unordered pair and both directions looked for in one aggregate, so
    there is no self-join and a hub costs its edges only.
    """
    e = _edges(df, relations)
    if not count_self_loops:
        e = e.where(F.col("head") != F.col("tail"))
    pairs = e.groupBy("relation", F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b")).agg(
        F.max((F.col("head") <= F.col("tail")).cast("int")).alias("there"), F.max((F.col("head") >= F.col("tail")).cast("int")).alias("back")
    )
    return pairs.where("there = 1 AND back = 1").select("relation", "a", "b")


def irreflexive(df: DataFrame, relations: Sequence[str] = IRREFLEXIVE) -> DataFrame:
    """Rows (as a bag, all columns) whose head is their tail under an irreflexive relation."""
    return _edges(df, relations).where(F.col("head") == F.col("tail"))


def symmetric(df: DataFrame, relations: Sequence[str] = SYMMETRIC) -> DataFrame:
    """(head, relation, tail) of each distinct edge of a symmetric relation that lacks its reverse; self-loops need none."""
    e = _edges(df, relations).where(F.col("head") != F.col("tail"))
    up = F.col("head") < F.col("tail")
    pairs = e.groupBy("relation", F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b")).agg(F.max(up.cast("int")).alias("there"), F.max((~up).cast("int")).alias("back"))
    one = pairs.where("there + back = 1")
    return one.select(F.when(F.col("there") == 1, F.col("a")).otherwise(F.col("b")).alias("head"), "relation", F.when(F.col("there") == 1, F.col("b")).otherwise(F.col("a")).alias("tail"))


def tail_domain(df: DataFrame, domains: Mapping[str, Sequence[str]] = TAIL_DOMAIN) -> DataFrame:
    """Rows (as a bag) whose tail is not among the tails allowed for their relation."""
    bad = F.lit(False)
    for relation, allowed in domains.items():
        bad = bad | ((F.col("relation") == relation) & ~F.col("tail").isin(list(allowed)))
    return _edges(df, list(domains)).where(bad)


def two_hops(df: DataFrame, relations: Sequence[str] = TRANSITIVE, *, per_task: int = 1_000_000) -> DataFrame:
    """(relation, a, b, c, n_paths) of the chains a -> b -> c under each relation, cycles and self-loops included.

    Parallel edges are counted before the join and multiplied after it: same bag of chains, but a
    repeated edge takes part once. A middle node with more than ``per_task`` chains is split by its
    measured in- and out-degree: its ingoing edges are spread over as many salts as it needs and its outgoing ones
    meet each of them, so that no task builds many more than ``per_task`` chains.
    """
    e = _edges(df, relations).groupBy(*EDGE).agg(F.count("*").alias("k"))
    ends = F.array(F.struct(F.col("tail").alias("b"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("head").alias("b"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    per = e.select("relation", F.explode(ends).alias("x")).groupBy("relation", "x.b").agg(F.sum("x.i").alias("i"), F.sum("x.o").alias("o"))
    hubs = per.where(F.col("i") * F.col("o") > per_task).select("relation", "b", F.least(F.ceil(F.col("i") * F.col("o") / F.lit(per_task)), F.col("i")).cast("int").alias("n"))
    n = F.coalesce("n", F.lit(1))
    left = e.select("relation", F.col("head").alias("a"), F.col("tail").alias("b"), F.col("k").alias("k1")).join(hubs, ["relation", "b"], "left").withColumn("s", F.pmod(F.xxhash64("a"), n).cast("int")).drop("n")
    right = e.select("relation", F.col("head").alias("b"), F.col("tail").alias("c"), F.col("k").alias("k2")).join(hubs, ["relation", "b"], "left").withColumn("s", F.explode(F.sequence(F.lit(0), n - 1))).drop("n")
    return left.join(right, ["relation", "b", "s"]).select("relation", "a", "b", "c", (F.col("k1") * F.col("k2")).alias("n_paths"))


def two_hop_count(df: DataFrame, relations: Sequence[str] = TRANSITIVE) -> DataFrame:
    """(relation, n_paths): the chains counted without building them, as the sum over middle nodes of in-degree times out-degree."""
    e = _edges(df, relations)
    ends = e.select("relation", F.explode(F.array(F.struct(F.col("tail").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("head").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    per = ends.groupBy("relation", "x.node").agg(F.sum("x.i").alias("i"), F.sum("x.o").alias("o"))
    return per.groupBy("relation").agg(F.sum(F.col("i") * F.col("o")).alias("n_paths"))


def provenance(law_id: str = "law_id", article: str = "article_number"):
    """' (law / art N)', shorter where a part is missing, empty without a law."""
    law, art = F.col(law_id), F.col(article)
    return F.when(law.isNull(), "").when(art.isNull(), F.format_string(" (%s)", law)).otherwise(F.format_string(" (%s / art %s)", law, art))


def _single_row_axioms(df: DataFrame) -> list[DataFrame]:
    return [
        functional(df).select(F.lit("functional").alias("axiom"), "relation", F.col("head").alias("a"), F.col("n_tails").cast("string").alias("b")),
        asymmetric(df).select(F.lit("asymmetric").alias("axiom"), "relation", "a", "b"),
        irreflexive(df).select(F.lit("irreflexive").alias("axiom"), "relation", F.col("head").alias("a"), F.col("tail").alias("b")),
        symmetric(df).select(F.lit("symmetric").alias("axiom"), "relation", F.col("head").alias("a"), F.col("tail").alias("b")),
        tail_domain(df).select(F.lit("domain").alias("axiom"), "relation", F.col("head").alias("a"), F.col("tail").alias("b")),
    ]


def all_violations(df: DataFrame) -> DataFrame:
    """(axiom, relation, a, b) of every violation; chains of the transitive axiom are listed by their ends, once per middle node."""
    return reduce(DataFrame.unionByName, [*_single_row_axioms(df), two_hops(df).select(F.lit("transitive").alias("axiom"), "relation", "a", F.col("c").alias("b"))])


def violations_by_axiom(df: DataFrame) -> DataFrame:
    """(axiom, relation, n) of the violations; chains are counted, repeated edges included, without building them."""
    listed = reduce(DataFrame.unionByName, _single_row_axioms(df)).groupBy("axiom", "relation").agg(F.count("*").alias("n"))
    return listed.unionByName(two_hop_count(df).where("n_paths > 0").select(F.lit("transitive").alias("axiom"), "relation", F.col("n_paths").alias("n")))


def violation_counts(df: DataFrame, by: Sequence[str] = (), domains: Mapping[str, Sequence[str]] = TAIL_DOMAIN, vocabulary: Sequence[str] = RELATIONS) -> DataFrame:
    """Per group of ``by``: functional, asymmetric (no self-loops), irreflexive, domain, vocabulary and total violations.

    Every group of the input has a row. Two passes of aggregation: edges folded on unordered pairs
    give the asymmetric count, the rest comes from the rows.
    """
    keys = list(by)
    bad_domain = F.lit(False)
    for relation, allowed in domains.items():
        bad_domain = bad_domain | ((F.col("relation") == relation) & ~F.col("tail").isin(list(allowed)))
    ok = F.col("head").isNotNull() & F.col("tail").isNotNull()
    rows = df.groupBy(*keys).agg(
        F.count_if(ok & F.col("relation").isin(list(IRREFLEXIVE)) & (F.col("head") == F.col("tail"))).alias("irreflexive"),
        F.count_if(ok & bad_domain).alias("domain"),
        F.count_if(F.col("relation").isNotNull() & ~F.col("relation").isin(list(vocabulary))).alias("vocabulary"),
        F.count("*").alias("n_triples"),
    )
    fun = _edges(df, FUNCTIONAL).select(*keys, *EDGE).distinct().groupBy(*keys, "head", "relation").agg(F.count("*").alias("k")).where("k > 1").groupBy(*keys).agg(F.count("*").alias("functional"))
    e = _edges(df, ASYMMETRIC).where(F.col("head") != F.col("tail"))
    up = F.col("head") < F.col("tail")
    asy = (
        e.groupBy(*keys, "relation", F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b"))
        .agg(F.max(up.cast("int")).alias("there"), F.max((~up).cast("int")).alias("back"))
        .where("there + back = 2")
        .groupBy(*keys)
        .agg(F.count("*").alias("asymmetric"))
    )
    if keys:
        out = rows.join(fun, keys, "left").join(asy, keys, "left")
    else:
        out = rows.crossJoin(fun).crossJoin(asy)  # single rows
    zero = F.lit(0).cast("bigint")
    out = out.withColumn("functional", F.coalesce("functional", zero)).withColumn("asymmetric", F.coalesce("asymmetric", zero))
    return out.withColumn("total", F.col("functional") + F.col("asymmetric") + F.col("irreflexive") + F.col("domain") + F.col("vocabulary")).select(
        *keys, "functional", "asymmetric", "irreflexive", "domain", "vocabulary", "total", "n_triples"
    )
