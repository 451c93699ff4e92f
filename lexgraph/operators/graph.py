"""The property multigraph as two DataFrames, and its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LAW_ID_SHAPE
from ..runtime import materialize


def edges(df: DataFrame) -> DataFrame:
    """One edge per row with both ends; parallel edges are kept, all other columns are edge attributes."""
    return df.where(F.col("head").isNotNull() & F.col("tail").isNotNull())


def nodes(df: DataFrame) -> DataFrame:
    """(id) of every end of an edge, once."""
    return edges(df).select(F.explode(F.array("head", "tail")).alias("id")).distinct()


def annotate_laws(node_ids: DataFrame, meta: DataFrame) -> DataFrame:
    """Nodes with node_type, tip_act, numar, an, titlu, in_force, external.

    A node shaped like an act identifier is a 'law'; it is external if no registration of it is
    known. Of several registrations the latest (then the greatest meta_id) is shown.
    """
    fields = ["tip_act", "numar", "an", "titlu", "in_force"]
    order = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("registered_at", "meta_id") if c in meta.columns] or [F.lit(0)]
    latest = meta.groupBy(F.col("law_id").alias("id")).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("m"))
    law = F.col("id").rlike(LAW_ID_SHAPE)
    return node_ids.join(latest, "id", "left").select(
        "id",
        F.when(law, "law").alias("node_type"),
        *(F.when(law, F.col(f"m.{f}")).alias(f) for f in fields),
        F.when(law & F.col("m").isNull(), F.lit(True)).alias("external"),
    )


def degrees(df: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree) of each node; a self-loop adds one to each side."""
    ends = F.array(F.struct(F.col("head").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("tail").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    d = edges(df).select(F.explode(ends).alias("x")).groupBy("x.id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    return d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def density(df: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, density = m / (n (n - 1)), 0 without edges or with one node."""
    n = nodes(df).agg(F.count("*").alias("n_nodes"))
    m = edges(df).agg(F.count("*").alias("n_edges"))
    dens = F.when(F.col("n_nodes") <= 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("n_edges").cast("double"), (F.col("n_nodes") * (F.col("n_nodes") - 1)).cast("double")), F.lit(0.0)))
    return n.crossJoin(m).select("n_nodes", "n_edges", dens.alias("density"))  # two single rows


def reciprocity(df: DataFrame) -> DataFrame:
    """One row: reciprocity of the multigraph, twice the sum over pairs of the smaller edge count of the two directions, by all edges; NULL for an empty graph."""
    up = F.col("head") < F.col("tail")
    down = F.col("head") > F.col("tail")
    pairs = edges(df).groupBy(F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b")).agg(F.count("*").alias("k"), F.count_if(up).alias("there"), F.count_if(down).alias("back"))
    return pairs.agg(F.try_divide((2 * F.sum(F.least("there", "back"))).cast("double"), F.sum("k").cast("double")).alias("reciprocity"))


def degree_histogram(df: DataFrame, column: str = "degree", bins: int = 50) -> DataFrame:
    """(bin, n_nodes) of the non-empty ones of ``bins`` equal bins over [min, max] of a degree; the last bin is closed."""
    d = degrees(df).select(F.col(column).alias("d"))
    span = d.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("d") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    return d.crossJoin(F.broadcast(span)).select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n_nodes"))  # one row of bounds


def sample_subgraph(df: DataFrame, seq: str, n: int = 50) -> DataFrame:
    """Edges among the first ``n`` nodes in the order ``seq`` of their first appearance (heads before tails, then by id)."""
    first = edges(df).select(F.explode(F.array(F.struct(F.col("head").alias("id"), (F.col(seq) * 2).alias("at")), F.struct(F.col("tail").alias("id"), (F.col(seq) * 2 + 1).alias("at")))).alias("x")).groupBy("x.id").agg(F.min("x.at").alias("at"))
    picked = F.broadcast(first.orderBy("at", "id").limit(n).select("id"))  # n ids
    return edges(df).join(picked.withColumnRenamed("id", "head"), "head", "left_semi").join(picked.withColumnRenamed("id", "tail"), "tail", "left_semi")


def components(df: DataFrame, *, max_rounds: int = 50) -> DataFrame:
    """(id, component): the smallest node id reachable without regard to direction.

    Label propagation with pointer jumping: labels flow along edges, then each node takes its
    label's label, so rounds grow with the logarithm of the longest path. Each round is written to
    the checkpoint folder. An extension: no counterpart in the original pipeline.
    """
    pairs = edges(df).where(F.col("head") != F.col("tail")).select(F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b")).distinct()
    both = materialize(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialize(nodes(df).select("id", F.col("id").alias("component")))
    for _ in range(max_rounds):
        flow = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(flow, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = materialize(step.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = new.where(F.col("old") != F.col("component")).limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError(f"labels still move after {max_rounds} rounds")
