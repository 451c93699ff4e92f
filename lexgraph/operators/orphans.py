"""References to records that do not exist, are no longer held or were not yet held."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import unclash

MATCHES = ("simple", "partial", "full")


def _mask(cols: list[Column]) -> Column:
    return F.concat(*(F.when(c.isNull(), "0").otherwise("1") for c in cols))


def _key(cols: list[Column]) -> Column:
    # lengths keep ('a', 'b|c') apart from ('a|b', 'c')
    return F.concat(*(F.concat(F.length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")), F.lit("|")) for c in cols))


def holding_islands(registry: DataFrame, by: list[str], valid_from: str, valid_to: str) -> DataFrame:
    """Per key the disjoint intervals [s, e) in which any registry row holds, and the earliest start.

    Rows are de-duplicated and merged by start before the window, so a key registered many times
    costs its distinct starts only. An empty interval (e <= s) holds nothing but still dates the key.
    """
    never_ends = F.lit("9999-12-31 00:00:00").cast(registry.schema[valid_to].dataType)
    always = F.lit("0001-01-01 00:00:00").cast(registry.schema[valid_from].dataType)
    starts = (
        registry.select(*by, F.coalesce(F.col(valid_from), always).alias("s"), F.coalesce(F.col(valid_to), never_ends).alias("e"))
        .groupBy(*by, "s")
        .agg(F.max("e").alias("e"))
    )
    w = Window.partitionBy(*by).orderBy("s")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        starts.withColumn("fresh", (reach.isNull() | (F.col("s") > reach)).cast("int"))
        .withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, "island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
    )
    return islands.groupBy(*by).agg(F.collect_list(F.struct("s", "e")).alias("islands"), F.min("s").alias("first_s"))


def find_orphans(
    refs: DataFrame,
    registry: DataFrame,
    keys: list[str],
    *,
    at: str,
    valid_from: str,
    valid_to: str,
    match: str = "simple",
    sample: float = 0.01,
) -> DataFrame:
    """The rows of ``refs`` whose composite key no row of ``registry`` holds at the time ``at``.

    References are grouped by the null mask of their key; each mask is matched against the
    registry on its non-null columns only, under the declared semantics (as in SQL MATCH):
    "simple" - a key with any null refers to nothing and is never an orphan; "partial" - the
    non-null columns must match some row; "full" - a partly null key is always an orphan
    ('missing'). A key of nulls only is never an orphan. The masks share one hash join on
    (mask, non-null values): the registry is projected once per mask it can serve.

    A registry row holds from ``valid_from`` (inclusive; null = always) to ``valid_to``
    (exclusive; null = still held). The result has the columns of ``refs`` and ``orphan_kind``:
    'missing' - no row of that key; 'late' - all its rows begin after ``at``; 'deleted' - otherwise.
    A reference whose ``at`` is null is reported only as 'missing', as the others cannot be told.

    Hot keys are those with more than 1/200 of the references of a random ``sample``, so there are
    at most 200 of them; each is spread over twice as many salts as its share has two-hundredths, and only its registry
    row is replicated. The sample decides where rows meet, never what is found. The planner
    broadcasts the registry only when its measured size is below the session's threshold.
    Repeated rows, extra columns and empty tables pass through unchanged.
    """
    if match not in MATCHES:
        raise ValueError(f"match is one of {MATCHES}")
    mask_c, key_c, salt_c = unclash(refs, "_mask", "_refkey", "_salt")
    k = len(keys)
    masks = [m for m in ("".join(p) for p in product("01", repeat=k)) if "1" in m]
    wanted = masks if match == "partial" else ["1" * k]
    dated = [F.col(c) for c in keys]
    per_mask = F.array(
        *(
            F.when(
                _usable(dated, m),
                F.struct(F.lit(m).alias("m"), _key([c if b == "1" else F.lit(None).cast("string") for c, b in zip(dated, m, strict=True)]).alias("k")),
            )
            for m in wanted
        )
    )
    served = registry.select(F.explode(F.array_compact(per_mask)).alias("mk"), F.col(valid_from), F.col(valid_to)).select("mk.m", "mk.k", valid_from, valid_to)
    held = holding_islands(served, ["m", "k"], valid_from, valid_to)
    salts = _salts_of_hot_keys(refs, keys, sample)
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), salts(F.col("m"), F.col("k")) - 1))).select(
        F.col("m").alias("h_m"), F.col("k").alias("h_k"), F.col("salt").alias("h_salt"), F.col("islands").alias("h_islands"), F.col("first_s").alias("h_first")
    )
    cols = [F.col(c) for c in keys]
    tagged = (
        refs.withColumn(mask_c, _mask(cols))
        .withColumn(key_c, _key(cols))
        .withColumn(salt_c, F.pmod(F.xxhash64(*(F.col(c) for c, t in refs.dtypes if not t.startswith("map"))), salts(F.col(mask_c), F.col(key_c))).cast("int"))
        .where(F.col(mask_c).contains("1"))
    )
    if match == "simple":
        tagged = tagged.where(~F.col(mask_c).contains("0"))
    joined = tagged.join(held, (F.col(mask_c) == F.col("h_m")) & (F.col(key_c) == F.col("h_k")) & (F.col(salt_c) == F.col("h_salt")), "left")
    t = F.col(at)
    now = F.exists("h_islands", lambda i: (i["s"] <= t) & (t < i["e"]))
    kind = F.when(F.col("h_k").isNull(), "missing").when(t.isNull(), None).when(F.col("h_first") > t, "late").when(~now, "deleted")
    return joined.withColumn("orphan_kind", kind).where(F.col("orphan_kind").isNotNull()).select(*refs.columns, "orphan_kind")


#: A key is hot with more than this share of the sampled references.
HOT = 1 / 200


def _salts_of_hot_keys(refs: DataFrame, keys: list[str], sample: float) -> Callable[[Column, Column], Column]:
    """(mask, key) -> number of salts: 1 but for the hot keys of a sample, of which there are at most 1 / HOT."""
    cols = [F.col(c) for c in keys]
    counts = refs.sample(sample, seed=7).select(_mask(cols).alias("m"), _key(cols).alias("k")).groupBy("m", "k").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    hot = counts.crossJoin(F.broadcast(total)).where((F.col("n") > F.col("total") * HOT) & (F.col("n") > 20)).select("m", "k", F.ceil(2 * F.col("n") / (F.col("total") * HOT)).cast("int").alias("s"))  # one row of total
    found = [(F.concat_ws(" ", F.lit(r.m), F.lit(r.k)), F.lit(r.s)) for r in hot.collect()]
    if not found:
        return lambda mask, key: F.lit(1)
    known = F.create_map(*(x for pair in found for x in pair))
    return lambda mask, key: F.coalesce(F.try_element_at(known, F.concat_ws(" ", mask, key)), F.lit(1))


def _usable(cols: list[Column], mask: str) -> Column:
    """A registry row serves a mask when all of the mask's columns are non-null in it."""
    out = F.lit(True)
    for c, b in zip(cols, mask, strict=True):
        if b == "1":
            out = out & c.isNotNull()
    return out


def orphan_report(orphans: DataFrame, by: list[str]) -> DataFrame:
    """Orphans counted by the given columns and kind."""
    return orphans.groupBy(*by, "orphan_kind").agg(F.count("*").alias("n_refs"))
