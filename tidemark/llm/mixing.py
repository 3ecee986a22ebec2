"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Sources get weights; a source's target stops at ``max_epochs`` times its own size and what it cannot take goes to
the others by weight until none is above. The fixed point has a closed form: with sources in order of cap / weight,
a prefix is capped and the rest share one level, found by running sums over the small table of sources.

A document is repeated whole times for each whole epoch of its source; for the fraction that is left, documents
enter in the order of a seeded hash until the words still wanted are reached. To find that place without sorting a
source in one task, sizes are first summed by the hash's leading digits; only the bucket where the running sum
crosses the wanted amount is looked at document by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    """Per source of ``sizes`` (source, size): ``source_size`` and ``target``. One row per source goes through one task."""
    src = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    src = src.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    everything = Window.partitionBy()
    src = src.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    src = (
        src.withColumn("pos", F.row_number().over(order))
        .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
        .withColumn("free", F.col("level") * F.col("w") < F.col("cap"))
        .withColumn("first_free", F.min(F.when(F.col("free"), F.col("pos"))).over(everything))
        .withColumn("water", F.max(F.when(F.col("pos") == F.col("first_free"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("pos") >= F.col("first_free"), F.col("water") * F.col("w")).otherwise(F.col("cap"))
    return src.select("source", "source_size", target.alias("target"))


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, share: float = 1.0, seed: str = "mix",
) -> DataFrame:
    """Return per row of df: id, ``source``, ``size`` (words), ``source_size``, ``target``, ``repeats``, ``taken`` (words).

    A null text has no words; null is a source of its own, in the last place. A row of a source without words takes
    nothing. Rows with equal ids share a place in the order, the smaller size first. Empty input gives no rows.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sizes = materialise(
        df.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"),
            F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), key.alias("key"),
        ).withColumn("bucket", F.substring("key", 1, 4)),
        "mix-sizes",
    )
    targets = source_targets(sizes, weights, max_epochs, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    hist = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")).withColumn("coarse", F.substring("bucket", 1, 2))
    to_here = lambda *keys: Window.partitionBy("source", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, 0)
    coarse = hist.groupBy("source", "coarse").agg(F.sum("in_bucket").alias("n"))  # 256 rows a source at most
    coarse = coarse.select(F.col("source").alias("csource"), F.col("coarse").alias("ccoarse"), (F.sum("n").over(to_here("coarse")) - F.col("n")).alias("earlier"))
    hist = hist.join(coarse, F.col("source").eqNullSafe(F.col("csource")) & (F.col("coarse") == F.col("ccoarse")))
    hist = hist.withColumn("upto", F.col("earlier") + F.sum("in_bucket").over(to_here("coarse", "bucket")))
    t = targets.withColumnRenamed("source", "tsource")
    hist = hist.join(t, F.col("source").eqNullSafe(F.col("tsource"))).drop("tsource")
    hist = hist.select(F.col("source").alias("hsource"), F.col("bucket").alias("hbucket"), "source_size", "target", "whole", (F.col("want") - F.col("upto") + F.col("in_bucket")).alias("left_here"))
    rows = sizes.join(hist, F.col("source").eqNullSafe(F.col("hsource")) & (F.col("bucket") == F.col("hbucket")))
    within = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    extra = (F.sum("size").over(within) - F.col("size") / 2 <= F.col("left_here")).cast("long")
    rows = rows.withColumn("repeats", F.col("whole") + extra).where(F.lit(True))
    return rows.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", F.col("repeats"), (F.col("repeats") * F.col("size")).alias("taken"),
    )
