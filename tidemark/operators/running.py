"""Running aggregates along a series that is cut among tasks, and what follows from them: places, as-of joins, overlap.

Rows are range-partitioned by symbol and order, so neighbours in time lie in one task and a series with very many rows in several. Each
task aggregates along its own rows; what the parts before a part come to is one row per symbol and part. Only the first symbol of a
part can have earlier parts, so the list of such rows is at most as long as there are partitions, and is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.market import materialise

#: By kind: the aggregate over rows in order, and over parts in order.
KINDS = {
    "sum": (F.sum, F.sum), "count": (F.count, F.sum), "max": (F.max, F.max), "min": (F.min, F.min),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True)),
}


def running(df: DataFrame, columns: dict[str, tuple[str, Column | str]], order: list[str], key: str = "symbol") -> DataFrame:
    """df with, per name, a kind of KINDS over a column, from the first row of the key up to this one, in ``order`` (nulls first). ``last`` is the last that is not null.

    Rows that agree in key and order come one after the other in any order, as the rows of a file do. The key must not be null.
    """
    keys = [key, *order, "__tie"]
    columns = {out: (kind, F.col(x) if isinstance(x, str) else x) for out, (kind, x) in columns.items()}
    values = df.withColumns({f"__v_{out}": x for out, (_, x) in columns.items()}).withColumn("__tie", F.monotonically_increasing_id())
    stored = materialise(values.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "running")
    upto = Window.partitionBy(key, "__part").orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key, "__part").orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = {out: KINDS[kind][0](F.col(f"__v_{out}")) for out, (kind, _) in columns.items()}
    if any(kind == "last" for kind, _ in columns.values()):
        totals = stored.select(key, "__part", F.row_number().over(Window.partitionBy(key, "__part").orderBy(*order, "__tie")).alias("__n"), *[x.over(whole).alias(f"__t_{out}") for out, x in own.items()]).where("__n = 1").drop("__n")
    else:
        totals = stored.groupBy(key, "__part").agg(*[x.alias(f"__t_{out}") for out, x in own.items()])
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col(key).alias("__k"), F.col("__part").alias("__q"), F.lag("__part").over(Window.partitionBy(key).orderBy("__part")).alias("__p"), *[KINDS[kind][1](F.col(f"__t_{out}")).over(before).alias(f"__c_{out}") for out, (kind, _) in columns.items()])
    carried = F.broadcast(carried.where("__p is not null").drop("__p"))  # at most one row a partition
    joined = stored.withColumns({f"__l_{out}": x.over(upto) for out, x in own.items()}).join(carried, (F.col(key) == F.col("__k")) & (F.col("__part") == F.col("__q")), "left")

    def both(out: str, kind: str) -> Column:
        here, there = F.col(f"__l_{out}"), F.col(f"__c_{out}")
        if kind in ("sum", "count"):
            return F.coalesce(here + there, here, there)
        return F.coalesce(here, there) if kind == "last" else (F.greatest if kind == "max" else F.least)(here, there)

    return joined.select(*df.columns, *[both(out, kind).alias(out) for out, (kind, _) in columns.items()])


def in_order(df: DataFrame, begin: Callable[[], Callable[[pa.RecordBatch | None], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Rows of ``schema`` from a machine per series, for recursions: ``begin`` makes a function that takes the series' batches in order of time, and None at their end.

    A series is one task, sorted by Spark; Python holds a batch and what the machine remembers, whatever the length of the series. Rows are dealt by a hash of their own: where a join by symbol came before, Spark would
    leave a repartition by symbol out, and the adaptive plan, which turns the join into a broadcast one, would then read the series in pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, take = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("symbol")
            kinds = names.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if take is None or names[a].as_py() != name:
                    if take is not None:
                        yield from filter(None, [take(None)])
                    name, take = names[a].as_py(), begin()
                yield from filter(None, [take(batch.slice(a, b - a))])
        if take is not None:
            yield from filter(None, [take(None)])

    return df.repartition(F.xxhash64("symbol")).sortWithinPartitions("symbol", "ts").mapInArrow(run, schema)


#: Rows up to which a series is numbered in one task.
WHOLE_ROWS = 50_000


def places(df: DataFrame, out: str = "pos", order: list[str] | None = None, key: str = "symbol", whole: int = WHOLE_ROWS) -> DataFrame:
    """df with the number from 0 of each row in its series. Where the longest series, which is counted first, has more than ``whole`` rows, series are cut among tasks."""
    order = order or ["ts"]
    longest = df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if longest <= whole:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))
    return running(df, {"__place": ("count", F.lit(1))}, order, key).withColumn(out, F.col("__place") - 1).drop("__place")


def asof_join(left: DataFrame, right: DataFrame, columns: list[str] | None = None, *, strict: bool = False, within: str | None = None, key: str = "symbol") -> DataFrame:
    """left with ``columns`` (all by default) of the latest row of right at or before its ts (before it, if ``strict``) for the same symbol, null where there is none.

    ``within`` is an interval, such as ``1 hour``, that the match may lie back at most. Of several rows of right at one time one is taken. Columns of right that
    left has too get the suffix ``_asof``. Rows of either side without symbol or ts match nothing. Both sides are laid into one series: a row of left takes what
    the last row of right before it has, so there is no join of times.
    """
    take = columns if columns is not None else [c for c in right.columns if c not in (key, "ts")]
    names = {c: f"{c}_asof" if c in left.columns else c for c in take}
    held = F.struct(F.col("ts").alias("__at"), *[F.col(c).alias(f"__r{i}") for i, c in enumerate(take)])
    found = right.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(F.col(key), "ts", F.lit(1 if strict else 0).alias("__side"), held.alias("__held"), *[F.lit(None).cast(f.dataType).alias(f"__l{i}") for i, f in enumerate(left.schema)])
    asking = left.select(F.col(key), "ts", F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(found.schema["__held"].dataType).alias("__held"), *[F.col(c).alias(f"__l{i}") for i, c in enumerate(left.columns)])
    known = F.col(key).isNotNull() & F.col("ts").isNotNull()
    out = running(found.unionByName(asking.where(known)), {"__last": ("last", "__held")}, ["ts", "__side"], key).where(F.col("__side") == (0 if strict else 1))
    ok = F.lit(True) if within is None else F.col("__last.__at") >= F.col("ts") - F.expr(f"INTERVAL {within}")
    own = [F.col(f"__l{i}").alias(c) for i, c in enumerate(left.columns)]
    matched = out.select(*own, *[F.when(ok, F.col(f"__last.__r{i}")).alias(names[c]) for i, c in enumerate(take)])
    return matched.unionByName(asking.where(~known).select(*own, *[F.lit(None).cast(right.schema[c].dataType).alias(names[c]) for c in take]))


def meets_any(spans: DataFrame, others: DataFrame, out: str = "meets", key: str = "symbol") -> DataFrame:
    """spans (symbol, t0, t1) with whether each meets any of others (symbol, s, e); null where t0 or t1 is.

    A sweep: of the intervals that begin by t1, the greatest end tells. Sides are of any size; no pair is made.
    """
    ends = others.where(F.col(key).isNotNull() & F.col("s").isNotNull() & F.col("e").isNotNull()).select(F.col(key).alias("__key"), F.col("s").alias("__ts"), F.lit(0).alias("__side"), F.col("e").alias("__e"), *[F.lit(None).cast(f.dataType).alias(f"__l{i}") for i, f in enumerate(spans.schema)])
    known = F.col(key).isNotNull() & F.col("t0").isNotNull() & F.col("t1").isNotNull()
    asking = spans.select(F.col(key).alias("__key"), F.col("t1").alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast(ends.schema["__e"].dataType).alias("__e"), known.alias("__known"), *[F.col(c).alias(f"__l{i}") for i, c in enumerate(spans.columns)])
    own = [F.col(f"__l{i}").alias(c) for i, c in enumerate(spans.columns)]
    swept = running(ends.unionByName(asking.where("__known").drop("__known")), {"__end": ("max", "__e")}, ["__ts", "__side"], "__key").where("__side = 1")
    found = swept.select(*own, "__end").withColumn(out, F.coalesce(F.col("__end") >= F.col("t0"), F.lit(False))).drop("__end")
    return found.unionByName(asking.where("not __known").select(*own, F.lit(None).cast("boolean").alias(out)))
