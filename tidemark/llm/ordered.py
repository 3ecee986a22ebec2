"""Places of rows within their group, without a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def numbered(df: DataFrame, key: str, order: list[str], name: str = "ordered") -> DataFrame:
    """df with ``__part`` and ``__pos``, the place from 1 of each row among those of its key, ordered by ``order`` (nulls first).

    Rows are range-partitioned by key and order, so a key with very many rows is shared by several tasks, each of which
    counts along its sorted rows. Only the first key of a partition can have rows in earlier ones: the list of such
    counts has at most one row per partition and is broadcast. The key (of an integer type) must not be null.
    """
    keys = [key, *order, "__tie"]
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie").withColumn("__part", F.spark_partition_id())
    at = ranged.columns.index(key)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k = pc.cast(batch.column(at), pa.int64()).to_numpy(zero_copy_only=False)
            new = np.r_[k[0] != last if last is not None else True, k[1:] != k[:-1]]
            start = np.where(new, np.arange(len(k)), 0)
            start = np.maximum.accumulate(start)
            place = np.arange(len(k)) - start + 1
            place[: np.argmax(new) if new.any() else len(k)] += seen  # the key that goes on from the batch before
            last, seen = k[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "__local"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    stored = materialise(ranged.mapInArrow(count, f"{fields}, __local long"), name)
    held = stored.groupBy(F.col(key).alias("__k"), F.col("__part").alias("__q")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__k").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("__before", F.sum("__n").over(earlier)).where("__before is not null").select("__k", "__q", "__before")  # at most one row per partition
    joined = stored.join(F.broadcast(before), (F.col(key) == F.col("__k")) & (F.col("__part") == F.col("__q")), "left")
    return joined.select(*df.columns, "__part", (F.col("__local") + F.coalesce("__before", F.lit(0))).alias("__pos"))
