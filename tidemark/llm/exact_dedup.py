"""Exact duplicates by content sort, in DataFrame operations only.

Rows are range-partitioned by sampled splitters over the normalised content (its first characters, then a
hash, so that splitters stay short), each partition is sorted externally, which places equal texts side by
side, and the window operator walks the sorted rows and compares each with its neighbour over the full text.

A text with very many copies would fill one range. Such texts are counted first (by hash, combined on the map
side) and their rows get a salt in the range key, so that several ranges share them; the one row that each
salted run keeps, a few per hot text, is then compared once more over the full text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NORMALISERS = {
    "none": lambda c: c,
    "lower": F.lower,
    "whitespace": lambda c: F.trim(F.regexp_replace(c, r"[\x20\x09-\x0D]+", " ")),
    "lower_whitespace": lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\x20\x09-\x0D]+", " ")),
}


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "min", normalise: str = "none",
    columns: list[str] | None = None, hot_share: float = 0.125,
) -> DataFrame:
    """Return each row of df with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    A null text counts as empty. ``keep`` is ``min`` or ``max``: of equal texts the row with that id stays, a row
    with a null id only when no other has one, and of rows with the same id exactly one. ``columns`` are further
    columns of df to carry along (by default none); an empty table gives no rows. A text is hot when its copies
    exceed ``hot_share`` of a partition's even share of the rows, so there are at most partitions / hot_share hot texts.
    """
    spark = df.sparkSession
    clean: Column = NORMALISERS[normalise](F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    carried = [c for c in columns or [] if c not in (id_col, text_col) or c == text_col and normalise != "none"]
    own = [F.col(c).alias(f"__c{k}") for k, c in enumerate(carried)]
    rows = df.select(F.col(id_col).alias("__id"), *own, clean.alias("__t"), F.col(text_col).isNull().alias("__null")).withColumn("__h", F.xxhash64("__t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = max(2.0, df.count() * hot_share / parts)
    hot = rows.groupBy("__h").count().where(F.col("count") > least).select("__h", F.ceil(F.col("count") / least).cast("int").alias("__salts"))
    hot_rows = hot.collect()  # at most parts / hot_share
    if hot_rows:
        hot = spark.createDataFrame(hot_rows, hot.schema)
        rows = rows.join(F.broadcast(hot), "__h", "left").withColumn(
            "__salt", F.coalesce(F.pmod(F.xxhash64("__id", F.lit(7)), F.col("__salts").cast("bigint")), F.lit(-1).cast("bigint"))
        ).drop("__salts")
    else:
        rows = rows.withColumn("__salt", F.lit(-1).cast("bigint"))
    rows = rows.withColumn("__p", F.substring("__t", 1, 24)).repartitionByRange("__p", "__h", "__salt")
    by_id = F.col("__id").desc_nulls_last() if keep == "max" else F.col("__id").asc_nulls_last()
    run = Window.partitionBy("__p", "__h", "__salt", "__t")
    found = (
        rows.withColumn("__rn", F.row_number().over(run.orderBy(by_id)))
        .withColumn("__keep", F.first("__id").over(run.orderBy(by_id)))
        .withColumn("__n", F.count(F.lit(1)).over(run))
        .withColumn("text_sha256", F.sha2("__t", 256))
    )
    if hot_rows:
        text = Window.partitionBy("__h", "__t")
        heads = (
            found.where((F.col("__salt") >= 0) & (F.col("__rn") == 1))
            .select(
                F.col("text_sha256").alias("__hs"), F.col("__salt").alias("__hsalt"),
                F.first("__keep").over(text.orderBy(F.col("__keep").desc_nulls_last() if keep == "max" else F.col("__keep").asc_nulls_last(), "__salt")).alias("__gkeep"),
                F.sum("__n").over(text).alias("__gn"),
                (F.row_number().over(text.orderBy(F.col("__keep").desc_nulls_last() if keep == "max" else F.col("__keep").asc_nulls_last(), "__salt")) == 1).alias("__top"),
            )
        )
        found = (found if text_col in (columns or []) else found.drop("__t")).join(heads, (F.col("text_sha256") == F.col("__hs")) & (F.col("__salt") == F.col("__hsalt")), "left")
        found = found.withColumn("__kept", (F.col("__rn") == 1) & F.coalesce(F.col("__top"), F.lit(True)))
        found = found.withColumn("__keep", F.when(F.col("__hs").isNotNull(), F.col("__gkeep")).otherwise(F.col("__keep"))).withColumn("__n", F.coalesce("__gn", "__n"))
    else:
        found = found.withColumn("__kept", F.col("__rn") == 1)
    back = {c: F.col(f"__c{k}") for k, c in enumerate(carried)}
    if text_col in (columns or []) and normalise == "none":
        back[text_col] = F.when(~F.col("__null"), F.col("__t"))  # the same bytes: not carried twice
    return found.select(
        F.col("__id").alias(id_col), *[back[c].alias(c) for c in columns or [] if c != id_col], F.col("__keep").alias("keep_id"),
        F.col("__n").cast("long").alias("group_size"), F.col("__kept").alias("kept"), "text_sha256",
    )
