"""Section 2.12: set operations, sorts, limits, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets as op
from ..sources.views import read
from .book import Book

book = Book()


@book.add("O1_union", "ticks", "SELECT symbol, ts, price FROM ticks WHERE size < 30 UNION ALL SELECT symbol, ts, price FROM ticks WHERE size < 10")
def _(df):
    p = df.select("symbol", "ts", "price", "size")
    return p.where("size < 30").unionByName(p.where("size < 10")).drop("size")


@book.add("O2_keep_first", "ticks", "SELECT symbol, CAST(size AS INTEGER) AS size, ts, price FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol, size ORDER BY ts) = 1")
def _(df):
    return op.keep_first(df.withColumn("size", F.col("size").cast("int")), ["symbol", "size"], [F.col("ts")]).select("symbol", "size", "ts", "price")


@book.add("O3_intersect", "ticks", "SELECT symbol, ts FROM ticks WHERE size > 40 INTERSECT SELECT symbol, ts FROM ticks WHERE price > 20")
def _(df):
    return df.where("size > 40").select("symbol", "ts").intersect(df.where("price > 20").select("symbol", "ts"))


@book.add("O4_sort_descending", "ticks", "SELECT symbol, round(sum(price), 4) AS total FROM ticks GROUP BY symbol ORDER BY total DESC")
def _(df):
    return df.groupBy("symbol").agg(F.round(F.sum("price"), 4).alias("total")).orderBy(F.desc("total"))


@book.add("O5_sort_by_time", "ticks", "SELECT symbol, ts, price FROM ticks ORDER BY ts, symbol")
def _(df):
    return df.select("symbol", "ts", "price").orderBy("ts", "symbol")


@book.add("O6_last_row", "ticks", "SELECT symbol, max(ts) AS ts, arg_max(price, ts) AS price FROM ticks GROUP BY symbol")
def _(df):
    return df.groupBy("symbol").agg(F.max_by(F.struct("ts", "price"), "ts").alias("x")).select("symbol", "x.ts", "x.price")


@book.add("O7_top_k", "ticks", "SELECT symbol, ts, price FROM ticks ORDER BY price DESC, ts LIMIT 10")
def _(df):
    return op.top_k(df.select("symbol", "ts", "price"), 10, F.desc("price"), F.col("ts"))


@book.add(
    "O8_nearest_neighbours", None,
    "SELECT query_id, id, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM"
    " (SELECT q.vec_id AS query_id, e.vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: power(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2)))), 6) AS distance"
    " FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)) WHERE rank <= 5",
)
def _(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return op.nearest(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 5)


@book.add("O9_upsert", "ticks", "SELECT CAST(size AS INTEGER) AS id, count(*) AS n FROM ticks WHERE size < 50 GROUP BY 1 UNION ALL SELECT CAST(size AS INTEGER), -1 FROM ticks WHERE size >= 50 AND size < 80 GROUP BY 1")
def _(df):
    key = F.col("size").cast("int").alias("id")
    new = df.where("size < 50").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    old = df.where("size < 80").groupBy(key).agg(F.lit(-1).cast("long").alias("n"))
    return op.upsert(old, new, "id")


@book.add("O10_combinations", None, "SELECT count(*) AS n_splits FROM (SELECT unnest(range(10)) AS a) x, (SELECT unnest(range(10)) AS b) y WHERE a < b")
def _(spark, sf_dir):
    return op.combinations(spark, 10, 2).agg(F.count(F.lit(1)).alias("n_splits"))
