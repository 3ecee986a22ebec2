"""Similarity join of texts by the Jaccard coefficient of their word shingles, through a MinHash LSH forest.

Each text has ``trees`` labels of up to ``depth`` MinHash values. In a forest, texts that share the first d values of a label meet in a node
at depth d of its tree; nodes nest, so the texts of a node are those of all deeper ones below it. Only one depth is built, as hashed
prefixes: the longest at which a pair at the threshold shares a node of some tree with the target recall, by calculation. (Prefixes are
not shortened text by text; that could only add the nodes of other depths.) Texts of a node are tied to its least member, and the ties'
connected components are small sets in which all pairs are then compared exactly: by products of shingle incidence
matrices, in blocks. Large components are cut into blocks, and pairs of blocks are separate tasks that give counts
per text and a spanning forest, not pairs. Members of a ball of half the distance threshold around a large component's
pivot are all within the threshold of each other (Jaccard distance is a metric), so those are counted, not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty
from .components import connected_components

#: Texts of a block of a large component, and texts whose small components share a task.
BLOCK, BIN = 1024, 2048
#: Texts in components up to which their list (56 bytes each) is broadcast to find the texts; beyond, the join shuffles these.
BROADCAST_ROWS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of n lower-cased words; of all its words if there are fewer."""
    w = np.fromiter((xxhash.xxh64_intdigest(x) for x in (text or "").lower().encode("utf-8", "surrogatepass").split()), np.uint64)
    if not len(w):
        return w
    n = min(n, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        h = h * _MIX + w[k : k + len(h)]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return np.unique(h)


def forest_depth(threshold: float, recall: float, trees: int, depth: int) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with at least the target probability."""
    d = depth
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def labels(sets: list[np.ndarray], trees: int, depth: int, used: int) -> np.ndarray:
    """Keys of the nodes at depth ``used``: one row per set, one column per tree."""
    rng = np.random.default_rng(9)
    odd = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    keys = np.zeros((len(sets), trees), np.uint64)
    for t in range(trees):
        key = np.full(len(sets), t + 1, np.uint64)
        for d in range(used):
            key = (key ^ np.minimum.reduceat(flat * odd[t * depth + d], at)) * _MIX
            key ^= key >> np.uint64(31)
        keys[:, t] = key
    return keys.view(np.int64)


def similar(sets: list[np.ndarray], threshold: float, split: int | None = None, ball: np.ndarray | None = None) -> np.ndarray:
    """Which sets have at least the threshold's Jaccard coefficient, as a square matrix; with ``split`` only between the first ``split`` and the others."""
    m, sizes = len(sets), np.array([len(s) for s in sets], np.float64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(m), sizes.astype(np.int64))
    _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[col] > 1
    names, col = np.unique(col[shared], return_inverse=True)
    row = row[shared]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((m, m), np.float32)
    width = 8192
    for lo in range(0, len(names), width):
        a, z = np.searchsorted(col, [lo, lo + width])
        part = np.zeros((m, min(width, len(names) - lo)), np.float32)
        part[row[a:z], col[a:z] - lo] = 1
        common += part @ part.T
    hit = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(hit, False)
    if split is not None:
        hit[:split, :split] = False
        hit[split:, split:] = False
    if ball is not None:
        hit &= ~(ball[:, None] & ball[None, :])
    return hit


def roots(hit: np.ndarray) -> np.ndarray:
    """For each row the first row of its component."""
    label = np.arange(len(hit))
    while True:
        near = np.where(hit, label[None, :], len(hit)).min(1, initial=len(hit))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, threshold: float = 0.8, recall: float = 0.99, trees: int = 16, depth: int = 8, block: int = BLOCK,
) -> DataFrame:
    """Per row of df: id, ``class_id``, ``n_links`` and ``n_copies``.

    ``n_links`` counts the other different texts with a coefficient of ``threshold`` or more; ``class_id`` is the least id among texts
    that such links connect, equal texts included; ``n_copies`` counts the rows with the same text. A null text is an empty
    one; a text without words has no links. Repeated rows count as copies; a class whose ids are all null has a null ``class_id``.
    """
    used = forest_depth(threshold, recall, trees, depth)
    digest: list[Column] = [F.xxhash64("t").alias("d1"), F.xxhash64(F.lit(7), "t").alias("d2")]
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = []
            texts = batch.column(3)
            for lo in range(0, len(texts), 256):
                sets = [shingles(x.as_py(), n) for x in texts.slice(lo, 256)]
                some = [s for s in sets if len(s)]
                keys = iter(labels(some, trees, depth, used) if some else [])
                out += [next(keys) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))], names=["id", "d1", "d2", "keys"])

    id_type = df.schema[id_col].dataType.simpleString()
    signed = materialise(rows.select("id", *digest, "t").mapInArrow(sign, f"id {id_type}, d1 long, d2 long, keys array<long>"), "signed")
    texts = signed.groupBy("d1", "d2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_copies"), F.first("keys").alias("keys"))
    texts = materialise(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    nodes = texts.select("node", F.explode("keys").alias("key"))
    shared = nodes.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "head")
    ties = nodes.join(shared, "key").where(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    parts = connected_components(ties)
    parts = parts.join(parts.groupBy("label").agg(F.count(F.lit(1)).alias("m")), "label")
    members = materialise(parts.join(texts.select("node", "d1", "d2", "least"), "node").select("node", "label", "m", "d1", "d2", F.col("least").alias("id")), "members")
    n_members = members.count()
    bins = max(1, -(-n_members // BIN))
    full = rows.select("id", *digest, "t")
    wanted = F.broadcast(members) if n_members <= BROADCAST_ROWS else members
    full = full.join(wanted, ["d1", "d2"]).where(full["id"].eqNullSafe(members["id"])).select("node", "label", "m", F.col("t").alias("text"))
    big = members.where(F.col("m") > block).limit(1).count() > 0
    small = full.where(F.col("m") <= block).select(F.pmod(F.xxhash64("label"), F.lit(bins)).alias("task"), "node", "label", "text")

    def within(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates("node").sort_values(["label", "node"], ignore_index=True)
        out = []
        for _, part in g.groupby("label", sort=False):
            hit = similar([shingles(t, n) for t in part["text"]], threshold)
            name = part["node"].to_numpy()
            out.append(pd.DataFrame({"node": name, "links": hit.sum(1), "root": name[roots(hit)]}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "root": []})

    found = small.groupBy("task").applyInPandas(within, "node long, links long, root long")
    if big:
        links, forest = _large(full.where(F.col("m") > block), block, threshold, n)
        top = connected_components(forest, "node", "root").select("node", F.col("label").alias("root"))
        found = found.unionByName(links.join(top, "node", "left").select("node", "links", F.coalesce("root", "node").alias("root")))
    found = materialise(found, "links")
    names = found.join(texts.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("class_id"))
    found = found.join(names, "root").select("node", "links", "class_id")
    per_text = texts.select("node", "d1", "d2", "least", "n_copies").join(found, "node", "left").select(
        "d1", "d2", "n_copies", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"),
    )
    return signed.select("id", "d1", "d2").join(per_text, ["d1", "d2"]).select(F.col("id").alias(id_col), "class_id", F.col("n_links").cast("long").alias("n_links"), F.col("n_copies").cast("long").alias("n_copies"))


def _large(full: DataFrame, block: int, threshold: float, n: int) -> tuple[DataFrame, DataFrame]:
    """Links per text of components beyond a block, and edges that span what the links connect."""
    full = materialise(full.dropDuplicates(["node"]), "large")
    first = full.groupBy("label").agg(F.min("node").alias("node"))  # a component's pivot is its least text
    pivots = full.join(first, ["label", "node"]).select("label", F.col("node").alias("pivot"), F.col("text").alias("pivot_text"))
    compared = full.join(pivots, "label")
    near = 1 - (1 - threshold) / 2

    def to_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            out = []
            for node, pivot, text, ptext in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if last[0] != pivot:
                    last = (pivot, shingles(ptext, n))
                own = shingles(text, n)
                both = len(np.intersect1d(own, last[1], assume_unique=True))
                out.append(both >= near * (len(own) + len(last[1]) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["node", "pivot", "ball"])

    ball = materialise(compared.select("node", "pivot", "text", "pivot_text").mapInArrow(to_pivot, "node long, pivot long, ball boolean"), "balls")
    sizes = ball.groupBy("pivot").agg(F.sum(F.col("ball").cast("long")).alias("in_ball"), F.sum((~F.col("ball")).cast("long")).alias("outside"))
    placed = full.join(ball, "node").join(sizes, "pivot")
    inner, outer = (F.ceil(F.col(c) / block).cast("long") for c in ("in_ball", "outside"))
    spot = F.when(F.col("ball"), F.pmod(F.xxhash64("node"), F.greatest(inner, F.lit(1)))).otherwise(inner + F.pmod(F.xxhash64("node"), F.greatest(outer, F.lit(1))))
    placed = placed.withColumn("own", spot).withColumn("inner", inner).withColumn("blocks", inner + outer)
    other = F.when(F.col("ball"), F.sequence(F.col("inner"), F.col("blocks"))).otherwise(F.sequence(F.lit(0), F.col("blocks")))  # the last is no block
    placed = placed.withColumn("other", F.explode(F.slice(other, 1, F.size(other) - 1)))
    tasks = placed.select("pivot", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "text")

    def across(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["own", "node"], ignore_index=True)
        split = int((g["own"] == key[1]).sum()) if key[1] != key[2] else None
        if len(g) < 2 or split == len(g):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        hit = similar([shingles(t, n) for t in g["text"]], threshold, split)
        name = g["node"].to_numpy()
        return pd.DataFrame({"node": name, "links": hit.sum(1), "root": name[roots(hit)]})

    counted = materialise(tasks.groupBy("pivot", "x", "y").applyInPandas(across, "node long, links long, root long"), "block-links")
    inside = ball.join(sizes, "pivot").select("node", F.when(F.col("ball"), F.col("in_ball") - 1).otherwise(0).alias("links"), F.when(F.col("ball"), F.col("pivot")).otherwise(F.col("node")).alias("root"))
    every = counted.unionByName(inside)
    return every.groupBy("node").agg(F.sum("links").cast("long").alias("links")), every.select("node", "root").distinct()
