"""The prefix trie of conversations: which openings they share, how many leaves and repeated words lie below each.

A node is a sequence of first turns. Its key is a digest of the sequence: the exclusive or, over the turns, of SHA-256
of (place, digest of the turn), in four lanes of 60 bits. Such keys are running aggregates, so a conversation of any length is
cut among tasks, and the key of the parent follows from the row itself. (Nobody can hit on two sequences with one key by
chance; somebody who writes turns for that purpose could.) Parent edges join keys once; from then on a node is known by
its depth and least conversation.

The rollup jumps pointers: after k rounds a node knows its ancestor 2^k above it and the sums over its descendants less than
2^k below. A round adds to each node what the nodes that point to it hold, and replaces pointers by the pointers of their targets,
so rounds grow with the logarithm of the depth. Contributions to a node are summed on the map side first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise
from .ordered import numbered

LANES = 4
KEY = [f"k{i}" for i in range(LANES)]


def turns_in_order(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``depth``, ``part``, ``digest``, ``words`` of each row: its place in its conversation, a digest of role and text, words of the text.

    Turns are ordered nulls first, ties by role and then by digest of role and text; equal rows are turns of their own. Null roles and texts are empty. Rows
    without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return numbered(rows, "conv_id", ["turn", "role", "digest"], "turns").select("conv_id", F.col("__pos").alias("depth"), F.col("__part").alias("part"), "digest", "words")


def spliced(turns: DataFrame, first_turns: Column, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns (``first_turns``, an expression over ``conv_id``, at most 3) are those of conversation conv_id - conv_id % every; and all conv_ids.

    Where that conversation has fewer, all of them; where there is none, none. Own turns follow after the first h.
    """
    heads = turns.where("depth <= 3").select(F.col("conv_id").alias("base"), "depth", F.lit(-1).alias("part"), "digest", "words")
    held = heads.groupBy("base").agg(F.max("depth").alias("has"))
    convs = turns.groupBy("conv_id").agg(F.max("depth").alias("own")).withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", first_turns.cast("long"))
    convs = materialise(convs.join(held, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("taken")), "convs")
    copied = convs.join(heads, "base").where(F.col("depth") <= F.col("h")).select("conv_id", "depth", "part", "digest", "words")
    own = turns.join(convs, "conv_id").where(F.col("depth") > F.col("h")).select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "part", "digest", "words")
    return copied.unionByName(own), convs.select("conv_id")


def _with_keys(turns: DataFrame) -> DataFrame:
    """Turns with the key of their prefix (k0..) and of the prefix before (p0..)."""
    lanes = [f"l{i}" for i in range(LANES)]
    placed = turns.withColumn("__h", F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")), 256))
    placed = placed.select("conv_id", "part", "depth", "words", *[F.conv(F.substring("__h", 15 * i + 1, 15), 16, 10).cast("long").alias(c) for i, c in enumerate(lanes)])
    upto = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = materialise(placed.withColumns({f"x{i}": F.bit_xor(c).over(upto) for i, c in enumerate(lanes)}), "prefixes")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = local.groupBy("conv_id", "part").agg(*[F.bit_xor(c).alias(c) for c in lanes])
    before = total.select("conv_id", "part", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"b{i}") for i, c in enumerate(lanes)])
    joined = local.join(before, ["conv_id", "part"])
    key = [F.col(f"x{i}").bitwiseXOR(F.col(f"b{i}")) for i in range(LANES)]
    return joined.select("conv_id", "depth", "words", *[k.alias(KEY[i]) for i, k in enumerate(key)], *[k.bitwiseXOR(F.col(lanes[i])).alias(f"p{i}") for i, k in enumerate(key)])


def _list_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined conv_ids, in numeric order, of each node (depth and key).

    Ids are range-partitioned, each partition joins its share of a node's list, and one stream per node feeds the pieces to
    the hash, which goes through the whole list of a node in order; no list is held whole.
    """
    node = ["depth", *KEY]
    ranged = materialise(ends.select(*node, "conv_id").repartitionByRange(*node, "conv_id").withColumn("part", F.spark_partition_id()), "ends")
    pieces = ranged.groupBy(*node, "part").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("piece"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in zip(*done, strict=True)], pa.array(hashes, pa.string())], names=[*node, "ends_sha256"])

        now, state, done, hashes = None, None, [], []
        for batch in batches:
            for *at, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != now:
                    if now is not None:
                        done.append(now), hashes.append(state.hexdigest())
                    now, state = at, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if done:
                yield out()
                done, hashes = [], []
        if now is not None:
            done.append(now), hashes.append(state.hexdigest())
            yield out()

    sorted_pieces = pieces.repartition(*node).sortWithinPartitions(*node, "part").select(*[F.col(c).cast("long") for c in node], "piece")
    return sorted_pieces.mapInArrow(digest, ", ".join(f"{c} long" for c in node) + ", ends_sha256 string")


def rollup(nodes: DataFrame, root: int, deepest: int, sums: list[str]) -> DataFrame:
    """``depth``, ``conv_id`` and each of ``sums`` added up over the subtree of every node, by pointer jumping.

    ``nodes`` has depth, conv_id (together unique), parent_conv_id and the values; ``root`` is the conv_id of the one node of depth 0.
    """
    state = nodes.select("depth", "conv_id", F.col("parent_conv_id").alias("up"), *sums)
    step = 1
    while step <= deepest:
        pointing = state.where(F.col("depth") >= step)
        gains = pointing.groupBy((F.col("depth") - step).alias("depth"), F.col("up").alias("conv_id")).agg(*[F.sum(c).alias(f"__{c}") for c in sums])
        far, near = pointing.where(F.col("depth") > 2 * step), state.where(F.col("depth") <= 2 * step)
        targets = state.select((F.col("depth") + step).alias("depth"), F.col("conv_id").alias("up"), F.col("up").alias("__next")).where(F.col("__next").isNotNull())
        moved = far.join(targets, ["depth", "up"]).select("depth", "conv_id", F.col("__next").alias("up"), *sums)
        rest = near.select("depth", "conv_id", F.when(F.col("depth") == 2 * step, F.lit(root)).alias("up"), *sums)
        state = moved.unionByName(rest).join(gains, ["depth", "conv_id"], "left").select("depth", "conv_id", "up", *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in sums])
        state = materialise(state, "rollup")
        step *= 2
    return state.select("depth", "conv_id", *sums)


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row per node of the prefix trie of ``turns`` (as ``turns_in_order`` or ``spliced`` give them), the root included.

    ``conv_id`` least member, ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` of the
    subtree, ``ends_sha256`` of the members that end there. ``convs`` are all conv_ids, those without turns too (by default those of the turns).
    No conversations give no rows. Equal conversations share all nodes.
    """
    convs = convs if convs is not None else turns.select("conv_id").distinct()
    first, n_all = convs.agg(F.min("conv_id"), F.count("conv_id")).first()
    spark = turns.sparkSession
    names = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not n_all:
        return spark.createDataFrame([], names)
    rows = materialise(_with_keys(turns), "keys")
    nodes = rows.groupBy("depth", *KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), *[F.min(f"p{i}").alias(f"p{i}") for i in range(LANES)])
    nodes = materialise(nodes, "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    above = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(KEY)], F.col("conv_id").alias("parent_conv_id"))
    lower = nodes.where("depth > 1").join(above, ["depth", *[f"p{i}" for i in range(LANES)]])
    kept = ["depth", *KEY, "conv_id", "parent_conv_id", "n_convs", "words"]
    root = spark.createDataFrame([(0, *[0] * LANES, first, None, n_all, 0)], ", ".join(f"{c} long" for c in kept))
    tree = materialise(lower.select(kept).unionByName(nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(first)).select(kept)).unionByName(root), "tree")
    children = tree.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = materialise(tree.join(children, ["depth", "conv_id"], "left").fillna(0, ["n_children"]), "tree")
    leaf = (F.col("n_children") == 0).cast("long")
    sums = rollup(tree.select("depth", "conv_id", "parent_conv_id", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), first, deepest, ["n_leaves", "saved_tokens"])
    length = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    last = rows.select("depth", *KEY, "conv_id").join(length, ["conv_id", "depth"])
    silent = convs.join(length, "conv_id", "left_anti").select(F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in KEY], "conv_id")
    hashes = _list_hashes(last.select("depth", *KEY, "conv_id").unionByName(silent))
    out = tree.join(sums, ["depth", "conv_id"]).join(hashes, ["depth", *KEY], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
