"""Damaged conversations: which faults they have and the cheapest edits that give them a legal order of roles.

Edits form a graph: a node is (rows consumed, state of the pattern ``(s?(ua)+)?``), arcs are Delete, Insert, Keep and Rerole with small
integer costs. Dial's bucket queue, run from the end backwards, records the least cost from every node to the end; the
audit is then the walk from the start that takes, among the tight arcs, the one with the least initial. A letter leads to one
successor, so that walk is the least string of all the cheapest.

Conversations are cut into chunks of at most 4,096 rows (``chunk``), so none lies whole in one task. Costs across a chunk are a 4 x 4 table
in (min, +) algebra; longer conversations fold these tables from the right, then walk their chunks with the costs beyond each chunk's end,
and fold the states from the left. What stays in order is the SHA-256 of the repaired text, which one stream per conversation computes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .ordered import numbered

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
OK, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end. The next role that an insertion or a new role can give, and where it leads.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ENDS = (0, None, None, 0)
BEFORE = {q: [p for p in range(4) if NEXT[p] == q] for q in range(4)}
KEPT = {(c, q): [p for p in range(4) if KEEP.get((c, p)) == q] for c in "sua" for q in range(4)}
WHITE = " \t\n\x0b\x0c\r"


def distances(initials: str, faults: bytes, beyond, last: bool) -> list:
    """Least cost from each node (4 * row + state) to the end, given the costs ``beyond`` it of each state (None: no way). ``last``: rows may be inserted at the end too."""
    n = len(initials)
    dist: list = [None] * (4 * n + 4)
    buckets = defaultdict(list)
    for q, cost in enumerate(beyond):
        if cost is not None:
            buckets[cost].append(4 * n + q)
    now = min(buckets, default=0)
    while buckets:
        bucket = buckets.get(now)
        if bucket is None:
            now += 1
            continue
        for node in bucket:  # grows by arcs of cost 0
            if dist[node] is not None:
                continue
            dist[node] = now
            i, q = divmod(node, 4)
            if i < n or last:
                for p in BEFORE[q]:
                    buckets[now + INSERT].append(4 * i + p)
            if i:
                fault, above = faults[i - 1], 4 * i - 4
                buckets[now + DELETE].append(above + q)
                if fault != BLANK and fault != DUPLICATE:
                    more = TRUNCATED if fault == CUT else 0
                    for p in BEFORE[q]:
                        buckets[now + REROLE + more].append(above + p)
                    for p in KEPT.get((initials[i - 1], q), ()):
                        buckets[now + more].append(above + p)
        del buckets[now]
    return dist


def walk(dist: list, initials: str, faults: bytes, state: int, last: bool) -> tuple[str, int]:
    """The least string of edit initials along tight arcs from ``state`` at the first row, and the state at the end."""
    n, i, q, out = len(initials), 0, state, []
    while True:
        here = dist[4 * i + q]
        if i == n and (not last or here == 0):
            return "".join(out), q
        if i < n and dist[4 * i + 4 + q] is not None and dist[4 * i + 4 + q] + DELETE == here:
            out.append("D")
            i += 1
        elif (i < n or last) and dist[4 * i + NEXT[q]] + INSERT == here:
            out.append("I")
            q = NEXT[q]
        else:
            more = TRUNCATED if faults[i] == CUT else 0
            kept = KEEP.get((initials[i], q))
            if kept is not None and dist[4 * i + 4 + kept] is not None and dist[4 * i + 4 + kept] + more == here:
                out.append("K")
                q = kept
            else:
                out.append("R")
                q = NEXT[q]
            i += 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, chunk, initials, faults) of each run of rows sorted by conversation and chunk."""
    now, letters, marks = None, [], []
    for batch in batches:
        for conv, chunk, letter, mark in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            if (conv, chunk) != now:
                if now is not None:
                    yield (*now, "".join(letters), bytes(marks))
                now, letters, marks = (conv, chunk), [], []
            letters.append(letter or " ")
            marks.append(mark)
    if now is not None:
        yield (*now, "".join(letters), bytes(marks))


def _solve(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of a conversation of one short chunk the audit and cost; of other chunks the table of costs from state to state, and to the end of the conversation."""
    out = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "chunk", "audit", "cost", "costs", "illegal", "first", "final"])

    for conv, chunk, letters, faults in _chunks(batches):
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
        ending = distances(letters, faults, ENDS, True)
        if chunk == 0 and len(letters) < most:
            out.append((conv, chunk, walk(ending, letters, faults, 0, True)[0], ending[0], None, illegal, letters[0], letters[-1]))
        else:
            costs = [c for q in range(4) for c in distances(letters, faults, [0 if p == q else None for p in range(4)], False)[:4]]  # costs[4 * exit + entry]
            out.append((conv, chunk, None, None, costs + ending[:4], illegal, letters[0], letters[-1]))
        if len(out) >= 2000:
            yield flush()
            out = []
    if out:
        yield flush()


def _beyond(group: pd.DataFrame) -> pd.DataFrame:
    """Costs beyond the end of each chunk of one conversation, folded from its last chunk."""
    group = group.sort_values("chunk")
    tables = [np.array([np.inf if x is None or x != x else x for x in c], float) for c in group["costs"]]
    after = [None] * len(tables)
    left = tables[-1][16:]
    for k in range(len(tables) - 2, -1, -1):
        after[k] = [int(x) for x in left]
        left = (tables[k][:16].reshape(4, 4) + left[:, None]).min(0)
    return pd.DataFrame({"conv_id": group["conv_id"], "chunk": group["chunk"], "beyond": after, "cost": np.int64(left[0])})


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk, its walk from each of the four states: the letters and the state at its end. Rows carry ``beyond`` in the fifth column."""

    def marked() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held.update({(c, k): b for c, k, b in zip(*[batch.column(x).to_pylist() for x in (0, 1, 4)], strict=True)})
            yield batch

    held: dict = {}
    for conv, chunk, letters, faults in _chunks(marked()):
        beyond = held.pop((conv, chunk))
        last = beyond is None
        dist = distances(letters, faults, ENDS if last else beyond, last)
        ways = [walk(dist, letters, faults, q, last) for q in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([chunk]), pa.array([[w for w, _ in ways]]), pa.array([[q for _, q in ways]], pa.list_(pa.int64()))], names=["conv_id", "chunk", "letters", "exits"])


def _entries(group: pd.DataFrame) -> pd.DataFrame:
    """The state in which the walk of a conversation enters each chunk."""
    group = group.sort_values("chunk")
    entry, q = [], 0
    for exits in group["exits"]:
        entry.append(q)
        q = int(exits[q])
    return pd.DataFrame({"conv_id": group["conv_id"], "chunk": group["chunk"], "entry": entry})


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each repaired conversation from rows sorted by conversation and place; before each chunk comes a row with null role and the chunk's letters as text."""
    now, state, letters, at, q, first = None, None, "", 0, 0, True

    def put(role: str, text: str) -> None:
        nonlocal first
        state.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False

    def inserts() -> None:
        nonlocal at, q
        while at < len(letters) and letters[at] == "I":
            put(ROLE[q], "")
            q, at = NEXT[q], at + 1

    for batch in batches:
        ids, hashes = [], []
        for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
            if conv != now:
                if now is not None:
                    inserts()
                    ids.append(now), hashes.append(state.hexdigest())
                now, state, letters, at, q, first = conv, hashlib.sha256(), "", 0, 0, True
            if role is None:
                letters, at = text, 0
                continue
            inserts()
            edit, at = letters[at], at + 1
            if edit == "K":
                put(role, text)
                q = KEEP[role[:1], q]
            elif edit == "R":
                put(ROLE[q], text)
                q = NEXT[q]
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes)], names=["conv_id", "repaired_sha256"])
    if now is not None:
        inserts()
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])


def damaged(df: DataFrame, mode: Column) -> DataFrame:
    """Rows of conversations with faults put in: ``mode`` 0 drops a row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats it, 4 makes the user its author. Null roles and texts are one space."""
    rows = df.withColumn("__mode", mode).where("__mode <> 0")
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    text = F.when(F.col("__mode") == 1, "").when(F.col("__mode") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("__mode") == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" ")))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("__mode") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy")).drop("__copy")


def repair(df: DataFrame, ids: DataFrame | None = None, *, chunk: int = 4096) -> DataFrame:
    """One row per conversation of df (conv_id, turn, role, text), and of ``ids`` (conv_id) where given.

    ``gaps`` missing turn numbers, ``blank``, ``duplicate`` and ``truncated`` rows by their first fault, ``illegal`` adjacent roles, ``cost`` and
    ``audit`` of the cheapest edits, ``repaired_sha256``. Rows are ordered by turn (nulls first), ties by role and then by digest of the text, so equal rows are
    adjacent; null roles and texts are one space. Rows without conv_id belong to no conversation and are left out. A conversation
    without rows has zeros, an empty audit and the hash of an empty string; an empty table gives no rows.
    """
    space = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *space).withColumn("__digest", F.sha2("text", 256))
    rows = materialise(numbered(rows, "conv_id", ["turn", "role", "__digest"], "turns").drop("__part").withColumnRenamed("__pos", "pos"), "damaged")
    firsts = rows.groupBy("conv_id", "role", "__digest").agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit(True).alias("__first"))
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    marks = rows.select("conv_id", "pos", "turn", F.substring("role", 1, 1).alias("initial"), F.when(end == "", BLANK).when(~F.substring(end, -1, 1).isin(".", "!", "?"), CUT).otherwise(OK).alias("own"))
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("__first").isNull(), DUPLICATE).otherwise(F.col("own"))
    slim = marks.join(firsts, ["conv_id", "pos"], "left").select("conv_id", F.floor((F.col("pos") - 1) / chunk).cast("long").alias("chunk"), "pos", "turn", "initial", fault.cast("int").alias("fault"))
    slim = materialise(slim, "faults")

    chunked = slim.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "pos").select("conv_id", "chunk", "initial", "fault")
    solved = materialise(chunked.mapInArrow(lambda batches: _solve(batches, chunk), "conv_id long, chunk long, audit string, cost long, costs array<long>, illegal long, first string, final string"), "solved")
    short = solved.where("audit is not null").select("conv_id", "chunk", "audit")
    priced = solved.where("audit is not null").select("conv_id", "cost")
    long = solved.where("audit is null")
    if long.limit(1).count():
        beyond = materialise(long.select("conv_id", "chunk", "costs").groupBy("conv_id").applyInPandas(_beyond, "conv_id long, chunk long, beyond array<long>, cost long"), "beyond")
        again = slim.join(beyond, ["conv_id", "chunk"]).repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "pos").select("conv_id", "chunk", "initial", "fault", "beyond")
        ways = materialise(again.mapInArrow(_walks, "conv_id long, chunk long, letters array<string>, exits array<long>"), "walks")
        entries = ways.select("conv_id", "chunk", "exits").groupBy("conv_id").applyInPandas(_entries, "conv_id long, chunk long, entry int")
        short = short.unionByName(ways.join(entries, ["conv_id", "chunk"]).select("conv_id", "chunk", F.element_at("letters", F.col("entry") + 1).alias("audit")))
        priced = priced.unionByName(beyond.groupBy("conv_id").agg(F.min("cost").alias("cost")))
    letters = materialise(short, "letters")

    audit = letters.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    marked = rows.select("conv_id", (2 * F.col("pos")).alias("at"), "role", "text").unionByName(letters.select("conv_id", (2 * F.col("chunk") * chunk + 1).alias("at"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text")))
    hashed = marked.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_repaired, "conv_id long, repaired_sha256 string")

    wide = "decimal(38,0)"
    missing = F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count_distinct("turn").cast(wide)
    counts = slim.groupBy("conv_id").agg(F.coalesce(missing, F.lit(0)).try_cast("long").alias("gaps"), *[F.count_if(F.col("fault") == k).alias(c) for k, c in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))])
    seam = F.lag("final").over(Window.partitionBy("conv_id").orderBy("chunk"))
    seams = solved.select("conv_id", "illegal", (seam.isNotNull() & ~F.concat(seam, "first").isin("su", "ua", "au")).cast("long").alias("__seam"))
    illegal = seams.groupBy("conv_id").agg(F.sum(F.col("illegal") + F.coalesce("__seam", F.lit(0))).alias("illegal"))
    names = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")) if ids is None else ids.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"))
    out = names.distinct()
    for part in (counts, illegal, priced, audit, hashed):
        out = out.join(part, "conv_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
