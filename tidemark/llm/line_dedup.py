"""Fuzzy duplicate lines by MinHash.

A line's signature is a one-permutation MinHash of its character shingles: the hashes are dealt into 24 bins, and a bin's
value is the least hash in it or, where it has none, that of the next bin that has some. Signing and the exact comparison of
shingle sets are numpy over Arrow batches; keys, groups, joins and the union-find are DataFrame operations. Bands of three
values far apart are keys; distinct lines that share a key are compared exactly, over their shingle sets, in two steps:

1. All lines of a key meet one of its lines, and a union-find joins those at the threshold or above. In keys that then
   have thousands of lines outside of their largest component, the lines meet a few more, each only those of other components.
2. Keys that still hold several components: lines outside of a key's largest component meet all its lines of other
   components, in pairs of small blocks. A pair of blocks is one row, which gives pairs of components that span what its
   lines link, never pairs of lines; the pairs of blocks of a key are dealt over as many tasks as they fill.

So no component is split that keys connect, and lines known to be together are not compared again. A second union-find joins the
components, and of each the first line in order of document and place stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty
from .components import connected_components

BINS = 24
#: Heads of an open key in the second round, and lines outside of its largest component from which a key takes part; lines of a block, pairs of blocks that are compared in one place, and lines to a task (a compared pair costs a sixteenth of reading a line).
HEADS, MANY, BLOCK, UNIT, TASK_LINES = 3, 4096, 64, 16, 16_384
#: Equal values of two signatures of 24 from which the sets are compared: a pair at 0.8 has fewer with probability 0.0002.
MATCHES = 12
#: Rows up to which a table of line places, keys or digests is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: No two bands share a bin, so they miss independently of each other.
BANDS = [[b, b + 8, b + 16] for b in range(8)]
#: 16-bit units of lines that are hashed at once; sets of heads that a task keeps.
UNITS, HEAD_SETS = 1 << 16, 4096
_MIX, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(line: Column) -> Column:
    odd = F.lit(False)
    for x in ("  ", *"\t\n\v\f\r"):  # most lines have none of these, and the expression would leave them as they are
        odd = odd | F.contains(line, F.lit(x))
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")).otherwise(line))


def shingles(lines: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines' runs of n 16-bit units, in order, and how many each line has; a line shorter than one shingle is one, as a whole."""
    own = [x.encode("utf-16-le", "surrogatepass") for x in lines]
    size = np.fromiter((len(x) // 2 for x in own), np.int64, len(own))
    u = np.frombuffer(b"".join(x if len(x) >= 2 * n else x.ljust(2 * n, b"\0") for x in own), np.uint16).astype(np.uint64)
    h, k, power = u, 1, int(_MIX)  # a polynomial of k units, whose length doubles
    for bit in f"{n:b}"[1:]:
        h = h[: max(len(h) - k, 0)] * np.uint64(power) + h[k:]
        k, power = 2 * k, power**2 % 2**64
        if bit == "1":
            h = h[: max(len(u) - k, 0)] * _MIX + u[k:]
            k, power = k + 1, power * int(_MIX) % 2**64
    if n == 1:
        h = h.copy()
    count = np.maximum(size - n, 0) + 1
    first = np.cumsum(count + n - 1) - (count + n - 1)
    h = h[np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)]
    if (size < n).any():
        h += np.repeat(np.where(size < n, size + 1, 0).astype(np.uint64) * _END, count)
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _END
    h ^= h >> np.uint64(32)
    return h, count


def in_parts(lines: list[str]) -> Iterator[list[str]]:
    """The lines in order, in runs of about UNITS units; a longer line is a run of its own."""
    part, size = [], 0
    for x in lines:
        if part and size + len(x) > UNITS:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x)
    if part:
        yield part


def sets_of(lines: list[str], n: int) -> list[np.ndarray]:
    """Each line's distinct shingle hashes, sorted."""
    out = []
    for part in in_parts(lines):
        h, count = shingles(part, n)
        for x in np.split(h, np.cumsum(count)[:-1]):
            x.sort()
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
    return out


def least_in_bins(lines: list[str], n: int) -> np.ndarray:
    """The lines' signatures: a row each, the values of the bins, each with its bin in the low five bits."""
    out = [np.zeros((0, BINS), np.int32)]
    for part in in_parts(lines):
        h, count = shingles(part, n)
        at = np.repeat(np.arange(len(part)) * BINS, count) + ((h >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).astype(np.int64)
        none = np.int64(1 << 32)
        v = np.full(len(part) * BINS, none)
        np.minimum.at(v, at, (h & np.uint64(0xFFFFFFFF)).astype(np.int64))
        v = v.reshape(-1, BINS)
        last = v[:, 0]
        for j in [*range(BINS - 1, -1, -1)] * 2:  # twice around, so that the last bins find the first ones
            last = np.where(v[:, j] == none, last, v[:, j])
            v[:, j] = last
        out.append((v & ~31 | np.arange(BINS)).astype(np.uint32).view(np.int32))
    return np.concatenate(out)


def same(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets have at least the threshold's Jaccard coefficient."""
    need = (threshold - 1e-9) / (1 + threshold - 1e-9) * (len(a) + len(b))  # so many in common
    return min(len(a), len(b)) >= need and len(np.intersect1d(a, b, assume_unique=True)) >= need


def alike_sets(xs: list[np.ndarray], ys: list[np.ndarray], threshold: float, width: int = 4096) -> np.ndarray:
    """Which of xs (rows) and ys (columns) have at least the threshold's Jaccard coefficient: products of incidence matrices over the hashes that occur twice, some columns at a time."""
    size = np.array([len(s) for s in xs + ys], np.int64)
    flat, row = np.concatenate(xs + ys), np.repeat(np.arange(len(size)), size)
    order = np.argsort(flat)
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    twice = ~(new & np.append(new[1:], True))
    row, col = row[twice], np.cumsum(new[twice]) - 1
    common = np.zeros((len(xs), len(ys)), np.float32)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, z = np.searchsorted(col, [lo, lo + width])
        part = np.zeros((len(size), width), np.float32)
        part[row[a:z], col[a:z] - lo] = 1
        common += part[: len(xs)] @ part[len(xs) :].T
    need = (threshold - 1e-9) / (1 + threshold - 1e-9) * (size[: len(xs), None] + size[None, len(xs) :])
    return common >= need


def signatures(lines: DataFrame, by: list[str], line_col: str, n: int) -> DataFrame:
    """``by`` and ``v``, the values of the bins, for each row. All shingles of a line sign it, so that a pair's chance to meet depends on its Jaccard similarity alone."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = least_in_bins(batch.column(len(by)).to_pylist(), n)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * BINS), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rows], names=[*by, "v"])

    own = lines.select(*by, line_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[: len(by)])
    return own.mapInArrow(sign, f"{schema}, v array<int>")


def band_keys(v: str) -> Column:
    """A hash per band of a signature."""
    return F.array(*[F.xxhash64(F.lit(b), *[F.get(v, F.lit(j)) for j in band]) for b, band in enumerate(BANDS)])


def _alike(v: Column, w: Column) -> Column:
    return F.size(F.array_intersect(v, w)) >= MATCHES


def near_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 8, threshold: float = 0.8) -> DataFrame:
    """One row per line of each text: id, ``line`` (from 0), ``keep_id``, ``keep_line`` and ``kept``.

    Lines are compared with white space runs as one space, ends trimmed. Blank lines are no one's copy and stay. Of each
    component the line with the least (id, line) stays; rows that repeat with their id are copies, and of exactly equal places all stay.
    A null text is one blank line; a null id comes first in order. Other columns of df play no part, whatever their names; an empty table gives no rows.
    """
    every = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("line", "raw"))
    some = F.col("raw").rlike(r"[^\x20\x09-\x0D]")  # not blank; cheaper to see here than after normalising
    raw = every.where(some)
    digest = [F.xxhash64("t").alias("d1"), F.xxhash64(F.lit(7), "t").alias("d2")]
    lines = raw.select("id", "line", normal(F.col("raw")).alias("t"))
    # Blank lines go along without digests, so that no second pass over the texts looks for them.
    all_lines = every.select("id", "line", F.when(some, normal(F.col("raw"))).alias("t")).select("id", "line", *[F.when(F.col("t").isNotNull(), d).alias(d_) for d, d_ in zip(digest, ("d1", "d2"), strict=True)], F.coalesce("t", F.lit("")).alias("t"))
    places = materialise(signatures(all_lines, ["id", "line", "d1", "d2"], "t", n), "line-places")
    kinds = places.where("d1 is not null").groupBy("d1", "d2").agg(F.min(F.struct("id", "line")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    kinds = materialise(kinds.withColumn("node", F.monotonically_increasing_id()), "line-kinds")
    keyed = kinds.select("node", F.explode(band_keys("v")).alias("key"))
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("least")).where("m > 1")
    groups = groups.groupBy("m", "x", "least").agg(F.min("key").alias("key"))  # of keys with the same lines one does
    keyed = materialise(keyed.join(_small(materialise(groups.select("key"), "line-groups")), "key"), "line-keys")
    wanted_nodes = materialise(keyed.select("node").distinct().join(kinds.select("node", "first.id", "first.line"), "node"), "line-wanted")
    wanted = _small(wanted_nodes)
    texts = lines.join(wanted, lines["id"].eqNullSafe(wanted["id"]) & (lines["line"] == wanted["line"])).select("node", "t").dropDuplicates(["node"])
    texts = materialise(texts.join(kinds.select("node", "v"), "node"), "line-texts")
    forest = wanted_nodes.select("node", F.col("node").alias("label"))
    for heads, least in ((1, 1), (HEADS, MANY)):  # keys of few blocks go to the blocks at once
        rows = _open(keyed, forest, least).where(F.col("m") - F.col("m_main") >= least)
        if rows.limit(1).count():
            forest = materialise(_merged(forest, _star(rows, heads, texts, n, threshold)), "line-forest")
    forest = materialise(_merged(forest, _blocks(_open(keyed, forest, 2), texts, n, threshold)), "line-forest")
    firsts = forest.join(kinds.select("node", "first"), "node")
    keepers = firsts.groupBy("label").agg(F.min("first").alias("keep"))
    kept = firsts.select("node", "label").join(keepers, "label").select("node", "keep")
    chosen = kinds.join(kept, "node", "left").select("d1", "d2", "copies", "first", F.coalesce("keep", "first").alias("keep")).where("copies > 1 or keep <> first").select("d1", "d2", "keep")
    out = places.where("d1 is not null").select("id", "line", "d1", "d2").join(_small(materialise(chosen, "line-chosen")), ["d1", "d2"], "left")
    keep_id, keep_line = F.when(F.col("keep").isNull(), F.col("id")).otherwise(F.col("keep.id")), F.coalesce("keep.line", "line")
    out = out.select("id", "line", keep_id.alias("keep_id"), keep_line.alias("keep_line"))
    blank = places.where("d1 is null").select("id", "line", F.col("id").alias("keep_id"), F.col("line").alias("keep_line"))
    out = out.unionByName(blank)
    return out.select(F.col("id").alias(id_col), "line", "keep_id", "keep_line", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("line") == F.col("keep_line"))).alias("kept"))


def _small(df: DataFrame) -> DataFrame:
    """df, written before, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _open(keyed: DataFrame, forest: DataFrame, least: int) -> DataFrame:
    """``key``, ``node`` and ``label`` of the keys with more than ``least`` lines that hold several components, with the key's largest (``main``), its lines and all lines (``m_main``, ``m``)."""
    rows = keyed.select("key", "node").join(forest, "node")
    by_label = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    several = by_label.groupBy("key").agg(F.max_by("label", "n").alias("main"), F.max("n").alias("m_main"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("labels")).where((F.col("labels") > 1) & (F.col("m") > least)).drop("labels")
    return materialise(rows.join(several, "key"), "line-open")


def _merged(forest: DataFrame, links: DataFrame) -> DataFrame:
    """The forest after components that a link (``a``, ``b``) joins have become one."""
    into = connected_components(materialise(links, "line-links")).select(F.col("node").alias("label"), F.col("label").alias("into"))
    return forest.join(into, "label", "left").select("node", F.coalesce("into", "label").alias("label"))


def _top(into: dict[int, int], x: int) -> int:
    """The root of x in a forest of parents, whose paths shorten on the way."""
    while x in into:
        if into[x] in into:
            into[x] = into[into[x]]
        x = into[x]
    return x


def _star(rows: DataFrame, heads: int, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """Components that a line links to one of its keys' few heads."""
    chosen = rows.groupBy("key").agg(*[F.min_by("node", F.xxhash64("node", F.lit(heads + r))).alias(f"h{r}") for r in range(heads)])
    chosen = chosen.select("key", F.explode(F.array_distinct(F.array(*[f"h{r}" for r in range(heads)]))).alias("head"))
    chosen = chosen.join(rows.select("key", F.col("node").alias("head"), F.col("label").alias("a")), ["key", "head"])
    pairs = rows.join(chosen, "key").where("label <> a").select("head", "node", "a", F.col("label").alias("b")).distinct()
    head_texts = texts.select(F.col("node").alias("head"), F.col("t").alias("ht"), F.col("v").alias("w"))
    both = pairs.join(texts, "node").join(head_texts, "head").where(_alike(F.col("v"), F.col("w"))).select("a", "b", "head", "t", "ht")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            head, t, ht = (c.to_pylist() for c in batch.columns[2:])
            new = {k: x for k, x in zip(head, ht, strict=True) if k not in known}
            if len(known) + len(new) > HEAD_SETS:
                known, new = {}, dict(zip(head, ht, strict=True))
            known.update(zip(new, sets_of(list(new.values()), n), strict=True))
            hit = [same(s, known[k], threshold) for s, k in zip(sets_of(t, n), head, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return both.mapInArrow(compare, "a long, b long").distinct()


def _blocks(rows: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """Pairs of components (``a``, ``b``) that span what two lines of one open key link."""
    blocks_of = lambda c: F.ceil(c / BLOCK).cast("int")
    small = F.col("m") <= BLOCK  # all lines in one block
    rows = rows.withColumn("outer", F.when(small, 1).otherwise(blocks_of(F.col("m") - F.col("m_main")))).withColumn("inner", F.when(small, 0).otherwise(blocks_of(F.col("m_main"))))
    outside = small | (F.col("label") != F.col("main"))
    spot = F.pmod(F.xxhash64("node"), F.when(outside, F.col("outer")).otherwise(F.col("inner"))).cast("int")
    units = F.least("outer", F.ceil(F.col("outer") * (F.col("outer") + F.col("inner")) / UNIT).cast("int"))
    rows = rows.select("key", "node", "label", "outer", F.when(outside, spot).otherwise(F.col("outer") + spot).alias("block"), units.alias("units"))
    blocks = rows.join(texts, "node").groupBy("key", "block", "outer", "units").agg(F.collect_list(F.struct("label", "t", "v")).alias("own"))
    blocks = materialise(blocks, "line-blocks")
    tasks = 1 + int(blocks.agg(F.sum(F.size("own") + F.size("own") * F.when(F.col("outer") > 1, F.col("outer") * BLOCK).otherwise(F.size("own")) / 16)).first()[0] or 0) // TASK_LINES
    left = blocks.where("block < outer").select("key", F.col("block").alias("x"), F.pmod("block", "units").alias("unit"), F.col("own").alias("xs"))
    right = blocks.select("key", F.col("block").alias("y"), F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"), F.col("own").alias("ys"))
    met = left.repartition(tasks, "key", "unit").join(right.repartition(tasks, "key", "unit"), ["key", "unit"]).where("x <= y")
    met = met.select((F.col("x") == F.col("y")).alias("one"), "xs", F.when(F.col("x") < F.col("y"), F.col("ys")).alias("ys"))

    def unpacked(cell: pa.ListScalar) -> tuple[np.ndarray, list[str], np.ndarray]:
        label, t, v = cell.values.flatten()
        return label.to_numpy(zero_copy_only=False), t.to_pylist(), v.flatten().to_numpy(zero_copy_only=False).reshape(-1, BINS)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: dict[int, int] = {}  # the task's own forest, so that it sends links that span, not all
        for batch in batches:
            found = set()
            for one, xs, ys in zip(*batch.columns, strict=True):
                label, t, v = unpacked(xs)
                label_y, t_y, v_y = (label, t, v) if one.as_py() else unpacked(ys)
                equal = np.zeros((len(v), len(v_y)), np.uint8)
                for k in range(BINS):
                    equal += v[:, k, None] == v_y[None, :, k]
                near = (equal >= MATCHES) & (label[:, None] != label_y[None, :])
                if one.as_py():
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                (mine, i_at), (theirs, j_at) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
                hit = alike_sets(sets_of([t[k] for k in mine], n), sets_of([t_y[k] for k in theirs], n), threshold)[i_at, j_at]
                for x, y in zip(label[i[hit]].tolist(), label_y[j[hit]].tolist(), strict=True):
                    a, b = _top(into, x), _top(into, y)
                    if a != b:
                        into[max(a, b)] = min(a, b)
                        found.add((x, y))
            links = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return met.mapInArrow(compare, "a long, b long").distinct()


def remove_lines(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the lines that ``found`` (of near_lines) does not keep taken out of the text; ids must be unique. A text left without lines is empty."""
    gone = found.where(~F.col("kept")).groupBy(id_col).agg(F.collect_list("line").alias("__gone"))  # at most the lines of one text
    kept = F.filter(F.split(text_or_empty(text_col), "\n"), lambda x, i: ~F.array_contains(F.coalesce("__gone", F.array().cast("array<int>")), i))
    return df.join(gone, id_col, "left").withColumn(text_col, F.array_join(kept, "\n")).select(*df.columns)
