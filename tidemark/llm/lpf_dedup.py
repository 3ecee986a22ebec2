"""Repeated passages by longest-previous-factor arrays over a distributed, depth-limited suffix order.

A byte goes when a string of ``depth`` bytes that covers it also starts in a document with a smaller id. All work is on
windows, the starts of such strings:

1. Every window has an anchor: the least hash among the 25-byte strings inside it, so equal windows have equal anchors.
   Documents are dealt into batches; each batch sends the distinct anchors it holds, 32 bits each, to buckets.
2. A bucket tells each batch which of its anchors other documents hold too. Most text has none and is done with.
3. For windows with shared anchors, a batch sends the bytes around the anchor (runs of windows with one anchor) with
   the smallest id that has them. Equal windows meet in one bucket, whatever surrounds them.
4. A bucket sorts its windows as suffixes cut at ``depth`` bytes, with the common prefixes of neighbours. The previous and
   the next smaller position of each, in order of document, give its longest previous factor, cut at ``depth``. Where that
   is a whole window, the window is a later copy; the answer is one bit a window.
5. Batches spread the bits over bytes.

Whole-text copies are settled by digest before. What many documents share is combined inside a batch before it is
sent, so a passage in a third of all rows is sent once a batch. Bits of the anchors may collide; that only adds
windows to step 3, which compares bytes. The text is shuffled once: the three passes over batches reuse the exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 25
#: Bytes of text in a batch, and batches' worth of anchors in a bucket.
BATCH_BYTES, BUCKET_BATCHES = 4 << 20, 4
RUN = 32

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(5)]  # M ** (2 ** k)


def anchors(flat: np.ndarray, depth: int) -> np.ndarray:
    """For each window start of a byte array the least mixed hash of the grams inside that window."""
    n = len(flat) - depth + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h1 = _BYTE[flat]
    h8, width = h1, 1
    for k in range(3):
        h8 = h8[:-width] * _M[k] + h8[width:]
        width *= 2
    h16 = h8[:-8] * _M[3] + h8[8:]
    g = len(flat) - GRAM + 1
    h = (h16[:g] * _M[3] + h8[16 : 16 + g]) * _M[0] + h1[24 : 24 + g]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    span, width = depth - GRAM + 1, 1
    while width * 2 <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[:n], h[span - width : span - width + n])


def runs_of(data: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of several texts as runs with one anchor: the joined bytes, and per run its text, start, number of windows and anchor."""
    flat = np.frombuffer(b"".join(data), np.uint8)
    sizes = np.array([len(x) for x in data], np.int64)
    begin = np.cumsum(sizes) - sizes
    parts = []
    step = 1 << 21
    for lo in range(0, max(len(flat) - depth + 1, 0), step):
        m = anchors(flat[lo : lo + step + depth - 1], depth)
        where = np.arange(lo, lo + len(m))
        doc = np.searchsorted(begin, where, "right") - 1
        ok = where + depth <= begin[doc] + sizes[doc]
        where, doc, m = where[ok], doc[ok], m[ok]
        if not len(where):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(where) != 1) | (m[1:] != m[:-1])]))
        count = np.diff(np.append(new, len(where)))
        pieces = -(-count // RUN)
        first = np.repeat(new, pieces)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        parts.append((doc[first], where[first] + nth * RUN, np.minimum(np.repeat(count, pieces) - nth * RUN, RUN), m[first]))
    if not parts:
        none = np.zeros(0, np.int64)
        return flat, none, none, none, np.zeros(0, np.uint64)
    return flat, *[np.concatenate(x) for x in zip(*parts, strict=True)]


def suffix_order(windows: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of windows as suffixes cut at ``depth`` bytes, ties by place, and the longest common prefix of each with the one before it (0 for the first).

    A window is a row of big-endian words; the last word ends where the window does and so may overlap the one before.
    """
    order = np.lexsort((place, *windows.T[::-1]))
    s, lcp = windows[order], np.zeros(len(windows), np.int64)
    differs = s[1:] ^ s[:-1]
    word = (differs != 0).argmax(1)
    bits = differs[np.arange(len(differs)), word]
    equal = sum((bits < np.uint64(1 << k)).astype(np.int64) for k in range(8, 64, 8))  # equal bytes that lead in the first word that differs
    lcp[1:] = np.where(bits == 0, depth, np.minimum(8 * word, depth - 8) + equal)
    return order, lcp


def to_smaller(doc: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place in suffix order the longest common prefix with the previous smaller position: the nearest place before it whose document is smaller (0 without one).

    Pointers start at the place before and jump over places that are not smaller, with the least common prefix on the way.
    """
    at, most = np.arange(len(doc)) - 1, lcp.copy()
    late = np.flatnonzero((at >= 0) & (doc[at] >= doc))
    while len(late):  # only those that still point to a place that is not smaller
        over = at[late]
        most[late], at[late] = np.minimum(most[late], most[over]), at[over]
        late = late[(at[late] >= 0) & (doc[at[late]] >= doc[late])]
    return np.where(at >= 0, most, 0)


def longest_previous(windows: np.ndarray, doc: np.ndarray, depth: int) -> np.ndarray:
    """The longest-previous-factor array: for each window the longest prefix, of ``depth`` bytes at most, that one of a smaller document also has.

    It is reached at the previous or at the next smaller position in suffix order, since common prefixes only shorten with the distance.
    """
    if not len(windows):
        return np.zeros(0, np.int64)
    order, lcp = suffix_order(windows, doc, depth)
    own = doc[order]
    before = to_smaller(own, lcp)
    after = to_smaller(own[::-1], np.append(lcp[1:], 0)[::-1])[::-1]
    found = np.empty(len(order), np.int64)
    found[order] = np.maximum(before, after)
    return found


def settle(slices: list[bytes], ids: list[int], depth: int) -> np.ndarray:
    """For slices (runs of windows) with the smallest id of their batch: a bit per window, set where a smaller document has that window."""
    index: dict[bytes, int] = {}
    uid = np.fromiter((index.setdefault(s, len(index)) for s in slices), np.int64, len(slices))
    mine = np.array(ids, np.int64)
    least = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(least, uid, mine)
    lengths = np.fromiter((len(s) for s in index), np.int64, len(index))
    flat = np.frombuffer(b"".join(index) + bytes(8), np.uint8)
    count = lengths - depth + 1
    owner = np.repeat(np.arange(len(index)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(lengths) - lengths, count) + nth
    whole = np.lib.stride_tricks.sliding_window_view(flat, 8)
    words = np.stack([whole[at + min(k, depth - 8)].view(">u8").ravel() for k in range(0, depth, 8)], 1).astype(np.uint64) if len(at) else np.zeros((0, 1), np.uint64)
    later = longest_previous(words, least[owner], depth) >= depth
    bits = np.bincount(owner, later * (1 << nth), len(index)).astype(np.uint64)
    every = ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)).astype(np.uint64)
    return np.where(mine > least[uid], every[uid], bits[uid]).astype(np.uint32)


class Batch:
    """The texts of one batch in order of id (copies of other texts left out), and its runs of windows."""

    def __init__(self, rows: pd.DataFrame, copies: set[int], depth: int, buckets: int) -> None:
        rows = rows.sort_values(["id", "text"], kind="stable", ignore_index=True)
        self.rows = rows
        self.data = [t.encode("utf-8", "surrogatepass") for t in rows["text"]]
        self.copy = np.array([r in copies for r in zip(rows["id"], rows["dg"], strict=True)], bool)
        self.ids = rows["id"].to_numpy(np.int64)
        used = [b"" if c else d for c, d in zip(self.copy, self.data, strict=True)]
        self.flat, self.doc, self.start, self.count, self.anchor = runs_of(used, depth)
        self.bucket = ((self.anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        self.value = (self.anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.depth = depth

    def shared(self, answers: pd.DataFrame) -> np.ndarray:
        """Runs whose anchor some bucket called shared."""
        known = [np.frombuffer(b, np.uint32).astype(np.uint64) | np.uint64(k) << np.uint64(32) for k, b in zip(answers["bucket"], answers["blob"], strict=True)]
        own = self.value.astype(np.uint64) | self.bucket.astype(np.uint64) << np.uint64(32)
        return np.flatnonzero(np.isin(own, np.concatenate(known))) if known else np.zeros(0, np.int64)

    def slices(self, runs: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct slices with their bucket and smallest id, and for each run the slice it has."""
        raw, index, first, extra = self.flat.tobytes(), {}, [], self.depth - 1
        of = np.empty(len(runs), np.int64)
        for k, (r, a, n) in enumerate(zip(runs.tolist(), self.start[runs].tolist(), self.count[runs].tolist(), strict=True)):
            s = raw[a : a + n + extra]
            i = index.get(s)
            if i is None:
                i = index[s] = len(first)
                first.append(r)
            of[k] = i
        first = np.array(first, np.int64)
        return list(index), self.bucket[first], self.ids[self.doc[first]], of


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, depth: int = 50, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row of df: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans`` (start and length of each removed run of bytes).

    Integer ids. A null text is an empty one; a null id counts as greater than all others (as the greatest possible one, so it takes no
    bytes from a row with that id, nor loses any). Rows with the same id never take bytes from each other, repeated rows included. Very long texts
    are worked on in pieces of a batch's windows. Other columns play no part, whatever their names; empty input gives no rows.
    """
    if depth < GRAM + 7:
        raise ValueError("depth must be 32 or more")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches = max(1, -(-int(total) // batch_bytes))
    buckets = max(1, -(-batches // BUCKET_BATCHES))
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col(id_col).isNull().alias("nil"), text.alias("text"))
    rows = rows.withColumn("dg", F.xxhash64("text")).withColumn("batch", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(batches)).cast("long"))
    exact = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("dg"))
    least = exact.groupBy("sha").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "least")
    copies = exact.join(least, "sha").where(F.col("id") > F.col("least")).select("id", "dg", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(batches)).cast("long").alias("batch"))
    copies = copies.select("batch", F.lit(0).alias("kind"), F.col("id").alias("bucket"), F.col("dg"), F.lit(None).cast("binary").alias("blob"))
    by_batch = rows.groupBy("batch")

    def start(r: pd.DataFrame, notes: pd.DataFrame) -> tuple[Batch, pd.DataFrame, pd.DataFrame]:
        c = notes[notes["kind"] == 0]
        return Batch(r, set(zip(c["bucket"], c["dg"], strict=True)), depth, buckets), notes[notes["kind"] == 1], notes[notes["kind"] == 2]

    def blobs(batch: int, bucket: np.ndarray, *columns: np.ndarray) -> list[tuple]:
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        return [(int(bucket[a]), batch, *[c[a:b].tobytes() for c in columns]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def send_anchors(key: tuple, r: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        if not len(r):
            return pd.DataFrame(columns=["bucket", "batch", "once", "twice"])
        b, _, _ = start(r, notes)
        full = b.value.astype(np.uint64) | b.bucket.astype(np.uint64) << np.uint64(32)
        order = np.lexsort((b.doc, full))
        f, d = full[order], b.ids[b.doc][order]
        head = np.concatenate([[True], f[1:] != f[:-1]]) if len(f) else np.zeros(0, bool)
        kinds = f[head]
        several = np.zeros(len(kinds), bool)
        if len(f):
            which = np.cumsum(head) - 1
            several[which[d != d[np.flatnonzero(head)[which]]]] = True
        bucket = (kinds >> np.uint64(32)).astype(np.int64)
        value = (kinds & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pd.DataFrame(blobs(int(key[0]), bucket, value, several.astype(np.uint8)), columns=["bucket", "batch", "once", "twice"])

    def find_shared(key: tuple, r: pd.DataFrame) -> pd.DataFrame:
        values = [np.frombuffer(x, np.uint32) for x in r["once"]]
        flat = np.concatenate(values)
        order = np.argsort(flat, kind="stable")
        f = flat[order]
        again = np.concatenate([[False], f[1:] == f[:-1]])
        many = np.concatenate([np.frombuffer(x, np.uint8) for x in r["twice"]]) > 0
        many[order[again]] = True
        many[order[:-1][again[1:]]] = True
        out, at = [], 0
        for batch, v in zip(r["batch"], values, strict=True):
            mine = v[many[at : at + len(v)]]
            at += len(v)
            if len(mine):
                out.append((int(batch), 1, int(key[0]), 0, mine.tobytes()))
        return pd.DataFrame(out, columns=["batch", "kind", "bucket", "dg", "blob"])

    def send_slices(key: tuple, r: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "batch", "data", "lengths", "ids"]
        if not len(r):
            return pd.DataFrame(columns=columns)
        b, known, _ = start(r, notes)
        slices, bucket, ids, _ = b.slices(b.shared(known))
        out = []
        for k in np.unique(bucket):
            own = np.flatnonzero(bucket == k)
            parts = [slices[i] for i in own]
            out.append((int(k), int(key[0]), b"".join(parts), np.array([len(x) for x in parts], np.uint8).tobytes(), ids[own].tobytes()))
        return pd.DataFrame(out, columns=columns)

    def answer(key: tuple, r: pd.DataFrame) -> pd.DataFrame:
        slices: list[bytes] = []
        ids: list[int] = []
        sizes = []
        for data, lengths, own in zip(r["data"], r["lengths"], r["ids"], strict=True):
            edges = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.uint8).astype(np.int64))]).tolist()
            data = bytes(data)
            slices += [data[a:z] for a, z in zip(edges[:-1], edges[1:], strict=True)]
            ids += np.frombuffer(own, np.int64).tolist()
            sizes.append(len(edges) - 1)
        bits = settle(slices, ids, depth)
        cut = np.cumsum(sizes) - sizes
        return pd.DataFrame([(int(b), 2, int(key[0]), 0, bits[a : a + n].tobytes()) for b, a, n in zip(r["batch"], cut, sizes, strict=True)], columns=["batch", "kind", "bucket", "dg", "blob"])

    def finish(key: tuple, r: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "nil", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        if not len(r):
            return pd.DataFrame(columns=columns)
        b, known, masks = start(r, notes)
        runs = b.shared(known)
        _, bucket, least, of = b.slices(runs)
        bits = np.zeros(len(bucket), np.uint32)
        for k, blob in zip(masks["bucket"], masks["blob"], strict=True):
            bits[np.flatnonzero(bucket == k)] = np.frombuffer(blob, np.uint32)
        change = np.zeros(len(b.flat) + 1, np.int64)
        if len(runs):
            count, begin = b.count[runs], b.start[runs]
            every = ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
            mask = np.where(b.ids[b.doc[runs]] > least[of], every, bits[of])
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            hit = (np.repeat(mask, count) >> nth.astype(np.uint32)) & 1 > 0
            at = (np.repeat(begin, count) + nth)[hit]
            np.add.at(change, at, 1)
            np.add.at(change, at + depth, -1)
        gone = np.cumsum(change[:-1]) > 0
        out, at = [], 0
        for i, (data, copy, nil) in enumerate(zip(b.data, b.copy, b.rows["nil"].tolist(), strict=True)):
            n = len(data)
            if copy:
                whole = n >= depth
                out.append((b.ids[i], nil, n, n if whole else 0, int(whole), hashlib.sha256(b"" if whole else data).hexdigest(), [{"start": 0, "length": n}] if whole else []))
                continue
            g = gone[at : at + n]
            at += n
            edges = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]])))
            kept = np.frombuffer(data, np.uint8)[~g].tobytes() if len(edges) else data
            spans = [{"start": int(a), "length": int(z - a)} for a, z in zip(edges[::2], edges[1::2], strict=True)]
            out.append((b.ids[i], nil, n, int(g.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
        return pd.DataFrame(out, columns=columns)

    first = by_batch.cogroup(copies.groupBy("batch")).applyInPandas(send_anchors, "bucket long, batch long, once binary, twice binary")
    notes = "batch long, kind int, bucket long, dg long, blob binary"
    shared = copies.unionByName(first.groupBy("bucket").applyInPandas(find_shared, notes))
    sent = by_batch.cogroup(shared.groupBy("batch")).applyInPandas(send_slices, "bucket long, batch long, data binary, lengths binary, ids binary")
    told = shared.unionByName(sent.groupBy("bucket").applyInPandas(answer, notes))
    done = by_batch.cogroup(told.groupBy("batch")).applyInPandas(finish, "id long, nil boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, length: long>>")
    return done.select(F.when(~F.col("nil"), F.col("id")).cast(df.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
