"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of bytes up to order 3. A byte seen after a context costs -log2 n / (N + T) bits (N
bytes seen there, T different ones); one not seen costs the escape, -log2 T / (N + T), plus its cost after the next
shorter context, down to a uniform choice among 256. A context that a language never saw costs no escape. The
statistics are frozen after training, so a text's code length is a sum of table entries: the trees of all languages are
laid out as one array (context, byte, language), and texts are scored in numpy by looking up all their bytes at once. Only the
most frequent contexts of order 3 have rows for all bytes there, as many as ``table_bytes`` holds; the others have rows for the bytes seen
after them, found by binary search, and their escapes. Both give the same costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
#: Bytes, and texts, that are looked up at once.
SLICE, TEXTS = 1 << 18, 512


@dataclass
class Trees:
    """Frozen code lengths. ``code`` maps bytes to symbols (0: never seen), ``state`` three symbols to a context, ``bits`` (context, symbol) to a cost per language.

    ``rare`` maps three symbols to a context without such rows (-1: none): ``grams`` are its strings of four symbols as sorted numbers, ``gram_bits`` their costs, ``escape`` its costs of a byte not seen.
    """

    languages: list[str]
    code: np.ndarray
    symbols: int
    state: np.ndarray
    bits: np.ndarray
    rare: np.ndarray | None = None
    grams: np.ndarray | None = None
    gram_bits: np.ndarray | None = None
    escape: np.ndarray | None = None

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        a, total = self.symbols, np.zeros((len(texts), len(self.languages)))
        if not texts:
            return total
        pad = bytes(ORDER)
        flat = self.code[np.frombuffer(pad + pad.join(texts), np.uint8)]
        lengths = np.array([len(x) for x in texts], np.int64)
        starts = ORDER + np.concatenate([[0], np.cumsum(lengths[:-1] + ORDER)])
        ends = starts + lengths
        for lo in range(ORDER, len(flat), SLICE):
            hi = min(len(flat), lo + SLICE)
            s = flat[lo - ORDER : hi].astype(np.int32)
            context = (s[:-3] * a + s[1:-2]) * a + s[2:-1]
            at = self.state[context]
            at *= a
            at += s[3:]
            cost = self.bits.take(at, axis=0)
            if self.rare is not None:
                own = self.rare[context]
                some = np.flatnonzero(own >= 0)
                key = context[some].astype(np.int64) * a + s[3:][some]
                place = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
                seen = self.grams[place] == key
                cost[some[seen]] = self.gram_bits[place[seen]]
                cost[some[~seen]] += self.escape[own[some[~seen]]]
            first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
            which = np.arange(first, last)
            which = which[lengths[which] > 0]
            if len(which):
                edges = np.stack([np.clip(starts[which], lo, hi), np.clip(ends[which], lo, hi)], 1) - lo
                sums = np.add.reduceat(np.concatenate([cost, np.zeros((1, cost.shape[1]), cost.dtype)]), edges.ravel(), axis=0, dtype=np.float64)[::2]
                total[which] += sums
        return total


def grow(counts: list[tuple[str, int, int]], table_bytes: int = 16 << 20) -> Trees | None:
    """Trees from (language, four bytes as one number, count). All contexts stay; those of order 3 have rows for all symbols by count as far as table_bytes allow."""
    if not counts:
        return None
    languages = sorted({x[0] for x in counts})
    lang = np.searchsorted(languages, [x[0] for x in counts])
    gram, n = np.array([x[1] for x in counts], np.uint32), np.array([x[2] for x in counts], np.float64)
    b = np.stack([gram >> 24, gram >> 16 & 255, gram >> 8 & 255, gram & 255], 1).astype(np.int64)
    seen = np.unique(np.concatenate([[0], b.ravel()]))
    code = np.zeros(256, np.uint8 if len(seen) < 255 else np.uint16)
    code[seen] = np.arange(len(seen)) + 1
    a, k, b = len(seen) + 1, len(languages), code[b].astype(np.int64)
    key3 = (b[:, 0] * a + b[:, 1]) * a + b[:, 2]
    ids3, inv = np.unique(key3, return_inverse=True)
    ctx2, inv2 = np.unique(b[:, 1] * a + b[:, 2], return_inverse=True)
    room = max(0, table_bytes // (a * k * 4) - 1 - a - len(ctx2))
    all3, order = ids3, np.argsort(-np.bincount(inv, n), kind="stable")
    ids3 = np.sort(all3[order[:room]])

    def level(ctx: np.ndarray, size: int, keep: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probability by (context, symbol, language); lower has that of the next shorter context."""
        c = np.zeros((size, a, k), np.float32)
        np.add.at(c, (ctx[keep], b[keep, 3], lang[keep]), n[keep])
        total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True).astype(np.float32)
        down = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1) * lower
        return np.where(c > 0, c / np.maximum(total + kinds, 1), down).astype(np.float32)

    every = np.ones(len(n), bool)
    p0 = level(np.zeros(len(n), np.int64), 1, every, np.full((1, 1, 1), 1 / 256, np.float32))
    p1 = level(b[:, 2], a, every, p0)
    p2 = level(inv2, len(ctx2), every, p1[ctx2 % a])
    where = np.searchsorted(ids3, key3)
    inside = where < len(ids3)
    inside[inside] = ids3[where[inside]] == key3[inside]
    p3 = level(np.where(inside, where, 0), len(ids3), inside, p2[np.searchsorted(ctx2, ids3 % (a * a))]) if len(ids3) else np.zeros((0, a, k), np.float32)
    bits = -np.log2(np.concatenate([p1, p2, p3]).reshape(-1, k)).astype(np.float32)
    by2 = np.tile(np.arange(a), a)  # an unseen pair falls back to its last byte
    by2[ctx2] = a + np.arange(len(ctx2))
    state = np.tile(by2, a).astype(np.int32)
    state[ids3] = a + len(ctx2) + np.arange(len(ids3))
    trees = Trees(languages, code, a, state, np.ascontiguousarray(bits))
    if inside.all():
        return trees
    out = ~inside  # strings after contexts without rows for all symbols
    held = np.sort(all3[order[room:]])
    own = np.searchsorted(held, key3[out])
    seen = np.zeros((2, len(held), k), np.float32)  # bytes and kinds of bytes by context and language
    np.add.at(seen[0], (own, lang[out]), n[out])
    np.add.at(seen[1], (own, lang[out]), 1)
    total, kinds = seen
    trees.escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0).astype(np.float32)
    grams, at = np.unique(key3[out] * a + b[out, 3], return_inverse=True)
    of = np.searchsorted(held, grams // a)
    lower = -np.log2(p2[np.searchsorted(ctx2, grams // a % (a * a)), grams % a])
    trees.grams, trees.gram_bits = grams, (lower + trees.escape[of]).astype(np.float32)
    trees.gram_bits[at, lang[out]] = -np.log2(n[out] / (total + kinds)[own, lang[out]])
    trees.rare = np.full(a**3, -1, np.int32)
    trees.rare[held] = np.arange(len(held))
    return trees


def fit(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", *, key_col: str = "doc_id", sample_bytes: int = 3 << 20, table_bytes: int = 16 << 20,
) -> Trees | None:
    """Learn one tree per language from a bounded sample.

    Of each language, texts whose hash of ``key_col`` falls below sample_bytes / (its bytes) are counted, so about sample_bytes of
    each; their different four-byte strings with counts come to the driver, at most sample_bytes of them a language, in natural text a tenth or less. Rows without text or
    language teach nothing; without any other rows (an empty table) there is no model (None). Repeated rows count each.
    """
    rows = labelled.select(F.col(lang_col).alias("l"), F.col(text_col).cast("string").alias("t"), F.xxhash64(F.col(key_col).cast("string"), F.lit(11)).alias("h")).where(F.col("l").isNotNull() & F.col("t").isNotNull())
    per = {r["l"]: int(r["n"] or 0) for r in rows.groupBy("l").agg(F.sum(F.octet_length("t")).alias("n")).collect()}
    keep = F.lit(False)
    for name, n in per.items():
        keep = keep | ((F.col("l") == name) & (F.pmod(F.col("h"), F.lit(1_000_003)) / 1_000_003 < min(1.0, sample_bytes / max(n, 1))))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = [x.as_py().encode("utf-8", "surrogatepass") for x in batch.column(1)]
            for name in sorted(set(names)):
                flat = np.frombuffer(bytes(ORDER) + bytes(ORDER).join(x for x, y in zip(texts, names, strict=True) if y == name), np.uint8).astype(np.uint32)
                g = flat[:-3] << 24 | flat[1:-2] << 16 | flat[2:-1] << 8 | flat[3:] if len(flat) > 3 else np.zeros(0, np.uint32)
                kinds, count = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(kinds), pa.string()), pa.array(kinds.astype(np.int64)), pa.array(count.astype(np.int64))], names=["l", "g", "n"])

    counted = rows.where(keep).select("l", "t").mapInArrow(grams, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    return grow(list(zip(got["l"], got["g"], got["n"], strict=True)), table_bytes)


def predict(df: DataFrame, trees: Trees | None, text_col: str = "text", *, pass_cols: list[Column]) -> DataFrame:
    """``pass_cols`` of each row with ``lang_pred`` and ``score``, the winner's share of the probability of the text.

    ``und`` with score 0 is for null texts, texts without a letter, and all texts when there is no model. Of languages with equal costs the first by name wins.
    """
    own = df.select(*pass_cols, F.col(text_col).cast("string").alias("__t"))
    names = own.columns[:-1]
    usable = F.coalesce(F.col("__t").rlike(r"\p{L}"), F.lit(False))
    own = own.withColumn("__t", F.when(usable, F.col("__t")))
    fields = own.drop("__t").schema
    shared = own.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column(len(names))
            some = np.array([x.is_valid for x in column], bool)
            if model is None:
                pred, sure = ["und"] * len(some), np.zeros(len(some))
            else:
                bits = np.zeros((len(some), len(model.languages)))
                for lo in range(0, len(some), TEXTS):
                    bits[lo : lo + TEXTS] = model.score([(x.as_py() or "").encode("utf-8", "surrogatepass") for x in column.slice(lo, TEXTS)])
                best = bits.argmin(1)
                sure = np.where(some, 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1), 0.0)
                pred = [model.languages[i] if ok else "und" for i, ok in zip(best, some, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(sure, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return own.mapInArrow(score, f"{schema}, lang_pred string, score double")


def held_out(col: str, parts: int, part: int) -> Column:
    """Whether the checksum of a column as text leaves the remainder ``part``; false for null."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % parts == part, F.lit(False))
