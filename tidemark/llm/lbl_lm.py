"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation, in numpy inside Spark tasks.

Corpus statistics cover all training rows: token counts are combined per task, shuffled and kept as a table. The most
frequent tokens are the model's words; all others share one class, inside which a token has its smoothed share of the
counts. The model predicts a word's vector linearly from the two words before: q = R[w1] C1 + R[w2] C2, logit =
q . Q[w] + b[w]. Training rows are dealt by hash into shards of about as many tokens each, whatever the partitions of the input; a shard
runs through its rows once, in order of hash, telling words from shared noise samples in minibatches of counted word triples. After each
of a few rounds, over disjoint parts of the rows, the shards' parameters are averaged by their tokens. Scores are normalised: a batch's new contexts go through one matrix product with all words,
and the logarithms of the sums are kept by context. Tokens outside the broadcast head of the counts are joined to the table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The end of a text among the tokens; no word is a line feed.
END = b"\n"
#: Training tokens of a shard; parameters that are summed together, of so many shards at a time.
SHARD_TOKENS, SLICE, SHARDS_AT_ONCE = 2_000_000, 8192, 64
#: Tokens, drawn from a batch at random, among which equal word triples are counted and trained on at once.
CHUNK = 100_000


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text, cut at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_tokens(rows: DataFrame, text_col: str = "text", flush: int = 300_000) -> DataFrame:
    """``token`` (binary) and ``c`` over all rows; every row ends with one END."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])

        for batch in batches:
            for x in batch.column(0):
                seen.update(words(x.as_py()))
                seen[END] += 1
                if len(seen) > flush:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return rows.select(F.col(text_col).cast("string")).mapInArrow(tally, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """At most ``most`` tokens by falling count, and END: those above a count that a histogram of counts gives, so that no task sends its own top list."""
    level = F.floor(F.log2("c") * 256)
    least, so_far = None, 0
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some thousands of levels at most
        so_far += row["count"]
        if so_far > most:
            break
        least = row["level"]
    wanted = F.col("token") == F.lit(END)
    return counts.where(wanted if least is None else wanted | (level >= least)).toPandas().sort_values(["c", "token"], ascending=[False, True], ignore_index=True)


@dataclass
class Model:
    """Head of the counts (``tokens`` by falling count; the first ``n_words`` are the model's words) and the parameters. Class n_words is for all other tokens."""

    tokens: list[bytes]
    counts: np.ndarray
    n_words: int
    total: int
    kinds: int
    r: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    q: np.ndarray
    b: np.ndarray

    @classmethod
    def start(cls, tokens: list[bytes], counts: np.ndarray, n_words: int, total: int, kinds: int, dim: int, seed: int) -> Model:
        rng, k = np.random.default_rng(seed), n_words + 1
        part = np.append(counts[:n_words], total - counts[:n_words].sum()) + 0.5
        eye = np.eye(dim, dtype=np.float32)
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        return cls(tokens, counts, n_words, total, kinds, small(k, dim), eye.copy(), (0.5 * eye).astype(np.float32), small(k, dim), np.log(part / part.sum()).astype(np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.r, self.c1, self.c2, self.q, self.b]

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.params():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def index(self) -> dict[bytes, int]:
        if not hasattr(self, "_index"):
            self._index = {t: i for i, t in enumerate(self.tokens)}
        return self._index

    def end(self) -> int:
        return min(self.index().get(END, self.n_words), self.n_words)

    def nce_step(self, w: np.ndarray, w1: np.ndarray, w2: np.ndarray, times: np.ndarray, noise: np.ndarray, log_noise: np.ndarray, state: list[np.ndarray], rate: float) -> None:
        """One minibatch of distinct word triples with their numbers: raise data against noise, as if each word had len(noise) noise samples."""
        shift = np.float32(np.log(len(noise)))
        r1, r2 = self.r[w1], self.r[w2]
        pred = r1 @ self.c1 + r2 @ self.c2
        qw, qn = self.q[w], self.q[noise]
        up = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", pred, qw) + (self.b - log_noise)[w] - shift, -30, 30)))
        up *= times
        down = -times[:, None] / (1 + np.exp(-np.clip(pred @ qn.T + ((self.b - log_noise)[noise] - shift), -30, 30)))
        g_pred = up[:, None] * qw + down @ qn
        scale = np.float32(times.sum() ** -0.5)
        rows, grad = sum_rows(np.concatenate([w, noise]), np.concatenate([np.column_stack([up[:, None] * pred, up]), np.column_stack([down.T @ pred, down.sum(0)])]))
        ctx, g_ctx = sum_rows(np.concatenate([w1, w2]), np.concatenate([g_pred @ self.c1.T, g_pred @ self.c2.T]))
        every = slice(None)
        for p, s, at, g in ((self.c1, state[1], every, r1.T @ g_pred), (self.c2, state[2], every, r2.T @ g_pred), (self.q, state[3], rows, grad[:, :-1]), (self.b, state[4], rows, grad[:, -1]), (self.r, state[0], ctx, g_ctx)):
            g = g * scale
            s[at] += g * g
            p[at] += rate * g / np.sqrt(s[at] + 1e-6)

    def log_z(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """Logarithm of the sum over all words after each context; kept for contexts met before."""
        k = self.n_words + 1
        if not hasattr(self, "_z"):
            self._z = np.full(k * k, np.nan, np.float32)
            self._p1, self._p2 = self.r @ self.c1, self.r @ self.c2
        code = w2.astype(np.int64) * k + w1
        new = np.unique(code[np.isnan(self._z[code])])
        for lo in range(0, len(new), 512):
            part = new[lo : lo + 512]
            logits = (self._p1[part % k] + self._p2[part // k]) @ self.q.T
            logits += self.b
            top = logits.max(1)
            logits -= top[:, None]
            np.exp(logits, out=logits)
            self._z[part] = np.log(logits.sum(1)) + top
        return self._z[code]

    def log_prob(self, w: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each class given the two before."""
        z = self.log_z(w1, w2)
        return np.einsum("ij,ij->i", self._p1[w1] + self._p2[w2], self.q[w]) + self.b[w] - z


def sum_rows(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and the sum of the rows of each."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    return at[order[first]], np.add.reduceat(rows[order], first, axis=0)


def stream(ids: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of several texts in a row, each after two ENDs and with one at its end, and which places are tokens (not padding)."""
    flat, real = [], []
    for x in ids:
        flat += [np.array([end, end]), x, np.array([end])]
        real += [np.zeros(2, bool), np.ones(len(x) + 1, bool)]
    return np.concatenate(flat), np.concatenate(real)


def hash_of_row(rows: DataFrame) -> Column:
    """A hash of all of a row's columns that can be hashed, so that copies of a text are dealt apart where anything else tells them apart."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind])


def train_round(rows: DataFrame, model: Model, text_col: str, *, shards: int, noise: int, batch: int, rate: float, seed: int) -> np.ndarray | None:
    """Parameters after each shard has gone through its rows once, averaged by tokens; None without rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    end = model.end()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        own = copy.copy(shared.value)
        own.r, own.c1, own.c2, own.q, own.b = (p.copy() for p in shared.value.params())
        index, most = shared.value.index(), own.n_words
        k = most + 1
        rng = np.random.default_rng(seed)
        part = np.append(own.counts[:most], own.total - own.counts[:most].sum()) + 0.5
        part = part / part.sum()
        cumulative, log_noise = np.cumsum(part), np.log(part).astype(np.float32)
        state = [np.zeros_like(p) for p in own.params()]
        seen = 0
        for b in batches:
            ids = [np.minimum(np.fromiter((index.get(t, most) for t in words(x.as_py())), np.int64), most) for x in b.column(0)]
            if not ids:
                continue
            flat, real = stream(ids, end)
            at = np.flatnonzero(real)
            seen += len(at)
            rng.shuffle(at)
            for lo in range(0, len(at), CHUNK):
                i = at[lo : lo + CHUNK]
                triples, times = np.unique((flat[i - 2] * k + flat[i - 1]) * k + flat[i], return_counts=True)
                order = rng.permutation(len(triples))
                triples, times = triples[order], times[order].astype(np.float32)
                for a in range(0, len(triples), batch):
                    x = triples[a : a + batch]
                    picked = np.minimum(np.searchsorted(cumulative, rng.random(noise)), most)
                    own.nce_step(x % k, x // k % k, x // k // k, times[a : a + batch], picked, log_noise, state, rate)
        if seen:
            flat = np.concatenate([p.ravel() for p in own.params()]).astype(np.float64) * seen
            slices = [flat[a : a + SLICE] for a in range(0, len(flat), SLICE)]
            group = int(rng.integers(0, 1 << 31))
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(slices), pa.int64()), pa.array(range(len(slices)), pa.int64()), pa.array([seen] * len(slices), pa.int64()), pa.array(slices, pa.list_(pa.float64()))], names=names)

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(g["shard"].min())], "slice": [g["slice"].iloc[0]], "n": [g["n"].sum()], "v": [np.sum(np.stack(g["v"]), 0)]})

    names, schema = ["shard", "slice", "n", "v"], "shard long, slice long, n long, v array<double>"
    row_hash = hash_of_row(rows)
    dealt = rows.select(F.col(text_col).cast("string").alias("t"), row_hash.alias("h")).repartition(shards, "h").sortWithinPartitions("h", "t")
    sums, left = dealt.select("t").mapInArrow(learn, schema), shards
    while left > 1:  # sums of slices, a bounded number of shards at a time
        left = -(-left // SHARDS_AT_ONCE)
        sums = sums.groupBy("slice", F.pmod(F.xxhash64("shard"), F.lit(left)).alias("part")).applyInPandas(lambda g: add(g), schema)
    got = sums.toPandas().sort_values("slice")  # one row a slice
    return np.concatenate([np.asarray(v) / n for v, n in zip(got["v"], got["n"], strict=True)]).astype(np.float32) if len(got) else None


def fit(
    train: DataFrame, counts: DataFrame, text_col: str = "text", *, n_words: int = 2047, head: int = 150_000, dim: int = 32, noise: int = 64, batch: int = 320, rounds: int = 2, rate: float = 0.05, seed: int = 5,
) -> Model:
    """Train on all rows of ``train``, whose token counts are ``counts``. ``head`` tokens at most come to the driver. The same rows give the same model, however they are partitioned."""
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = most_frequent(counts, head)
    tokens = [bytes(t) for t in top["token"]]
    c = top["c"].to_numpy(np.float64)
    model = Model.start(tokens, c, min(n_words, len(tokens)), int(total["n"] or 0), int(total["v"] or 0), dim, seed)
    if tokens:
        for k in range(rounds):
            part = train.where(F.pmod(F.shiftright(hash_of_row(train), 40), F.lit(rounds)) == k)
            flat = train_round(part, model, text_col, shards=max(1, -(-model.total // SHARD_TOKENS)), noise=noise, batch=batch, rate=rate, seed=seed + k)
            if flat is not None:
                model.load(flat)
    return model


def score(df: DataFrame, model: Model, counts: DataFrame, text_col: str = "text", *, pass_cols: list[Column]) -> DataFrame:
    """``pass_cols`` of each row with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10).

    A null text is an empty one, its END alone. Repeated rows are scored each on its own. Without training tokens every token has
    probability 1 by the base formula, and both scores are 0.
    """
    own = df.select(*pass_cols, F.col(text_col).cast("string").alias("__t"))
    names = own.columns[:-1]
    shared = df.sparkSession.sparkContext.broadcast(model)
    end, most, n = model.end(), model.n_words, float(model.total)
    base_den = np.log10(n + 0.1 * (model.kinds + 1))
    rare_n = n - float(model.counts[:most].sum())
    rare_den = np.log10(rare_n + 0.1 * (model.kinds - most + 1))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index = m.index()
        log_c = np.log10(m.counts + 0.1)
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            texts = batch.column(len(names))
            for lo in range(0, len(texts), 256):
                docs = [words(x.as_py()) for x in texts.slice(lo, 256)]
                found = [np.fromiter((index.get(t, -1) for t in d), np.int64, len(d)) for d in docs]
                if m.total:
                    flat, real = stream([np.where((f < 0) | (f > most), most, f) for f in found], end)
                    at = np.flatnonzero(real)
                    lp = m.log_prob(flat[at], flat[at - 1], flat[at - 2]).astype(np.float64) / np.log(10)
                    edges = np.concatenate([[0], np.cumsum([len(f) + 1 for f in found])[:-1]])
                    sums = np.add.reduceat(lp, edges)
                else:
                    sums = np.zeros(len(docs))
                known_end = m.total > 0
                for d, f, s in zip(docs, found, sums, strict=True):
                    near = f[f >= 0]
                    beyond = near[near >= most]
                    tail = Counter(t for t, i in zip(d, f, strict=True) if i < 0) if len(near) < len(f) else {}
                    end_c = log_c[index[END]] if known_end else -1.0
                    cols[0].append(len(d) + 1)
                    cols[1].append(len(near) + known_end)
                    cols[2].append(float(log_c[near].sum()) + end_c)
                    cols[3].append(float(s) + float(log_c[beyond].sum()) - len(beyond) * rare_den)
                    cols[4].append([{"token": t, "tf": k} for t, k in tail.items()])
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("token", pa.binary()), ("tf", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*names, "n_tokens", "known", "head_log", "lp", "tail"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop("__t").schema)
    first = own.mapInArrow(local, f"{schema}, n_tokens long, known long, head_log double, lp double, tail array<struct<token: binary, tf: long>>")
    first = materialise(first.withColumn("__rid", F.monotonically_increasing_id()), "scored")
    tail = first.select("__rid", F.explode("tail").alias("x")).select("__rid", "x.token", "x.tf")
    tail = tail.join(counts, "token", "left").groupBy("__rid").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.1)).alias("tail_log"), F.sum("tf").alias("tail_n"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("tail_known"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return first.drop("tail").join(tail, "__rid", "left").select(
        *names, "n_tokens", (F.col("known") + zero("tail_known")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + zero("tail_log") - F.col("n_tokens") * F.lit(float(base_den))).alias("base_score"),
        (F.col("lp") + zero("tail_log") - zero("tail_n") * F.lit(float(rare_den))).alias("score"),
    )


def lm_scores(df: DataFrame, train_when: Column, text_col: str = "text", *, pass_cols: list[Column], **options: float) -> DataFrame:
    """Count, train and score: rows where ``train_when`` holds are the training rows, all rows are scored."""
    train = df.where(train_when)
    counts = materialise(count_tokens(train, text_col), "token-counts")
    return score(df, fit(train, counts, text_col, **options), counts, text_col, pass_cols=pass_cols)
