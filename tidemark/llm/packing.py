"""Best-fit packing of token pieces into sequences under several capacities at once.

Tokens are counted in Arrow batches; documents longer than a sequence are cut so that only their first piece is
short. Pieces are dealt by hash into groups of a bounded size, each a random mix of all lengths, and every group is
packed on its own, longest first. A bin has three residual capacities: tokens, documents and attention cost (the
sum of squared lengths). Among the bins that satisfy every constraint, an item goes where the weighted norm of what
is left would be least, or where the weighted dot product of its vector with the residual is greatest.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Rows for which one task packs at once; the waste of a group is a bin or two.
GROUP_ITEMS = 32_768


@functools.lru_cache(maxsize=2)
def byte_bpe(ranks_path: str, tokenizer_path: str):
    """The byte-level encoder of a rank file with the added tokens of the tokenizers file of the same vocabulary. Its ids are those of that file, which takes four times as long."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(tokenizer_path, encoding="utf-8") as file:
        added = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def vocabulary() -> tuple[str, str]:
    """Paths of the rank file and of the tokenizers file."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), str(public_tokenizers.path("byte_bpe_50k.json"))


def token_ids(text: str, enc) -> np.ndarray:
    """Ids of a text; the string of an added token is that token, as in the tokenizers file."""
    return np.array(enc.encode(text, allowed_special="all"), "<u4")


def cut(n: int, most: int) -> list[int]:
    """Lengths of a document's pieces: all ``most`` long but the first."""
    return [n] if n <= most else ([n % most] if n % most else []) + [most] * (n // most)


def token_pieces(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocab: tuple[str, str] | None = None, end_id: int = 2, max_tokens: int = 1024, keep_ids: bool = False,
) -> DataFrame:
    """Per piece of each row of df: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked, ``ids``. A null text is an empty one: the end token alone.

    Repeated rows give their pieces each; an empty table gives none. Other columns play no part, whatever their names.
    """
    paths = vocab or vocabulary()
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_bpe(*paths)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                s = text.as_py() or ""
                tokens = np.append(token_ids(s, enc), np.uint32(end_id)).astype("<u4")
                at = 0
                for k, n in enumerate(cut(len(tokens), max_tokens)):
                    own = tokens[at : at + n]
                    row.append(i), piece.append(k), start.append(at), length.append(n), crc.append(zlib.crc32(own.tobytes()))
                    if keep_ids:
                        ids.append(own.astype(np.int32))
                    at += n
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(pieces, schema)


def vector_best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item of one group. An item that breaks a constraint by itself gets a bin of its own."""
    tokens, docs, cost = capacity
    w = np.asarray(weights, float)
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    res = np.zeros((3, len(lengths)))  # residuals of the open bins, as shares of the capacities
    names, used, n_open, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0, 0
    least = np.array([lengths.min(initial=1) / tokens, 1 / docs, lengths.min(initial=1) ** 2 / cost]) - 1e-12
    for step, i in enumerate(order):
        n = int(lengths[i])
        v = np.array([n / tokens, 1 / docs, n * n / cost])
        if step % 512 == 511 and n_open:  # bins that nothing fits any more
            live = (res[:, :n_open] >= least[:, None]).all(0)
            k = int(live.sum())
            res[:, :k], names[:k], used[:k], n_open = res[:, :n_open][:, live], names[:n_open][live], used[:n_open][live], k
        at = -1
        if n_open:
            left = res[:, :n_open] - v[:, None]
            fits = (left >= -1e-12).all(0)
            if rule == "norm":
                score = np.where(fits, w @ (left * left), np.inf)
                at = int(score.argmin())
            else:
                score = np.where(fits, -((w * v) @ res[:, :n_open]), np.inf)
                at = int(score.argmin())
            if not fits[at]:
                at = -1
        if at < 0:
            bin_of[i], made = made, made + 1
            left_over = 1 - v
            if (left_over >= least).all():
                res[:, n_open], names[n_open], used[n_open] = left_over, bin_of[i], n
                n_open += 1
        else:
            bin_of[i], offset[i] = names[at], used[at]
            used[at] += n
            res[:, at] -= v
    return bin_of, offset


def pack(
    pieces: DataFrame, *, max_tokens: int = 1024, max_docs: int | None = None, max_cost: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001), rule: str = "norm", group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (a table with ``length`` and ``ids_crc32``).

    Without ``max_docs`` and ``max_cost`` those capacities are what ``max_tokens`` implies, so they never bind.
    No piece is dropped: one that no bin can hold gets a sequence of its own. Repeated rows are packed like others.
    """
    capacity = (float(max_tokens), float(max_docs or max_tokens), float(max_cost or max_tokens**2))
    pieces = materialise(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_items))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(*pieces.columns[:5]), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def one(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.drop(columns="__group").sort_values(list(pieces_key), kind="stable", ignore_index=True)
        found, offset = vector_best_fit(items["length"].to_numpy(), capacity, weights, rule)
        return items.assign(sequence_id=(int(key[0]) << 32) + found, offset=offset)

    pieces_key = [c for c in pieces.columns[:5]]
    return dealt.groupBy("__group").applyInPandas(one, schema)
