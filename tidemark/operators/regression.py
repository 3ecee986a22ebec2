"""Least squares over one long series: cross products by chunk, summed, then solved once per series.

A regression of a series on its own lags needs only the matrix of sums of products of its columns. Chunks of a series, each with the rows before it that
its lags reach, give their part of that matrix as separate tasks; the parts are summed entry by entry with map-side combining, and what comes to one
place is a matrix per series, whatever its length. Lag choice then is a choice of submatrices.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import econometrics as ec
from ..sources.market import materialise
from .running import in_order, places

ADF = "symbol string, adf_stat double, p_value double, lag int, is_stationary boolean"


def adf_rows(x: np.ndarray, lags: int) -> np.ndarray:
    """Rows (level before, 1, changes 1 to ``lags`` before, change) of the test regression, from the place where all are there."""
    d = np.diff(x)
    t = np.arange(lags, len(d))
    return np.column_stack([x[t], np.ones(len(t)), *[d[t - k] for k in range(1, lags + 1)], d[t]])


def solve(m: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and inverse from sums of products whose last row and column are the target's."""
    scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
    c = m / np.outer(scale, scale)
    inverse = np.linalg.pinv(c[:-1, :-1], hermitian=True)
    b = inverse @ c[:-1, -1]
    rss = max(float(c[-1, -1] - b @ c[:-1, -1]), 0.0) * scale[-1] ** 2
    return b * scale[-1] / scale[:-1], rss, inverse / np.outer(scale[:-1], scale[:-1])


def most_lags(n: int, max_lag: int | None) -> int:
    """The greatest lag that is tried for n values."""
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25) if max_lag is None else max_lag, n // 2 - 2))


def choose_lag(m: np.ndarray, n: int, top: int) -> int:
    """The lag with the least Akaike criterion, all on one sample of n rows."""
    best, pick = math.inf, 0
    for k in range(top + 1):
        at = [0, 1, *range(2, 2 + k), top + 2]
        aic = n * math.log(max(solve(m[np.ix_(at, at)])[1], 1e-300) / n) + 2 * (k + 2)
        if aic < best - 1e-12:
            best, pick = aic, k
    return pick


def adf_test(df: DataFrame, x: str = "close", max_lag: int | None = None, chunk: int = 50_000) -> DataFrame:
    """``symbol, adf_stat, p_value, lag, is_stationary`` (5 %) with a constant, the lag of the least AIC; fewer than 10 values, or equal ones, are not stationary: null, p 1, lag 0. Missing values are left out.

    A task holds ``chunk`` rows of a series, which must be more than there are lags, and as many before as there are lags.
    """
    value = F.col(x).cast("double")
    rows = places(df.where(value.isNotNull() & ~F.isnan(value)).select("symbol", "ts", value.alias("x")), "i")
    stats = rows.groupBy("symbol").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    root = F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))) if max_lag is None else F.lit(max_lag)
    stats = stats.withColumn("top", F.greatest(F.lit(0), F.least(root, F.floor(F.col("n") / 2) - 2)).cast("long"))
    usable = (F.col("n") >= 10) & (F.col("hi") > F.col("lo"))
    own = rows.join(stats.where(usable).select("symbol", "mean", "top"), "symbol")
    home, reach = F.floor(F.col("i") / chunk), F.col("top") + 1
    behind = F.when(F.col("i") % chunk >= chunk - reach, F.array(home, home + 1)).otherwise(F.array(home))
    spread = own.select("symbol", "i", (F.col("x") - F.col("mean")).alias("x"), "top", home.alias("home"), F.explode(behind).alias("part"))

    def products(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        values, top, part = table["x"].to_numpy(), int(table["top"][0].as_py()), int(table["part"][0].as_py())
        w = adf_rows(values, top)
        m = (w.T @ w).ravel() if len(w) else np.zeros((top + 3) ** 2)
        head = values[: top + 1] if part == 0 else np.zeros(0)  # rows that only fewer lags can use
        return pa.table({"symbol": table["symbol"].slice(0, 1), "m": pa.array([m]), "rows": pa.array([len(w)], pa.int64()), "head": pa.array([head], pa.list_(pa.float64()))})

    parts = spread.groupBy("symbol", "part").applyInArrow(products, "symbol string, m array<double>, rows long, head array<double>")
    entries = parts.select("symbol", "rows", F.when(F.size("head") > 0, F.col("head")).alias("head"), F.posexplode("m").alias("k", "v"))
    total = entries.groupBy("symbol", "k").agg(F.sum("v").alias("v"), F.sum("rows").alias("rows"), F.max("head").alias("head"))

    def finish(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("k")
        size = math.isqrt(len(g))
        tau, p, lag = choose_and_test(g["v"].to_numpy().reshape(size, size), int(g["rows"].iloc[0]), np.asarray(g["head"].iloc[0], float))
        return pd.DataFrame({"symbol": [key[0]], "adf_stat": [tau], "p_value": [p], "lag": [lag], "is_stationary": [p < 0.05]})

    tested = total.groupBy("symbol").applyInPandas(finish, ADF)
    none = stats.where(~usable).select("symbol", F.lit(None).cast("double").alias("adf_stat"), F.lit(1.0).alias("p_value"), F.lit(0).alias("lag"), F.lit(False).alias("is_stationary"))
    return tested.unionByName(none)


def choose_and_test(m: np.ndarray, rows: int, head: np.ndarray) -> tuple[float, float, int]:
    """Statistic, p value and lag from the sums of products with all lags over ``rows`` rows, and the first values, which only fewer lags can use."""
    top = len(m) - 3
    lag = choose_lag(m, rows, top)
    at = [0, 1, *range(2, 2 + lag), top + 2]
    extra = adf_rows(head, lag) if len(head) > lag + 1 else np.zeros((0, lag + 3))
    final, n = m[np.ix_(at, at)] + extra.T @ extra, rows + len(extra)
    b, rss, inverse = solve(final)
    spare = n - (lag + 2)
    tau = float(b[0] / math.sqrt(rss / spare * inverse[0, 0])) if spare > 0 and rss > 0 else math.nan
    return tau, ec.mackinnon_p(tau) if math.isfinite(tau) else 1.0, lag


def row_products(x: np.ndarray, lags: int) -> np.ndarray:
    """For every place of a piece of a series (centred levels), the products of the row (level before, 1, changes before, change) for 0 to ``lags`` lags, flat, one after the other; 0 where a row is not whole."""
    parts = []
    for p in range(lags + 1):
        w = adf_rows(x, p)
        flat = np.zeros((len(x), (p + 3) ** 2))
        flat[p + 1 :] = (w[:, :, None] * w[:, None, :]).reshape(len(w), -1)
        parts.append(flat)
    return np.concatenate(parts, 1)


def supremum(starts: np.ndarray, begin: np.ndarray, ends: np.ndarray, sums: np.ndarray, least: int, lags: int, pairs: int = 1 << 15) -> np.ndarray:
    """The greatest statistic of windows [start, end) over the given starts, for each end; nan where there is none. ``begin`` and ``sums`` are the running products at both. About ``pairs`` windows are solved at once."""
    out, edges = np.full(len(ends), np.nan), np.cumsum([0, *[(p + 3) ** 2 for p in range(lags + 1)]])
    many = np.searchsorted(starts, ends - least, "left")
    step = max(1, pairs // max(len(starts), 1))
    for low in range(0, len(ends), step):
        some = np.arange(low, min(low + step, len(ends)))
        j, a = np.repeat(some, many[some]), np.concatenate([np.arange(m) for m in many[some]])
        if not len(j):
            continue
        cut = [(sums[j, edges[p] : edges[p + 1]] - begin[a, edges[p] : edges[p + 1]]).reshape(-1, p + 3, p + 3) for p in range(lags + 1)]
        end, start, stats, scores = ends[j], starts[a], [], []
        for p in range(lags + 1):
            k = p + 2
            rss = _solved(cut[lags], np.array([*range(k), lags + 2]))[1]
            coefficient, mine, spread = _solved(cut[p], np.arange(p + 3))
            rows = end - 1 - lags - start
            with np.errstate(all="ignore"):
                scores.append(np.round(rows * np.log(rss / rows) + 2 * k, 9))
                stats.append(coefficient / np.sqrt(mine / (end - 1 - p - start - k) * spread))
        t = np.array(stats)[np.argmin(np.nan_to_num(scores, nan=np.inf), 0), np.arange(len(j))]
        t = np.where(np.isfinite(t), t, -np.inf)
        top = np.full(len(some), -np.inf)
        np.maximum.at(top, j - low, t)
        out[some] = np.where(np.isfinite(top), top, np.nan)
    return out


#: The least pivot, in units of a column's sum of squares, with which windows are solved by elimination.
PIVOT = 1e-7


def _solved(m: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First coefficient, residual sum of squares and first entry of the inverse for a stack of sums of products, of which the rows and columns ``at`` count; the last of these are the target's.

    A Cholesky decomposition that takes the first column last, for all matrices of the stack at once; where columns are nearly dependent, the pseudo-inverse.
    """
    order = [*at[1:-1], at[0]]
    k, y = len(order), at[-1]
    with np.errstate(all="ignore"):
        scale = [1 / np.sqrt(np.maximum(m[:, i, i], 1e-300)) for i in order]
        low: list[list[np.ndarray]] = []
        z: list[np.ndarray] = []
        good = np.ones(len(m), bool)
        for i in range(k):
            low.append([])
            for j in range(i + 1):
                v = m[:, order[i], order[j]] * scale[i] * scale[j]
                for q in range(j):
                    v = v - low[i][q] * low[j][q]
                if i == j:
                    good &= v > PIVOT
                    v = np.sqrt(v)
                low[i].append(v if i == j else v / low[j][j])
            v = m[:, order[i], y] * scale[i]
            for q in range(i):
                v = v - low[i][q] * z[q]
            z.append(v / low[i][i])
        first, spread = z[-1] / low[-1][-1] * scale[-1], (scale[-1] / low[-1][-1]) ** 2
        rss = np.maximum(m[:, y, y] - sum(v * v for v in z), 0)
    if not good.all():
        bad = np.flatnonzero(~good)
        first[bad], rss[bad], spread[bad] = _pseudo(m[bad][:, at[:, None], at[None, :]])
    return first, rss, spread


def _pseudo(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_solved``, for all rows and columns, by the pseudo-inverse."""
    z, c, yy = m[:, :-1, :-1], m[:, :-1, -1], m[:, -1, -1]
    scale = np.sqrt(np.maximum(np.einsum("nii->ni", z), 1e-300))
    inverse = np.linalg.pinv(z / (scale[:, :, None] * scale[:, None, :]), hermitian=True) / (scale[:, :, None] * scale[:, None, :])
    b = np.einsum("nij,nj->ni", inverse, c)
    return b[:, 0], np.maximum(yy - np.einsum("ni,ni->n", b, c), 0), inverse[:, 0, 0]


def whole_supremum(x: np.ndarray, least: int, lags: int) -> np.ndarray:
    """``sadf`` of a series that fits in a task."""
    n, out = len(x), np.full(len(x), np.nan)
    starts, ends = np.arange(max(min(n - least, n - lags), 0)), np.arange(2 * least, n)
    if len(starts) and len(ends):
        run = np.cumsum(row_products(x - x.mean(), lags), 0)
        edges = np.cumsum([0, *[(p + 3) ** 2 for p in range(lags + 1)]])
        begin = np.concatenate([run[starts + p, edges[p] : edges[p + 1]] for p in range(lags + 1)], 1)
        out[ends] = supremum(starts, begin, ends, run[ends - 1], least, lags)
    return out


def _short_sadf(df: DataFrame, least: int, lags: int) -> DataFrame:
    """df without ``__x``, ln prices, and with ``sadf``, for short series."""
    names = [c for c in df.columns if c != "__x"]

    def begin() -> Callable[[pa.RecordBatch | None], pa.RecordBatch | None]:
        held: list[pa.RecordBatch] = []

        def take(batch: pa.RecordBatch | None) -> pa.RecordBatch | None:
            if batch is not None:
                held.append(batch)
                return None
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            found = pa.array(whole_supremum(whole.column("__x").to_numpy(), least, lags), pa.float64(), from_pandas=True)
            return pa.RecordBatch.from_arrays([*[whole.column(c) for c in names], found], names=[*names, "sadf"])

        return take

    return in_order(df, begin, ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema if c.name != "__x") + ", sadf double")


def sadf(df: DataFrame, x: str = "close", least: int = 50, lags: int = 1, chunk: int = 50_000, block: int = 2_048) -> DataFrame:
    """df with ``sadf``: at each row from 2 ``least`` on, the supremum over starts of the ADF statistic of ln prices on [start, row), the row itself excluded; null before, and where the price is missing or not positive.

    Each window takes the number of lags, up to ``lags``, with the least Akaike criterion. Products of rows are summed along the series by chunks, so the sums of a window are the
    difference of two rows' sums; ends and starts meet by blocks, a task per pair of blocks, whatever the length of a series. Series of up to ``block`` rows are solved whole, one after the other in a task.
    """
    price = F.col(x).cast("double")
    good = F.coalesce((price > 0) & ~F.isnan(price) & F.col("symbol").isNotNull(), F.lit(False))
    missing = df.where(~good).withColumn("sadf", F.lit(None).cast("double"))
    known = df.where(good).withColumn("__x", F.ln(price))
    counts = known.groupBy("symbol").agg(F.count("__x").alias("__rows"))
    if (counts.agg(F.max("__rows")).first()[0] or 0) <= block:
        return _short_sadf(known, least, lags).unionByName(missing)
    counted = known.join(counts, "symbol")
    short, known = (counted.where(c).select(known.columns) for c in (F.col("__rows") <= block, F.col("__rows") > block))
    own = places(known, "__i")
    own = materialise(own, "placed")
    mean = own.groupBy("symbol").agg(F.avg("__x").alias("__mean"), F.count("__x").alias("__n"))
    level = own.select("symbol", "__i", "__x").join(mean, "symbol").select("symbol", F.col("__i").alias("i"), (F.col("__x") - F.col("__mean")).alias("x"), F.col("__n").alias("n"))
    home, back = F.floor(F.col("i") / chunk), lags + 1
    parts = F.when(F.col("i") % chunk >= chunk - back, F.array(home, home + 1)).otherwise(F.array(home))
    spread = level.withColumn("home", home).withColumn("part", F.explode(parts))

    def along(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        halo = int((table["home"].to_numpy() < table["part"].to_numpy()).sum())
        run = np.cumsum(row_products(table["x"].to_numpy(), lags)[halo:], 0)
        own = table.slice(halo)
        flat = pa.array([row.tolist() for row in run], pa.list_(pa.float64()))
        return pa.table({"symbol": pa.array(own["symbol"].to_pylist(), pa.string()), **{c: pa.array(own[c].to_numpy(), pa.int64()) for c in ("part", "i", "n")}, "run": flat})

    local = materialise(spread.groupBy("symbol", "part").applyInArrow(along, "symbol string, part long, i long, n long, run array<double>"), "products")
    last = local.groupBy("symbol", "part").agg(F.max_by("run", "i").alias("total"))
    earlier = Window.partitionBy("symbol", "k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("symbol", "part", F.posexplode("total").alias("k", "v")).withColumn("c", F.coalesce(F.sum("v").over(earlier), F.lit(0.0)))
    carried = carried.groupBy("symbol", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda e: e["c"]).alias("before"))
    sums = materialise(local.join(carried, ["symbol", "part"]).select("symbol", "i", "n", F.zip_with("run", "before", lambda a, b: a + b).alias("s")), "sums")

    edges = [0]
    for p in range(lags + 1):
        edges.append(edges[-1] + (p + 3) ** 2)
    # an end takes the sums up to the row before it; a start, for p lags, those up to p rows after it
    ends = sums.select("symbol", (F.col("i") + 1).alias("at"), "n", "s").where((F.col("at") >= 2 * least) & (F.col("at") < F.col("n")))
    starts = None
    for p in range(lags + 1):
        piece = sums.select("symbol", (F.col("i") - p).alias("at"), "n", F.slice("s", edges[p] + 1, edges[p + 1] - edges[p]).alias(f"s{p}"))
        starts = piece if starts is None else starts.join(piece.drop("n"), ["symbol", "at"])
    starts = starts.select("symbol", "at", "n", F.concat(*[f"s{p}" for p in range(lags + 1)]).alias("s"))
    up = lambda c: F.floor(c / block)

    def meet(key: tuple, a: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(z):
            return pd.DataFrame({"symbol": pd.Series(dtype=object), "i": pd.Series(dtype="int64"), "sadf": pd.Series(dtype=float)})
        a = a.sort_values("at")
        found = supremum(a["at"].to_numpy(), np.stack(a["s"]), z["at"].to_numpy(), np.stack(z["s"]), least, lags)
        return pd.DataFrame({"symbol": [key[0]] * len(z), "i": z["at"].to_numpy(), "sadf": found})

    starts, ends = (materialise(df.select("symbol", "at", "n", "s"), name) for df, name in ((starts, "starts"), (ends, "ends")))
    ends = ends.withColumn("e", up(F.col("at"))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(up(F.col("at") - least), F.lit(0)))))
    starts = starts.where(F.col("at") < F.col("n") - least).withColumn("b", up(F.col("at"))).withColumn("e", F.explode(F.sequence("b", up(F.col("n") - 1))))
    both = starts.select("symbol", "b", "e", "at", "s").groupBy("symbol", "b", "e").cogroup(ends.select("symbol", "b", "e", "at", "s").groupBy("symbol", "b", "e")).applyInPandas(meet, "symbol string, i long, sadf double")
    best = both.where(~F.isnan("sadf")).groupBy("symbol", "i").agg(F.max("sadf").alias("sadf"))
    found = own.join(best.select("symbol", F.col("i").alias("__i"), "sadf"), ["symbol", "__i"], "left").select(*df.columns, "sadf")
    return found.unionByName(_short_sadf(short, least, lags)).unionByName(missing)
