"""Estimators on one series in numpy, for use inside grouped maps."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

PHI = NormalDist()


def ffd_weights(d: float, threshold: float = 1e-5, most: int = 10_000) -> np.ndarray:
    """Weights of fractional differencing, newest first, until one falls below the threshold."""
    w = [1.0]
    for k in range(1, most):
        nxt = -w[-1] * (d - k + 1) / k
        if abs(nxt) < threshold:
            break
        w.append(nxt)
    return np.array(w)


def frac_diff(x: np.ndarray, d: float, threshold: float = 1e-5, most: int = 10_000) -> np.ndarray:
    """Fixed-width fractional difference; the first width - 1 values are nan."""
    w = ffd_weights(d, threshold, most)
    out = np.full(len(x), np.nan)
    if len(x) >= len(w):
        out[len(w) - 1 :] = np.convolve(x, w, "valid")
    return out


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their t values and the residual sum of squares."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = float(((y - x @ beta) ** 2).sum())
    free = len(y) - x.shape[1]
    cov = np.linalg.pinv(x.T @ x) * (rss / free if free > 0 else np.nan)
    with np.errstate(all="ignore"):
        return beta, beta / np.sqrt(np.diag(cov)), rss


def mackinnon_p(tau: float) -> float:
    """Approximate p value of the constant-only Dickey-Fuller statistic (MacKinnon's response surface)."""
    if tau > 2.74:
        return 1.0
    if tau < -18.83:
        return 0.0
    if tau <= -1.61:
        return PHI.cdf(2.1659 + 1.4412 * tau + 0.038269 * tau**2)
    return PHI.cdf(1.7339 + 0.93202 * tau - 0.12745 * tau**2 - 0.010368 * tau**3)


def _adf_design(x: np.ndarray, lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    dx = np.diff(x)
    y = dx[skip:]
    cols = [x[skip : skip + len(y)]] + [dx[skip - k : skip - k + len(y)] for k in range(1, lags + 1)] + [np.ones(len(y))]
    return y, np.column_stack(cols)


def adf(x: np.ndarray, max_lag: int | None = None, choose: bool = True) -> tuple[float, float, int]:
    """Statistic, p value and lag of the augmented Dickey-Fuller test; the lag with the least AIC on a common sample if ``choose``. nan and 1 where it cannot run."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 10 or np.ptp(x) == 0:
        return math.nan, 1.0, 0
    top = min(math.ceil(12 * (n / 100) ** 0.25) if max_lag is None else max_lag, n // 2 - 2)
    lag = max(top, 0)
    if choose:
        best = math.inf
        for k in range(lag + 1):
            y, z = _adf_design(x, k, lag)
            rss = ols(y, z)[2]
            aic = len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * z.shape[1]
            if aic < best - 1e-12:
                best, pick = aic, k
        lag = pick
    tau = float(ols(*_adf_design(x, lag, lag))[1][0])
    return tau, mackinnon_p(tau) if math.isfinite(tau) else 1.0, lag


def minimise(f: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 400) -> np.ndarray:
    """Nelder-Mead."""
    n = len(start)
    simplex = [np.array(start, float)] + [np.array(start, float) + (np.arange(n) == i) * (0.1 * abs(start[i]) + 0.05) for i in range(n)]
    value = [f(p) for p in simplex]
    for _ in range(steps):
        order = np.argsort(value)
        simplex, value = [simplex[i] for i in order], [value[i] for i in order]
        if abs(value[-1] - value[0]) < 1e-9 * (1 + abs(value[0])):
            break
        centre = np.mean(simplex[:-1], axis=0)
        away = centre - simplex[-1]
        trial = centre + away
        ft = f(trial)
        if ft < value[0]:
            further = centre + 2 * away
            ff = f(further)
            simplex[-1], value[-1] = (further, ff) if ff < ft else (trial, ft)
        elif ft < value[-2]:
            simplex[-1], value[-1] = trial, ft
        else:
            inner = centre + (0.5 * away if ft < value[-1] else -0.5 * away)
            fi = f(inner)
            if fi < min(ft, value[-1]):
                simplex[-1], value[-1] = inner, fi
            else:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (p - simplex[0]) for p in simplex[1:]]
                value = [value[0]] + [f(p) for p in simplex[1:]]
    return simplex[int(np.argmin(value))]


def recurrence(inputs: list[np.ndarray], step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """States s[0] = first, s[i] = step s[i - 1] + inputs[:, i - 1], one row per component of the state.

    The series is cut into about root n blocks: states from 0 run through all blocks at once, then each block gets what the states before it add. So
    Python takes about 2 root n steps, and the result is that of a plain loop but for rounding.
    """
    d, m = len(first), len(inputs[0])
    width = max(1, math.isqrt(m))
    rows = -(-m // width)
    z = np.zeros((d, rows * width))
    z[:, :m] = inputs
    z = np.ascontiguousarray(z.reshape(d, rows, width).transpose(0, 2, 1))  # component, place in the block, block
    for k in range(1, width):
        z[:, k] += step @ z[:, k - 1]
    powers = [step]
    for _ in range(width - 1):
        powers.append(step @ powers[-1])
    carry, last = np.empty((d, rows)), np.asarray(first, float)
    for j in range(rows):
        carry[:, j] = last
        last = z[:, -1, j] + powers[-1] @ last
    for k in range(width):
        z[:, k] += powers[k] @ carry
    return np.concatenate([np.asarray(first, float)[:, None], z.transpose(0, 2, 1).reshape(d, rows * width)[:, :m]], 1)


def _variance_path(e2: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    return recurrence([omega + alpha * e2[:-1]], np.array([[beta]]), np.array([e2.mean()]))[0] if len(e2) > 1 else np.full(len(e2), e2.mean())


def garch(returns: np.ndarray, student: bool = True) -> dict:
    """GARCH(1,1) with constant mean by maximum likelihood, on returns in percent. ``vol`` is the conditional deviation, back in the units of the input."""
    r = np.asarray(returns, float) * 100
    mu, var = r.mean(), max(r.var(), 1e-12)
    e2 = (r - mu) ** 2

    def unpack(p: np.ndarray) -> tuple[float, float, float, float]:
        a, b = 1 / (1 + math.exp(-p[1])), 1 / (1 + math.exp(-p[2]))
        return math.exp(min(p[0], 30)), a * 0.999, b * (1 - a) * 0.999, 2.05 + math.exp(min(p[3], 5)) if student else math.inf

    def loss(p: np.ndarray) -> float:
        omega, alpha, beta, nu = unpack(p)
        h = np.maximum(_variance_path(e2, omega, alpha, beta), 1e-12)
        if math.isinf(nu):
            return float(0.5 * (np.log(2 * math.pi * h) + e2 / h).sum())
        c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
        return float(-(c - 0.5 * np.log(h) - (nu + 1) / 2 * np.log1p(e2 / (h * (nu - 2)))).sum())

    p = minimise(loss, np.array([math.log(var * 0.1), -2.5, 2.0] + ([1.5] if student else [])), 300)
    omega, alpha, beta, nu = unpack(p)
    ll, k = -loss(p), len(p) + 1
    keep = alpha + beta
    return {
        "mu": mu / 100, "omega": omega, "alpha": alpha, "beta": beta, "persistence": keep, "nu": nu, "loglik": ll, "aic": 2 * k - 2 * ll, "bic": k * math.log(len(r)) - 2 * ll,
        "long_run_vol": math.sqrt(omega / (1 - keep) * 252) / 100 if keep < 1 else math.nan, "vol": np.sqrt(_variance_path(e2, omega, alpha, beta)) / 100,
    }


def t_quantile(p: float, nu: float) -> float:
    """Quantile of Student's t by Hill's expansion around the normal."""
    if math.isinf(nu):
        return PHI.inv_cdf(p)
    z = PHI.inv_cdf(p)
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return z + sum(c / nu ** (i + 1) for i, c in enumerate(g))


def arma(x: np.ndarray, horizon: int, p: int = 2, q: int = 2) -> tuple[np.ndarray, np.ndarray, float]:
    """Forecast, its deviation per step and the in-sample error of an ARMA by Hannan and Rissanen's regressions."""
    m = x.mean()
    y = x - m
    k = min(max(10, p + q), len(y) // 4)
    long = np.column_stack([y[k - i : len(y) - i] for i in range(1, k + 1)])
    e = np.concatenate([np.zeros(k), y[k:] - long @ ols(y[k:], long)[0]])
    s = max(p, q) + k
    z = np.column_stack([y[s - i : len(y) - i] for i in range(1, p + 1)] + [e[s - i : len(e) - i] for i in range(1, q + 1)])
    b, _, rss = ols(y[s:], z)
    sigma = math.sqrt(rss / len(z))
    e[s:] = y[s:] - z @ b
    ys, es = list(y), list(e)
    psi = [1.0]
    for j in range(1, horizon):
        psi.append(sum(b[i] * psi[j - 1 - i] for i in range(min(p, j))) + (b[p + j - 1] if j <= q else 0.0))
    out = []
    for _ in range(horizon):
        f = sum(b[i] * ys[-1 - i] for i in range(p)) + sum(b[p + i] * es[-1 - i] for i in range(q))
        out.append(f)
        ys.append(f), es.append(0.0)
    return np.array(out) + m, sigma * np.sqrt(np.cumsum(np.square(psi))), sigma


def damped_holt(x: np.ndarray, horizon: int) -> np.ndarray:
    """Forecast of exponential smoothing with a damped additive trend, parameters by least squares of one-step errors."""

    def run(p: np.ndarray) -> tuple[float, float, float, float]:
        a, b, phi = (1 / (1 + math.exp(-v)) for v in p)
        phi = 0.8 + 0.2 * phi
        level, trend = recurrence([a * x[1:], a * b * x[1:]], np.array([[1 - a, (1 - a) * phi], [-a * b, phi * (1 - a * b)]]), np.array([x[0], x[1] - x[0]]))
        err = x[1:] - level[:-1] - phi * trend[:-1]
        return float(level[-1]), float(trend[-1]), phi, float(err @ err)

    level, trend, phi, _ = run(minimise(lambda p: run(p)[3], np.array([0.0, -2.0, 0.0]), 80))
    return level + trend * np.cumsum(phi ** np.arange(1, horizon + 1))


def _regressions(pre: list[np.ndarray], first: np.ndarray, last: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares on rows [first, last) for many starts, from running sums of z z', z y and y y over the first k columns of z: the first coefficient, the residuals' squares, and the first entry of the inverse."""
    a, b, c = (p[last] - p[first] for p in pre)
    a, b = a[:, :k, :k], b[:, :k]
    with np.errstate(all="ignore"):
        try:
            inv = np.linalg.inv(a)
        except np.linalg.LinAlgError:
            inv = np.linalg.pinv(a)
        beta = np.einsum("nij,nj->ni", inv, b)
        return beta[:, 0], np.maximum(c - np.einsum("ni,ni->n", beta, b), 0), inv[:, 0, 0]


def sadf(x: np.ndarray, least: int = 50, lags: int = 1) -> np.ndarray:
    """Supremum over starts of the ADF statistic on [start, end), excluding the bar itself; nan before 2 * least.

    Each window takes the number of lags, up to ``lags``, with the least Akaike criterion over the rows that all of them have, the
    fewest of equal ones, and is then fitted on all rows that this number has. Normal equations are differences of running sums of outer
    products, so an end costs a few passes instead of regressions per start.
    """
    n, out = len(x), np.full(len(x), np.nan)
    if n <= 2 * least:
        return out
    dx, level = np.diff(x), x - x.mean()
    sums = []
    for p in range(lags + 1):  # row r of p is the difference r + p
        y = dx[p:]
        z = np.column_stack([level[p : n - 1], np.ones(len(y))] + [dx[p - k : n - 1 - k] for k in range(1, p + 1)])
        start = lambda v: np.concatenate([np.zeros((1, *v.shape[1:])), np.cumsum(v, 0)])
        sums.append([start(z[:, :, None] * z[:, None, :]), start(z * y[:, None]), start(y * y)])
    for end in range(2 * least, n):
        starts = np.arange(0, end - least)
        stats, scores = [], []
        for p in range(lags + 1):
            k = p + 2
            rows = end - 1 - lags - starts
            _, ssr, _ = _regressions(sums[lags], starts, end - 1 - lags, k)
            coefficient, own, spread = _regressions(sums[p], starts, end - 1 - p, k)
            with np.errstate(all="ignore"):
                scores.append(np.round(rows * np.log(ssr / rows) + 2 * k, 9))
                stats.append(coefficient / np.sqrt(own / (end - 1 - p - starts - k) * spread))
        t = np.array(stats)[np.argmin(np.nan_to_num(scores, nan=np.inf), 0), np.arange(len(starts))]
        t = t[np.isfinite(t)]
        if len(t):
            out[end] = t.max()
    return out


def lempel_ziv(bits: np.ndarray) -> float:
    """One and the phrases of a bit string, over n / log2(n + 1): each phrase is the shortest one at its place that does not occur in what precedes it; a rest that does is none."""
    text, at, phrases = bits.astype(np.uint8).tobytes(), 0, 1
    while at < len(text):
        longest = next((k for k in range(1, len(text) - at + 1) if text[at : at + k] not in text[:at]), None)
        phrases += longest is not None
        at += longest or len(text)
    return phrases / (len(text) / math.log2(len(text) + 1)) if text else 0.0


def shannon(x: np.ndarray, bins: int = 10) -> float:
    """Entropy in bits of values over equal-width bins between least and greatest."""
    p = np.histogram(x, bins)[0] / len(x)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())
