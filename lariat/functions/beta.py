"""Beta distribution without SciPy: incomplete beta by a continued fraction, quantiles by bisection, all vectorized."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(X <= x) for X ~ Beta(a, b)."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    swap = inner > (a + 1) / (a + b + 2)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - inner, inner)
    front = np.exp(_LGAMMA(p + q) - _LGAMMA(p) - _LGAMMA(q) + p * np.log(t) + q * np.log1p(-t)) / p
    tiny = 1e-300
    c, d = np.ones_like(t), 1 - (p + q) * t / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for step in (m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    out = np.where(swap, 1 - front * h, front * h)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    low, high = np.zeros(a.shape), np.ones(a.shape)
    for _ in range(60):
        middle = (low + high) / 2
        under = cdf(middle, a, b) < p
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def greater(a1: np.ndarray, b1: np.ndarray, a2: np.ndarray, b2: np.ndarray, points: int = 1024, amount: float = 0.0) -> np.ndarray:
    """P(X - Y > amount) for independent beta variables: Y's distribution function over the steps of X's, in blocks of rows."""
    a1, b1, a2, b2 = (np.atleast_1d(np.asarray(v, float))[:, None] for v in (a1, b1, a2, b2))
    x = np.linspace(0, 1, 2 * points + 1)[None]
    out = np.empty(len(a1))
    for at in range(0, len(a1), 64):
        part = slice(at, at + 64)
        weight = np.diff(cdf(x, a1[part], b1[part]), axis=1)
        out[part] = (weight * cdf((x[:, 1:] + x[:, :-1]) / 2 - amount, a2[part], b2[part])).sum(1)
    return out


def interval(level: float = 0.9):
    """Column function (psi, n) -> struct(lo, hi): the central interval of Beta(psi n + 1, (1 - psi) n + 1)."""

    @F.arrow_udf("struct<lo:double,hi:double>")
    def ci(psi: pa.Array, n: pa.Array) -> pa.Array:
        p, k = psi.to_numpy(zero_copy_only=False).astype(float), n.to_numpy(zero_copy_only=False).astype(float)
        ok = np.isfinite(p) & np.isfinite(k)
        p, k = np.where(ok, p, 0.5), np.where(ok, k, 0)
        ends = [quantile(q, p * k + 1, (1 - p) * k + 1) for q in ((1 - level) / 2, (1 + level) / 2)]
        return pa.StructArray.from_arrays([pa.array(e, mask=~ok) for e in ends], ["lo", "hi"])

    return ci


def probability(amount: float = 0.0):
    """Column function (a1, b1, a2, b2) -> the larger of P(X - Y > amount) and P(Y - X > amount); null for a null parameter."""

    @F.arrow_udf("double")
    def larger(a1: pa.Array, b1: pa.Array, a2: pa.Array, b2: pa.Array) -> pa.Array:
        v = [c.to_numpy(zero_copy_only=False).astype(float) for c in (a1, b1, a2, b2)]
        ok = np.all([np.isfinite(c) & (c > 0) for c in v], 0)
        v = [np.where(ok, c, 1.0) for c in v]
        p = np.maximum(greater(*v, amount=amount), greater(v[2], v[3], v[0], v[1], amount=amount)) if amount else greater(*v)
        return pa.array(p if amount else np.maximum(p, 1 - p), mask=~ok)

    return larger
