"""Exact (Clopper-Pearson) binomial limits.

The limits are quantiles of beta distributions. Their mass is integrated numerically around
the peak, so the work per row does not depend on the number of trials. One row per
calibration bucket comes here, after the aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

_PANELS, _NODES, _REACH, _STEPS = 16, 16, 40.0, 50


def _mass(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integral of the beta density over [low, high], relative to the density at its peak."""
    nodes, weights = np.polynomial.legendre.leggauss(_NODES)
    edges = np.linspace(0.0, 1.0, _PANELS + 1)
    half = (edges[1:] - edges[:-1])[:, None] / 2
    at = (edges[:-1, None] + half * (1 + nodes)).ravel()
    weight = (half * weights).ravel()
    width = (high - low)[:, None]
    t = low[:, None] + width * at
    peak = ((a - 1) / np.maximum(a + b - 2, 1))[:, None]
    # Logarithms are taken relative to the peak, which keeps them exact for many trials.
    rise = (a - 1)[:, None] * np.log1p((t - peak) / np.where(peak > 0, peak, np.inf))
    fall = (b - 1)[:, None] * np.log1p((peak - t) / np.where(peak < 1, 1 - peak, np.inf))
    return (np.exp(rise + fall) * weight * width).sum(axis=1)


def beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quantile `q` of Beta(a, b) for a, b >= 1, by bisection."""
    mean = a / (a + b)
    reach = _REACH * np.sqrt(mean * (1 - mean) / (a + b + 1))
    start, end = np.maximum(mean - reach, 0.0), np.minimum(mean + reach, 1.0)
    wanted = q * _mass(start, end, a, b)
    low, high = start.copy(), end.copy()
    for _ in range(_STEPS):
        middle = (low + high) / 2
        short = _mass(start, middle, a, b) < wanted
        low, high = np.where(short, middle, low), np.where(short, high, middle)
    return (low + high) / 2


def exact_limits(hits: np.ndarray, trials: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper limit of the success rate for `hits` out of `trials`.

    Not a number unless 0 <= hits <= trials.
    """
    x, n = hits.astype(float), trials.astype(float)
    tail = (1 - level) / 2
    possible = (x >= 0) & (x <= n)
    low, high = np.where(possible, 0.0, np.nan), np.where(possible, 1.0, np.nan)
    some, rest = possible & (x > 0), possible & (x < n)
    low[some] = beta_quantile(tail, x[some], (n - x + 1)[some])
    # The upper limit is the lower limit of the misses, seen from the other end.
    high[rest] = 1 - beta_quantile(tail, (n - x)[rest], (x + 1)[rest])
    return low, high


BAND = T.StructType(
    [T.StructField("conf_low", T.DoubleType()), T.StructField("conf_high", T.DoubleType())]
)


@F.pandas_udf(BAND)
def exact_band(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for hits, trials in batches:
        low, high = exact_limits(hits.to_numpy(), trials.to_numpy())
        yield pd.DataFrame({"conf_low": low, "conf_high": high}).astype(object).where(~np.isnan([low, high]).T, None)
