"""Signal kernels in NumPy over Arrow batches; each is a function of one array and is tested against closed forms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def find_peaks(x: np.ndarray, height: float = -np.inf, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Places of local maxima (middles of plateaus), filtered by height, then distance (higher first), then prominence."""
    peaks, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                peaks.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    p = np.array([k for k in peaks if x[k] >= height], int)
    keep = np.ones(len(p), bool)
    for k in sorted(range(len(p)), key=lambda k: (x[p[k]], k), reverse=True):
        if keep[k]:
            near = np.abs(p - p[k]) < distance
            near[k] = False
            keep &= ~near
    out = []
    for k in p[keep]:
        higher = np.flatnonzero(x > x[k])
        left = higher[higher < k].max() + 1 if (higher < k).any() else 0
        right = higher[higher > k].min() if (higher > k).any() else n
        if x[k] - max(x[left : k + 1].min(), x[k:right].min()) >= prominence:
            out.append(k)
    return np.array(out, int)


def lower_envelope(x: np.ndarray, width: int = 5) -> np.ndarray:
    """Straight lines through the least value of each run of ``width`` (its first place on ties)."""
    at = np.array([s + int(np.argmin(x[s : s + width])) for s in range(0, len(x) - width + 1)])
    at = np.unique(at)
    return np.interp(np.arange(len(x)), at, x[at]) if len(at) else np.zeros(len(x))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def peak_places(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else find_peaks(np.asarray(v, float), 0.05, 3, 0.05).tolist())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def lower_envelope_residual(s: pd.Series) -> pd.Series:
    def one(v):
        if v is None or len(v) < 5:
            return None
        x = np.asarray(v, float)
        r = np.clip(x - lower_envelope(x), 0, None)
        return (r / r.sum() if r.sum() else r).tolist()

    return s.map(one)


@F.pandas_udf(T.StringType())
def float_digest(s: pd.Series) -> pd.Series:
    """SHA-256 of the values as little-endian doubles."""
    import hashlib

    return s.map(lambda v: None if v is None else hashlib.sha256(np.asarray(v, "<f8").tobytes()).hexdigest())
