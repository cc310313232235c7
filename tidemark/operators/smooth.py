"""Robust local regression (LOWESS) of a value on gc content, and correction by it.

Tricube weights vanish at the distance of the k-th nearest point. The fit at x depends on that distance and on sums over the points
around. Both come without looking at each point for each x: the k nearest points are a run of the points in order, which a binary search
finds for all x at once; and the tricube weight is a polynomial of the distance on either side, so that weighted sums are differences of running sums of powers.
These are taken around centres that are close to x (within half its bandwidth), where powers stay small and nothing cancels. So a
curve takes time in proportion to its points, however many distinct gc values they have. Residuals and robustness weights are of points.

One sample is one group of the grouped map: windows of one genome, of a bounded number.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_column, clip
from ..params import DEFAULT

#: Ranges of gc, from 0 to 1, in which queries meet their knots.
RANGES = 256


def neighbours(n: int, frac: float) -> int:
    return min(n, max(2, int(frac * n + 1e-10)))


def lowess(x: np.ndarray, y: np.ndarray, frac: float = DEFAULT.lowess_frac, passes: int = DEFAULT.lowess_passes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct x in order, and the fit at each."""
    xs, place, count = np.unique(x, return_inverse=True, return_counts=True)
    radius = _radii(xs, count, neighbours(len(x), frac))
    delta = np.ones(len(x))
    fit = np.zeros(len(xs))
    for k in range(passes + 1):
        w, wy = np.bincount(place, delta, len(xs)), np.bincount(place, delta * y, len(xs))
        fit = _local(xs, radius, w, wy, np.bincount(place, y, len(xs)) / count)
        if k == passes:
            break
        residual = np.abs(y - fit[place])
        middle = 6.0 * np.median(residual)
        u = residual / middle if middle > 0 else np.where(residual > 0, 1.0, 0.0)
        delta = np.where(u >= 0.999, 0.0, np.where(u <= 0.001, 1.0, (1 - u**2) ** 2))
    return xs, fit


def _radii(xs: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """Distance to the k-th nearest point from each distinct x: the least over runs of k points of the larger distance to their ends."""
    points = np.repeat(xs, count)
    low, high = np.zeros(len(xs), np.int64), np.full(len(xs), len(points) - k, np.int64)
    while (open_ := low < high).any():  # the first run whose end is farther than its start
        middle = (low + high) // 2
        far = points[middle + k - 1] - xs >= xs - points[middle]
        high = np.where(open_ & far, middle, high)
        low = np.where(open_ & ~far, middle + 1, low)
    reach = lambda at: np.maximum(np.abs(xs - points[at]), np.abs(points[at + k - 1] - xs))
    return np.minimum(reach(low), reach(np.maximum(low - 1, 0)))


#: Tricube: (1 - u^3)^3 in powers 0, 3, 6, 9 of u; 1 up to NEAR and 0 beyond FAR (as in the usual implementation).
_TRICUBE = ((0, 1.0), (3, -3.0), (6, 3.0), (9, -1.0))
NEAR, FAR = 0.001, 0.999
_POWERS = 12


def _moments(sums: np.ndarray, a: np.ndarray, b: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """For each t the sums of w (z - t)^r, r < n, over places a to b, from running sums of w z^p."""
    part = sums[:n, b] - sums[:n, a]
    back = (-t)[None] ** np.arange(n)[:, None]
    return np.stack([sum(comb(r, p) * back[r - p] * part[p] for p in range(r + 1)) for r in range(n)])


def _running(weights: np.ndarray, z: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, len(z) + 1))
    np.cumsum(weights * z[None] ** np.arange(n)[:, None], axis=1, out=out[:, 1:])
    return out


def _local(xs: np.ndarray, radius: np.ndarray, w: np.ndarray, wy: np.ndarray, plain: np.ndarray) -> np.ndarray:
    level = np.divide(wy, w, out=plain.copy(), where=w > 0)
    out = np.where(radius > 0, 0.0, level)  # with no bandwidth only ties count
    start, own = 0, np.flatnonzero(radius > 0)
    while start < len(own):
        first = own[start]
        end = start + int(np.searchsorted(xs[own[start:]], xs[first] + radius[first] / 2, side="right"))
        at = own[start:end]
        out[at] = _block(xs, at, radius[at], w, wy, plain[at])
        start = end
    return out


def _block(xs: np.ndarray, at: np.ndarray, h: np.ndarray, w: np.ndarray, wy: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Fits at places of xs that lie within half a bandwidth of the first."""
    x, scale, center = xs[at], float(h.max()), float(xs[at].mean())
    bounds = [np.searchsorted(xs, x + f * h, side="right" if f > 0 else "left") for f in (-FAR, -NEAR, NEAR, FAR)]
    low, high = int(bounds[0].min()), int(bounds[3].max())
    z, t, g = (xs[low:high] - center) / scale, (x - center) / scale, h / scale
    run_w, run_wy = _running(w[low:high], z, _POWERS), _running(wy[low:high], z, _POWERS - 1)
    left, near, right, end = (b - low for b in bounds)
    s = np.zeros((3, len(x)))  # of w (z - t)^q
    v = np.zeros((2, len(x)))  # of w y (z - t)^q
    for a, b, sign in ((left, near, -1.0), (right, end, 1.0)):
        m, my = _moments(run_w, a, b, t, _POWERS), _moments(run_wy, a, b, t, _POWERS - 1)
        for power, c in _TRICUBE:
            factor = c * (sign / g) ** power
            for q in range(3):
                s[q] += factor * m[power + q]
            for q in range(2):
                v[q] += factor * my[power + q]
    s += _moments(run_w, near, right, t, 3)
    v += _moments(run_wy, near, right, t, 2)
    some = s[0] > 0
    s0 = np.where(some, s[0], 1)
    mean = s[1] / s0
    s2 = s[2] / s0 - mean**2  # about the mean, in units of the scale
    slope = v[1] / s0 - mean * (v[0] / s0)
    fit = v[0] / s0 + np.where(s2 * scale**2 > 1e-12, -mean * slope / np.where(s2 > 0, s2, 1), 0.0)
    return np.where(some, fit, plain)


def lowess_fit(points: DataFrame, frac: float = DEFAULT.lowess_frac, passes: int = DEFAULT.lowess_passes) -> DataFrame:
    """sample, gc, fit, points: the curve of each sample. points: sample, gc, y, no nulls."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        xs, fit = lowess(group["gc"].to_numpy(), group["y"].to_numpy(), frac, passes)
        return pd.DataFrame({"sample": group["sample"].iloc[0], "gc": xs, "fit": fit, "points": len(group)})

    return points.select("sample", "gc", "y").groupBy("sample").applyInPandas(run, "sample string, gc double, fit double, points long")


def _dealt(curve: DataFrame, n_ranges: int) -> DataFrame:
    """The curve's knots by range of gc, with the last knot before the range and the first one behind it, for every range."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("gc")
        gc, n = group["gc"].to_numpy(), len(group)
        own = np.clip(np.floor(gc * n_ranges), 0, n_ranges - 1).astype(np.int64)
        ranges = np.arange(n_ranges)
        low, high = np.maximum(np.searchsorted(own, ranges) - 1, 0), np.minimum(np.searchsorted(own, ranges, side="right") + 1, n)
        sizes = high - low
        at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return group.take(at).append_column("range", pa.array(np.repeat(ranges, sizes).astype(np.int32)))

    return curve.select("sample", "gc", "fit").groupBy("sample").applyInArrow(run, "sample string, gc double, fit double, range int")


def interpolated(queries: DataFrame, curve: DataFrame, ranges: int = RANGES) -> DataFrame:
    """queries (sample, gc, any more) with fit: linear between knots of the sample's curve, constant beyond its ends, null for null gc.

    Queries and knots are co-grouped by sample and range of gc; knots at a range's bounds go to both sides, so that a range needs no other. ranges: how many there are between 0 and 1, one at least; what lies outside is in the first or last.
    """
    ranges = max(1, ranges)
    names = queries.columns
    schema = ", ".join([f"`{c}` {t}" for c, t in queries.dtypes] + ["fit double"])

    def run(own: pa.Table, knots: pa.Table) -> pa.Table:
        fit = np.full(len(own), np.nan)
        if len(own) and len(knots):
            knots = knots.sort_by("gc")
            fit = np.interp(own["gc"].to_numpy(), knots["gc"].to_numpy(), knots["fit"].to_numpy())
        return own.select(names).append_column("fit", pa.array(fit, mask=np.isnan(fit)))

    gc_range = F.least(F.greatest(F.floor(F.col("gc") * ranges), F.lit(0)), F.lit(ranges - 1)).cast("int")
    dealt = queries.withColumn("range", F.when(F.col("gc").isNotNull() & ~F.isnan("gc"), gc_range))
    out = dealt.groupBy("sample", "range").cogroup(_dealt(curve, ranges).groupBy("sample", "range")).applyInArrow(run, schema)
    return out.select("sample", "gc", *[c for c in names if c not in ("sample", "gc")], "fit")


def corrected(value: str | Column, fit: str | Column, floor: float = DEFAULT.fit_floor) -> Column:
    return as_column(value) / clip(fit, floor)
