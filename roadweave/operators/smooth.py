"""Trajectory rectification: penalised least squares per trajectory, robust variant, search of its weight, audit.

Trajectories of about one length are solved together: their normal equations are
banded, padded to the longest, and each step of factoring and solving is one numpy operation over
all of them.  A factor is made once and serves all rounds of the robust variants.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 19  # samples that are solved together


class BandedSystem:
    """Normal equations of (1/M) |z - Hx|^2 + lam2/(N-2) |D2 x|^2 + lam3/(N-3) |D3 x|^2 for many series at once, factored.

    ``z``: longest length x series, NaN where a sample is missing or past the ``length`` of its series (over 3, with a sample each).
    """

    def __init__(self, z: np.ndarray, length: np.ndarray, lam2: float, lam3: float, dt: float):
        n, count = z.shape
        self.z, self.seen, self.inside = z, ~np.isnan(z), np.arange(n)[:, None] < length
        self.m = self.seen.sum(axis=0)
        bands = np.zeros((4, n + 3, count))  # [k, i]: entry (i, i + k)
        bands[0, :n] = np.where(self.inside, self.seen / self.m + 1e-12, 1.0)
        bands[0, n:] = 1.0
        for lam, order in ((lam2, 2), (lam3, 3)):
            if lam:
                stencil = np.diff(np.eye(order + 1), n=order, axis=0)[0] / dt**order
                weight = (np.arange(n)[:, None] < length - order) * (lam / (length - order))
                for k in range(order + 1):
                    for p in range(order + 1 - k):
                        bands[k, p : p + n] += weight * (stencil[p] * stencil[p + k])
        for i in range(n):  # unit lower triangle times diagonal times its transpose
            row = bands[1:, i] / bands[0, i]
            for k in (1, 2, 3):
                bands[: 4 - k, i + k] -= row[k - 1] * bands[k:, i]
            bands[1:, i] = row
        self.diagonal, self.lower = bands[0, :n], bands[1:, :n]

    def solve(self, z: np.ndarray) -> np.ndarray:
        n = len(z)
        y = np.zeros((n + 3, z.shape[1]))
        y[:n] = np.where(self.seen, z, 0.0) / self.m
        for i in range(n):
            y[i + 1 : i + 4] -= self.lower[:, i] * y[i]
        y[:n] /= self.diagonal
        y[n:] = 0.0
        for i in range(n - 1, -1, -1):
            y[i] -= (self.lower[:, i] * y[i + 1 : i + 4]).sum(axis=0)
        return y[:n]

    def robust(self, lam1: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
        """(x, e) with sparse outliers e of weight lam1/M |e|_1: smoothing and soft thresholds in turn, each series until its outliers stand."""
        e, x = np.zeros_like(self.z), self.solve(self.z)
        moving = np.ones(self.z.shape[1], dtype=bool)
        for _ in range(rounds):
            r = np.where(self.seen, self.z - x, 0.0)
            new = np.sign(r) * np.maximum(np.abs(r) - lam1 / 2, 0)
            moving &= np.abs(new - e).max(axis=0) >= 1e-9
            if not moving.any():
                break
            e = np.where(moving, new, e)
            x = np.where(moving, self.solve(self.z - e), x)
        return x, e

    def search(self, step: float = 1e-3, rounds: int = 11) -> tuple[np.ndarray, np.ndarray]:
        """(lam1, x): lam1 is raised until a series' mean absolute error stops falling; at most ``rounds`` times."""
        count = self.z.shape[1]
        best, kept, found = np.full(count, np.inf), np.zeros(count), np.zeros_like(self.z)
        going = np.ones(count, dtype=bool)
        for turn in range(1, rounds + 1):
            lam = np.full(count, turn * step)
            x, e = self.robust(lam)
            error = np.where(self.seen, np.abs(self.z - x - e), 0.0).sum(axis=0) / self.m
            going &= error < best
            if not going.any():
                break
            best, kept, found = np.where(going, error, best), np.where(going, lam, kept), np.where(going, x, found)
        return kept, found


def _stacked(series: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(z) for z in series])
    out = np.full((int(length.max()), len(series)), np.nan)
    for i, z in enumerate(series):
        out[: len(z), i] = z
    return out, length


def smooth_series(series: Sequence[np.ndarray], lam2: float, lam3: float, dt: float, lam1: float | None = None, search: bool = False) -> list[np.ndarray | None]:
    """Each series smoothed (NaN is missing); None for those of 3 samples or fewer, or without any."""
    out: list[np.ndarray | None] = [None] * len(series)
    able = sorted((i for i, z in enumerate(series) if len(z) > 3 and not np.isnan(z).all()), key=lambda i: len(series[i]))
    at = 0
    while at < len(able):
        end = at + 1
        while end < len(able) and len(series[able[end]]) * (end + 1 - at) <= CELLS and len(series[able[end]]) <= 1.25 * len(series[able[at]]) + 8:
            end += 1
        part = able[at:end]
        z, length = _stacked([series[i] for i in part])
        if search:
            shift = np.nanmin(z, axis=0)
            x = BandedSystem(z - shift, length, lam2, lam3, dt).search()[1] + shift
        elif lam1 is not None:
            x = BandedSystem(z, length, lam2, lam3, dt).robust(np.full(len(part), lam1))[0]
        else:
            x = BandedSystem(z, length, lam2, lam3, dt).solve(z)
        for k, i in enumerate(part):
            out[i] = x[: length[k], k].copy()
        at = end
    return out


def smooth(f: DataFrame, lam2: float = 0.0, lam3: float = 1e-7, lam1: float | None = None, dt: float = 0.04, search: bool = False) -> DataFrame:
    """frag_id, x, y, mae_x, mae_y, status: smoothed series; where it fails the input stays and status says why."""

    def floats(column: pd.Series) -> list[np.ndarray]:
        return [np.array([np.nan if v is None else v for v in (s if s is not None else [])], float) for s in column]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = floats(pdf["x"]), floats(pdf["y"])
            found = smooth_series(x + y, lam2, lam3, dt, lam1, search)
            rows = []
            for name, zx, zy, sx, sy in zip(pdf["frag_id"], x, y, found[: len(x)], found[len(x) :], strict=True):
                if sx is None or sy is None:
                    rows.append((name, zx, zy, None, None, "too few samples"))
                else:
                    rows.append((name, sx, sy, float(np.nanmean(np.abs(zx - sx))), float(np.nanmean(np.abs(zy - sy))), "ok"))
            yield pd.DataFrame(rows, columns=["frag_id", "x", "y", "mae_x", "mae_y", "status"])

    return f.select("frag_id", "x", "y").mapInPandas(work, "frag_id string, x array<double>, y array<double>, mae_x double, mae_y double, status string")


def constraint_audit(d: DataFrame, max_acceleration: float = 10.0, max_jerk: float = 10.0) -> DataFrame:
    """Per fragment, how often velocity points backward and acceleration or jerk exceed their limits (differences over the samples' own times)."""
    w = Window.partitionBy("frag_id").orderBy("idx")
    rate = lambda c: (F.col(c) - F.lag(c).over(w)) / (F.col("t") - F.lag("t").over(w))
    v = d.withColumn("v", rate("x"))
    a = v.withColumn("a", rate("v"))
    j = a.withColumn("j", rate("a"))
    over = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    return j.groupBy("frag_id").agg(over(F.col("v") * F.col("direction") < 0).alias("backward"), over(F.abs("a") > max_acceleration).alias("acceleration"), over(F.abs("j") > max_jerk).alias("jerk"))
