"""Rolling statistics of many and long windows: blocks of a series with a halo, each worked on as arrays.

A sliding frame evaluates its w values anew for every row. Here all windows and aggregates of a column share, in each block, one set of running
sums (counts, sums, squares), one wavelet matrix for ranks and quantiles, and block-wise extremes; no step is taken for a single row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.operators import grid


class Rolled(NamedTuple):
    """A column to make: name, input, window, values needed, the quantile (None: average rank of the current value as a share), or an aggregate instead (mean, sum, std, min, max)."""

    name: str
    x: str
    w: int
    least: int
    q: float | None = None
    agg: str | None = None


class Wavelet:
    """Order statistics of ranges of an array: for each bit of the values' ranks, how many entries before each place have a 0, after the entries were sorted by the bits above."""

    def __init__(self, values: np.ndarray):
        self.values, code = np.unique(values, return_inverse=True)
        self.code = code.astype(np.int64)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, (len(self.values) - 1).bit_length()) - 1, -1, -1):
            one = (code >> bit) & 1 == 1
            zeros = np.concatenate(([0], np.cumsum(~one)))
            self.levels.append((bit, zeros, int(zeros[-1])))
            code = np.concatenate((code[~one], code[one]))

    def below(self, low: np.ndarray, high: np.ndarray, code: np.ndarray) -> np.ndarray:
        """How many entries of [low, high) have a smaller rank than code."""
        n = np.zeros(len(low), np.int64)
        for bit, zeros, split in self.levels:
            a, b, one = zeros[low], zeros[high], (code >> bit) & 1 == 1
            n += np.where(one, b - a, 0)
            low, high = np.where(one, split + low - a, a), np.where(one, split + high - b, b)
        return n

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of [low, high)."""
        code, k = np.zeros(len(low), np.int64), k.copy()
        for bit, zeros, split in self.levels:
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            code |= one.astype(np.int64) << bit
            k = np.where(one, k - (b - a), k)
            low, high = np.where(one, split + low - a, a), np.where(one, split + high - b, b)
        return self.values[code]


class Line:
    """A series (NaN: missing) with what its windows share."""

    def __init__(self, values: Sequence[float]):
        self.x = np.asarray(values, float)
        self.there = ~np.isnan(self.x)
        self.upto = np.concatenate(([0], np.cumsum(self.there)))
        self.wavelet: Wavelet | None = None
        self.sums: tuple[float, np.ndarray, np.ndarray] | None = None

    def window(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the range of its window among the values that are there."""
        i = np.arange(len(self.x))
        return self.upto[np.maximum(i + 1 - w, 0)], self.upto[i + 1]

    def ordered(self) -> Wavelet:
        self.wavelet = self.wavelet or Wavelet(self.x[self.there])
        return self.wavelet

    def rank(self, w: int, least: int) -> np.ndarray:
        """Average rank of each row's value in its window, as a share."""
        out = np.full(len(self.x), np.nan)
        low, high = self.window(w)
        use = np.flatnonzero(self.there & (high - low >= max(1, least)))
        if len(use):
            tree = self.ordered()
            code = tree.code[self.upto[use]]
            below = tree.below(low[use], high[use], code)
            equal = tree.below(low[use], high[use], code + 1) if len(tree.values) > 1 else high[use] - low[use]
            equal = np.where(code + 1 < 1 << len(tree.levels), equal, high[use] - low[use]) - below
            out[use] = (below + (equal + 1) / 2) / (high - low)[use]
        return out

    def quantile(self, w: int, least: int, q: float) -> np.ndarray:
        """The interpolated quantile of each window."""
        out = np.full(len(self.x), np.nan)
        low, high = self.window(w)
        use = np.flatnonzero(high - low >= max(1, least))
        if len(use):
            low, high = low[use], high[use]
            rank = q * (high - low - 1)
            a = rank.astype(np.int64)
            one, two = (self.ordered().smallest(low, high, k) for k in (a, np.minimum(a + 1, high - low - 1)))
            out[use] = one + (two - one) * (rank - a)
        return out

    def extreme(self, w: int, least: int, agg: str) -> np.ndarray:
        """Largest or smallest value of each window: the end of one block of w rows and the beginning of the next."""
        sign = 1.0 if agg == "max" else -1.0
        n = len(self.x)
        whole = np.full(-(-(n + w - 1) // w) * w, -np.inf)
        whole[w - 1 : w - 1 + n] = np.where(self.there, sign * self.x, -np.inf)
        parts = whole.reshape(-1, w)
        begin = np.maximum.accumulate(parts, 1).ravel()
        end = np.maximum.accumulate(parts[:, ::-1], 1)[:, ::-1].ravel()
        best = sign * np.maximum(end[:n], begin[w - 1 : w - 1 + n])
        low, high = self.window(w)
        return np.where(high - low >= max(1, least), best, np.nan)

    def moment(self, w: int, least: int, agg: str) -> np.ndarray:
        """Mean, sum or standard deviation of each window, by differences of running sums of the centred values (in extended precision)."""
        if self.sums is None:
            centre = float(self.x[self.there].mean()) if self.there.any() else 0.0
            v = (self.x[self.there] - centre).astype(np.longdouble)
            self.sums = centre, np.concatenate(([0.0], np.cumsum(v))), np.concatenate(([0.0], np.cumsum(v * v)))
        centre, one, two = self.sums
        low, high = self.window(w)
        n, s = high - low, one[high] - one[low]
        with np.errstate(divide="ignore", invalid="ignore"):
            if agg == "std":
                out = np.sqrt(np.maximum((two[high] - two[low] - s * s / n) / (n - 1), 0.0))
                out[self.extreme(w, 1, "max") == self.extreme(w, 1, "min")] = 0.0  # equal values, where differences leave rounding
            else:
                out = s / n + centre if agg == "mean" else s + n * centre
        return np.where(n >= max(2 if agg == "std" else 1, least), out.astype(float), np.nan)

    def made(self, m: Rolled) -> np.ndarray:
        if m.agg in ("min", "max"):
            return self.extreme(m.w, m.least, m.agg)
        if m.agg:
            return self.moment(m.w, m.least, m.agg)
        return self.rank(m.w, m.least) if m.q is None else self.quantile(m.w, m.least, m.q)


def walk(values: Sequence[float], w: int, least: int, q: float | None) -> Iterator[float | None]:
    """The rank or quantile of each row's window of w rows, in order; None where there is none."""
    found = Line(values).made(Rolled("", "", w, least, q))
    return (None if np.isnan(v) else float(v) for v in found)


def rolled(df: DataFrame, made: Sequence[Rolled], step: int, keys: Sequence[str] = ("region",), ts: str = "ts", rows: int = 8640) -> DataFrame:
    """Adds the columns. df is a dense series for each key; each block of `rows` grid rows is one group with the rows ahead of it that its windows need."""
    before = max(m.w for m in made) - 1
    cut = grid.blocks(df, step, rows, before, ts=ts)
    schema = T.StructType([*df.schema.fields, *(T.StructField(m.name, T.DoubleType()) for m in made)])

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(ts, kind="stable")
        own = part.pop("own").to_numpy(bool)
        part = part.drop(columns="block")
        out = part[own].copy()
        lines = {x: Line(part[x].astype(float).to_numpy()) for x in {m.x for m in made}}
        return pd.concat([out, pd.DataFrame({m.name: lines[m.x].made(m)[own] for m in made}, index=out.index)], axis=1)

    return cut.groupBy(*keys, "block").applyInPandas(work, schema).select(*(F.col(f.name) for f in schema))
