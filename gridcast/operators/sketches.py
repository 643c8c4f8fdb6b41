"""Mergeable quantile sketches of many columns in one scan.

A sketch is a stack of compactors: level l holds values that stand for 2 ** l rows each. A level beyond its room is sorted and every other
value moves up; the half that stays behind alternates. Sketches merge by joining their levels. Up to `ROOM` values of a
column nothing is compacted and quantiles are exact; beyond, a rank is off by some n / ROOM at most times the number of levels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOM = 4096


class Sketch:
    """Values of one column, with their weights by level."""

    def __init__(self, room: int = ROOM):
        self.room, self.levels, self.turn = room, [np.zeros(0)], 0

    def add(self, values: np.ndarray, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append(np.zeros(0))
        self.levels[level] = np.concatenate((self.levels[level], values))
        while level < len(self.levels) and len(self.levels[level]) > self.room:
            own = np.sort(self.levels[level])
            odd = own[len(own) // 2 * 2 :]  # one value of an odd number stays
            up = own[: len(own) // 2 * 2][self.turn :: 2]
            self.turn ^= 1
            self.levels[level] = odd
            level += 1
            if level == len(self.levels):
                self.levels.append(np.zeros(0))
            self.levels[level] = np.concatenate((self.levels[level], up))

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Values in order and the rows that they stand for."""
        value = np.concatenate(self.levels)
        weight = np.concatenate([np.full(len(v), 1 << i, np.int64) for i, v in enumerate(self.levels)])
        order = np.argsort(value, kind="stable")
        return value[order], weight[order]

    def at(self, shares: Sequence[float]) -> list[float]:
        """For each share the least value that so much of the rows don't exceed; none without rows."""
        value, weight = self.sorted()
        if not len(value):
            return []
        reach = np.cumsum(weight)
        return value[np.searchsorted(reach, np.ceil(np.asarray(shares) * reach[-1] - 1e-9).clip(1))].tolist()


def quantiles(df: DataFrame, names: Sequence[str], shares: Sequence[float], room: int = ROOM) -> dict[str, list[float]]:
    """The quantiles of each column's values that are there; an empty list for a column without any. The driver gets these only."""
    x = df.select(*(F.col(f"`{n}`").cast("double").alias(f"c{i}") for i, n in enumerate(names)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Sketch(room) for _ in names]
        for batch in batches:
            for sketch, column in zip(own, batch.columns, strict=True):
                v = column.to_numpy(zero_copy_only=False)
                sketch.add(v[~np.isnan(v)])
        rows = [(i, level, v.tobytes()) for i, s in enumerate(own) for level, v in enumerate(s.levels) if len(v)]
        i, level, v = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(level, pa.int32()), pa.array(v, pa.binary())], names=["i", "level", "items"])

    def merge(group: pa.Table) -> pa.Table:
        whole = Sketch(room)
        for level, v in sorted(zip(group["level"].to_pylist(), group["items"].to_pylist(), strict=True)):
            whole.add(np.frombuffer(v), level)
        return pa.table({"i": group["i"][:1], "found": pa.array([whole.at(shares)], pa.list_(pa.float64()))})

    merged = x.mapInArrow(scan, "i int, level int, items binary").groupBy("i").applyInArrow(merge, "i int, found array<double>")
    found = {r["i"]: list(r["found"]) for r in merged.collect()}
    return {n: found.get(i, []) for i, n in enumerate(names)}


def compressed(value: np.ndarray, weight: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted values in order, at most `points` of them: of each equal share of the weight the middle one, which stands for it."""
    order = np.argsort(value, kind="stable")
    value, weight = value[order], weight[order]
    if len(value) <= points:
        return value, weight
    reach = np.cumsum(weight)
    slot = np.minimum((reach - weight / 2) / reach[-1] * points, points - 1).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    last = np.append(first[1:], len(slot)) - 1
    whole = np.add.reduceat(weight, first)
    middle = np.searchsorted(reach, reach[last] - whole / 2)
    return value[middle], whole


def weighted_quantile(value: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The least value that at least `share` of the weight doesn't exceed; 0 without weight."""
    keep = weight > 0
    if not keep.any():
        return 0.0
    value, weight = value[keep], weight[keep]
    order = np.argsort(value, kind="stable")
    reach = np.cumsum(weight[order])
    return float(value[order][np.searchsorted(reach, share * reach[-1] * (1 - 1e-12))])
