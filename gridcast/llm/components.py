"""Connected components of a link table: links are contracted inside tasks, then labels flow to smaller ids by joins until nothing changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm import scratch

MOST_ROUNDS = 60
#: Links that a task contracts at once.
CHUNK = 1 << 18
LINKS = "a long, b long"


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns id, component (its smallest reachable id) for every id that has a link.

    A round contracts the links of each task, chunk by chunk, to stars (no exchange), and, unless all links are stars of
    one table then, replaces every link by links to the smallest neighbour of either end (large star, then small star), so
    that a chain halves in length. These are two aggregations with map-side combining; each result is written to the shared
    folder, and only a count comes to the driver.
    """
    edges = scratch.keep(_canonical(links.select("a", "b").mapInArrow(_contract, LINKS)), "links")
    for _ in range(MOST_ROUNDS):
        edges = scratch.keep(edges.mapInArrow(_contract, LINKS), "links")
        if _settled(edges):
            break
        edges = scratch.keep(_stars(_canonical(edges)), "links")
    else:
        raise RuntimeError(f"components: not settled after {MOST_ROUNDS} rounds")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes is connected with."""
    label = np.arange(n)
    while True:
        one, two = label[a], label[b]
        low, high = np.minimum(one, two), np.maximum(one, two)
        open_ = low < high
        if not open_.any():
            return label
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's links as stars around the smallest ids."""

    def solve(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([x.column(c).to_numpy() for x in waiting]) for c in (0, 1)]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        label = roots(*np.split(at, 2), len(nodes))
        leaf = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[label[leaf]]), pa.array(nodes[leaf])], names=["a", "b"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(x.num_rows for x in waiting) >= CHUNK:
            yield solve(waiting)
            waiting = []
    if waiting:
        yield solve(waiting)


def _settled(edges: DataFrame) -> bool:
    """Whether all links are stars: no leaf has two centres or is a centre."""
    ends = edges.select(F.col("b").alias("id"), F.col("a").alias("centre"), F.lit(False).alias("is_centre")).unionByName(edges.select(F.col("a").alias("id"), F.lit(None).cast("long").alias("centre"), F.lit(True).alias("is_centre")))
    met = ends.groupBy("id").agg(F.min("centre").alias("low"), F.max("centre").alias("high"), F.max("is_centre").alias("both"))
    return not met.where("low < high or (low is not null and both)").limit(1).count()


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # large star: larger neighbours of a node go to the node's smallest neighbour (or itself)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = _canonical(large)
    # small star: a node and its smaller neighbours go to the smallest of them
    low = down.groupBy("b").agg(F.min("a").alias("m"))
    small = down.join(low, "b").select(F.col("b"), F.col("a"), "m")
    return _canonical(small.select(F.col("a").alias("x"), "m").where("x > m").unionByName(low.select(F.col("b").alias("x"), "m")).select(F.col("m").alias("a"), F.col("x").alias("b")))


def _canonical(links: DataFrame) -> DataFrame:
    """Each link once, the smaller id as a."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
