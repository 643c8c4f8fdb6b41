"""Gradient boosting of many models at once: every horizon, loss, fold and number of features in the same Spark jobs.

Examples are packed into blocks of rows of one horizon: binned features (a byte each), labels, weights, folds and the margin of every
model of the horizon. A tree grows level by level. For each level one job lets every task add up the gradient histograms of all its models, and
one group for each (horizon, model) sums them and takes the best split of each node; another job sets the leaves. So a
round takes depth + 1 jobs, whatever the number of models. New trees are applied as the blocks are read; every `RENEW` rounds the blocks are
written anew with the margins so far, which also cuts the lineage.

Losses: squared, binary (log loss), absolute and quantile (pinball loss). The last two grow by the signs of their gradients, and their leaves are
weighted quantiles of the residuals, from sketches of `POINTS` values for each leaf and task that are merged by leaf. The validation loss of
each round comes with the next round's first job; a model without improvement for `patience` rounds stops, and keeps the trees up to its best round.

A value that is missing goes left. The result is a flat table of nodes, which `Forest` evaluates for all models in one pass.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.operators import shared, sketches

BLOCK, BINS, POINTS, RENEW = 4096, 32, 128, 5
NODES = "h int, model string, tree int, node int, feature string, threshold double, left int, right int, value double, gain double"
SMALL = 1e-12


@dataclass(frozen=True)
class Model:
    """One model of a horizon. label, weight: places in the examples' arrays; features: it sees the first so many of the horizon's (0: all).

    It learns from rows of folds below `fold` and stops by the rows of `fold`.
    """

    h: int
    name: str
    kind: str  # squared, absolute, quantile, binary
    label: int = 0
    weight: int | None = None
    quantile: float = 0.5
    positive: float = 1.0
    features: int = 0
    fold: int = 1

    @property
    def share(self) -> float | None:
        """The quantile of the residuals that is a leaf; none where it is a mean."""
        return {"absolute": 0.5, "quantile": self.quantile}.get(self.kind)


# ---- blocks ----


def packed(examples: DataFrame, edges: dict[int, list[np.ndarray]], models: dict[int, list[Model]], block: int = BLOCK) -> DataFrame:
    """Blocks of one horizon each. examples: h, fold, x (array), labels (array), weights (array); edges: for each horizon those of its features."""
    size = {r["h"]: r["n"] for r in examples.groupBy("h").agg(F.count("*").alias("n")).collect()}  # a row for each horizon
    slices = F.create_map(*(F.lit(v) for h, n in size.items() for v in (h, -(-n // block))))
    dealt = examples.where(F.col("h").isin(*edges)).withColumn("slice", F.pmod(F.xxhash64("x", "labels", "fold"), slices[F.col("h")]))

    def pack(group: pa.Table) -> pa.Table:
        h, n = group["h"][0].as_py(), len(group)
        table = lambda c, width: group[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, width)
        x, own = table("x", len(edges[h])), edges[h]
        bins = np.stack([np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v)) for v, e in zip(x.T, own, strict=True)], 1).astype(np.uint8)
        labels, weights = (table(c, len(group[c][0].as_py())) for c in ("labels", "weights"))
        fold = group["fold"].to_numpy().astype(np.int8)
        row = [h, n, fold.tobytes(), bins.tobytes(), labels.tobytes(), weights.tobytes(), np.zeros((n, len(models[h]))).tobytes()]
        return pa.table([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), *[pa.binary()] * 5), strict=True)], names=["h", "n", "fold", "bins", "labels", "weights", "margins"])

    rows = dealt.groupBy("h", "slice").applyInArrow(pack, "h int, n int, fold binary, bins binary, labels binary, weights binary, margins binary")
    return shared.keep(rows, "blocks")


class Block:
    """One block as arrays, with the margins of all trees so far."""

    def __init__(self, row: dict, models: list[Model], trees: list[np.ndarray]):
        self.h, self.n, self.models = row["h"], row["n"], models
        read = lambda c, t: np.frombuffer(row[c], t).reshape(self.n, -1)
        self.fold, self.bins = np.frombuffer(row["fold"], np.int8), read("bins", np.uint8)
        self.labels, self.weights = read("labels", float), read("weights", float)
        self.margins = read("margins", float).copy()
        for made in trees:
            for m in range(len(models)):
                if made[m, 1]["on"]:
                    self.margins[:, m] += made[m]["value"][self.nodes(made[m], None)]

    def nodes(self, tree: np.ndarray, depth: int | None) -> np.ndarray:
        """The node (numbered as a heap from 1) of each row after `depth` steps, or its leaf."""
        at, row = np.ones(self.n, np.int64), np.arange(self.n)
        for _ in range(len(tree).bit_length() - 2 if depth is None else depth):
            f = tree["feature"][at]
            inner = f >= 0
            right = self.bins[row, np.maximum(f, 0)] > tree["cut"][at]
            at = np.where(inner, 2 * at + right, at)
        return at

    def rows(self, m: int, valid: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, label, weight) that a model learns from, or stops by."""
        model = self.models[m]
        y = self.labels[:, model.label]
        w = self.weights[:, model.weight] if model.weight is not None else np.ones(self.n)
        if model.kind == "binary" and model.positive != 1.0:
            w = np.where(y > 0, model.positive * w, w)
        at = np.flatnonzero((self.fold == model.fold if valid else self.fold < model.fold) & ~np.isnan(y) & (w > 0))
        return at, y[at], w[at]

    def gradient(self, m: int, at: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        model, f = self.models[m], self.margins[at, m]
        if model.kind == "squared":
            return w * (f - y), w
        if model.kind == "binary":
            p = 1 / (1 + np.exp(-np.clip(f, -35, 35)))
            return w * (p - y), w * np.maximum(p * (1 - p), SMALL)
        return w * np.where(f > y, 1 - model.share, np.where(f < y, -model.share, 0.0)), w

    def loss(self, m: int) -> tuple[float, float]:
        """(sum of losses, sum of weights) on the validation rows."""
        at, y, w = self.rows(m, valid=True)
        model, f = self.models[m], self.margins[at, m]
        if model.kind == "squared":
            own = (f - y) ** 2
        elif model.kind == "binary":
            own = np.logaddexp(0.0, f) - y * f
        else:
            own = np.where(y > f, model.share * (y - f), (1 - model.share) * (f - y))
        return float(own @ w), float(w.sum())


NODE = np.dtype([("on", bool), ("feature", np.int32), ("cut", np.int32), ("value", float), ("gain", float)])


def _tree(models: int, depth: int) -> np.ndarray:
    out = np.zeros((models, 2 << depth), NODE)
    out["feature"] = -1
    return out


def _by_block(blocks: DataFrame, models: dict[int, list[Model]], trees: dict[int, list[np.ndarray]], work, columns: str, emit) -> DataFrame:
    """Runs work(block, sums) on every block and emits what a task has summed up."""
    shipped = blocks.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                work(Block(row, models[row["h"]], shipped.value[row["h"]]), sums)
        yield emit(sums)

    return blocks.mapInArrow(run, columns)


def _emit(sums: dict) -> pa.RecordBatch:
    keys = list(sums)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["h", "m", "sums"])


def _level(blocks: DataFrame, models, trees, growing: dict[int, np.ndarray], active: set, level: int, bins: int, least: int, l2: float):
    """The best splits of all nodes of a level, as rows (h, m, splits); at the first level also the validation loss."""
    shipped = blocks.sparkSession.sparkContext.broadcast((growing, active))
    nodes = 1 << level

    def work(block: Block, sums: dict) -> None:
        growing, active = shipped.value
        for m in range(len(block.models)):
            if (block.h, m) not in active:
                continue
            width = block.models[m].features or block.bins.shape[1]
            at, y, w = block.rows(m)
            g, s = block.gradient(m, at, y, w)
            node = block.nodes(growing[block.h][m], level)[at] - nodes
            here = node >= 0
            at, g, s, node = at[here], g[here], s[here], node[here]
            key = ((node[:, None] * width + np.arange(width)) * bins + block.bins[at, :width]).ravel()
            size = nodes * width * bins
            hist = [np.bincount(key, None if v is None else np.repeat(v, width), size).astype(float) for v in (g, s, None)]
            own = np.concatenate((block.loss(m) if level == 0 else (0.0, 0.0), *hist))
            old = sums.get((block.h, m))
            sums[block.h, m] = own if old is None else old + own

    def best(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v) for v in group["sums"].to_pylist())
        loss, (g, s, n) = total[:2], total[2:].reshape(3, nodes, -1, bins)
        left = [np.cumsum(v, 2) for v in (g, s, n)]
        whole = [v[:, :1, -1:] for v in left]
        right = [a - b for a, b in zip(whole, left, strict=True)]
        part = lambda g, s: g * g / (s + l2 + SMALL)
        gain = part(left[0], left[1]) + part(right[0], right[1]) - part(whole[0], whole[1])
        gain = np.where((left[2] >= least) & (right[2] >= least) & (gain > 1e-9 * (1 + part(whole[0], whole[1]))), gain, 0.0).reshape(nodes, -1)
        at = gain.argmax(1)
        out = np.stack((np.where(gain.max(1) > 0, at // bins, -1), at % bins, gain.max(1)), 1)
        return pa.table({"h": group["h"][:1], "m": group["m"][:1], "loss": pa.array([loss.tolist()], pa.list_(pa.float64())), "splits": pa.array([out.ravel().tolist()], pa.list_(pa.float64()))})

    rows = _by_block(blocks, models, trees, work, "h int, m int, sums binary", _emit)
    return rows.groupBy("h", "m").applyInArrow(best, "h int, m int, loss array<double>, splits array<double>").collect()


def _leaves(blocks: DataFrame, models, trees, growing: dict[int, np.ndarray], active: set, l2: float, start: bool):
    """The values of all leaves, as rows (h, m, values)."""
    shipped = blocks.sparkSession.sparkContext.broadcast((growing, active))

    def work(block: Block, sums: dict) -> None:
        growing, active = shipped.value
        for m, model in enumerate(block.models):
            if (block.h, m) not in active:
                continue
            tree = growing[block.h][m]
            at, y, w = block.rows(m)
            leaf = block.nodes(tree, None)[at]
            if model.share is None:
                g, s = (-w * y, w) if start else block.gradient(m, at, y, w)
                own = np.stack((np.bincount(leaf, g, len(tree)), np.bincount(leaf, s, len(tree))))
                old = sums.get((block.h, m))
                sums[block.h, m] = own if old is None else old + own
            else:
                e = y - block.margins[at, m]
                parts = sums.setdefault((block.h, m), {})
                for k in np.unique(leaf).tolist():
                    mine = leaf == k
                    v, u = (np.concatenate(p) for p in zip(parts.get(k, (np.zeros(0), np.zeros(0))), (e[mine], w[mine]), strict=True))
                    parts[k] = sketches.compressed(v, u, POINTS) if len(v) > 8 * POINTS else (v, u)

    def emit(sums: dict) -> pa.RecordBatch:
        flat = {}
        for key, own in sums.items():
            if isinstance(own, dict):
                rows = [(k, *sketches.compressed(v, u, POINTS)) for k, (v, u) in own.items()]
                flat[key] = np.concatenate([np.stack((np.full(len(v), k), v, u), 1) for k, v, u in rows]) if rows else np.zeros((0, 3))
            else:
                flat[key] = own
        return _emit(flat)

    def set_(group: pa.Table) -> pa.Table:
        h, m = group["h"][0].as_py(), group["m"][0].as_py()
        model, cells = models[h][m], [np.frombuffer(v) for v in group["sums"].to_pylist()]
        if model.share is None:
            g, s = sum(cells).reshape(2, -1)
            values = np.where(s > 0, -g / (s + (0.0 if start else l2) + SMALL), 0.0)
            if start and model.kind == "binary":
                values = np.where(s > 0, np.log(np.clip(values, 1e-6, 1 - 1e-6) / (1 - np.clip(values, 1e-6, 1 - 1e-6))), 0.0)
        else:
            rows = np.concatenate([c.reshape(-1, 3) for c in cells])
            values = np.zeros(shipped.value[0][h].shape[1])
            for k in np.unique(rows[:, 0]).astype(int).tolist():
                own = rows[rows[:, 0] == k]
                values[k] = sketches.weighted_quantile(own[:, 1], own[:, 2], model.share)
        return pa.table({"h": group["h"][:1], "m": group["m"][:1], "values": pa.array([values.tolist()], pa.list_(pa.float64()))})

    rows = _by_block(blocks, models, trees, work, "h int, m int, sums binary", emit)
    return rows.groupBy("h", "m").applyInArrow(set_, "h int, m int, values array<double>").collect()


def _renewed(blocks: DataFrame, models, trees) -> DataFrame:
    """The blocks with the margins of the given trees added."""
    shipped = blocks.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = [Block(r, models[r["h"]], shipped.value[r["h"]]).margins.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], names=batch.schema.names)

    return shared.keep(blocks.mapInArrow(run, blocks.schema), "blocks")


@dataclass
class Fitted:
    """Trees of all models: a table of nodes (NODES) and the rounds that each model kept, with its validation loss."""

    nodes: pa.Table
    rounds: dict[tuple[int, str], int]
    loss: dict[tuple[int, str], float]
    jobs: int


def fit(examples: DataFrame, models: Sequence[Model], features: dict[int, Sequence[str]], edges: dict[str, Sequence[float]], rounds: int = 20, depth: int = 3, rate: float = 0.1, least: int = 20, l2: float = 0.0, patience: int | None = None, block: int = BLOCK) -> Fitted:
    """examples: h, fold, x (the horizon's features in their order), labels, weights; edges: the upper ends of each feature's bins.

    Driver and tasks hold the trees since the last renewal; all trees together are models * rounds * 2 ** (depth + 1) nodes at most.
    """
    by_h: dict[int, list[Model]] = defaultdict(list)
    for model in models:
        by_h[model.h].append(model)
    by_h = {h: own for h, own in by_h.items() if h in features}
    cuts = {h: [np.unique(np.asarray(edges[f], float)) for f in features[h]] for h in by_h}
    bins = 2 + max((len(e) for own in cuts.values() for e in own), default=0)
    if bins > 256:
        raise ValueError("at most 254 edges a feature")
    blocks = packed(examples, cuts, by_h, block)
    every = {(h, m) for h, own in by_h.items() for m in range(len(own))}
    fresh = lambda d: {h: _tree(len(own), d) for h, own in by_h.items()}
    jobs = 0

    def settled(growing: dict[int, np.ndarray], live: set, pending, factor: float, start: bool = False) -> None:
        for r in _leaves(blocks, by_h, pending, growing, live, l2, start):
            own = growing[r["h"]][r["m"]]
            own["value"] = np.asarray(r["values"])[: len(own)] * factor
            own["on"] = True

    first = fresh(0)
    pending: dict[int, list[np.ndarray]] = {h: [] for h in by_h}
    settled(first, every, pending, 1.0, start=True)
    jobs += 1
    kept: list[dict[int, np.ndarray]] = [first]
    for h in by_h:
        pending[h].append(first[h])
    live = {(h, m) for h, m in every if first[h][m, 1]["on"]}
    best = {k: (np.inf, 0) for k in live}
    for t in range(1, rounds + 2):
        growing = fresh(depth)
        for level in range(depth if t <= rounds else 1):
            if not live:
                break
            found = _level(blocks, by_h, pending, growing, live, level, bins, least, l2)
            jobs += 1
            for r in found:
                key, tree = (r["h"], r["m"]), growing[r["h"]][r["m"]]
                if level == 0 and r["loss"][1] > 0:
                    now = r["loss"][0] / r["loss"][1]
                    if now < best[key][0] - 1e-12:
                        best[key] = (now, t - 1)
                    elif patience is not None and t - 1 - best[key][1] >= patience:
                        live.discard(key)
                        continue
                elif level == 0:
                    best[key] = (np.nan, t - 1)  # nothing to stop by: all rounds
                split = np.asarray(r["splits"]).reshape(-1, 3)
                at = (1 << level) + np.arange(1 << level)
                tree["feature"][at], tree["cut"][at], tree["gain"][at] = split[:, 0].astype(int), split[:, 1].astype(int), split[:, 2]
        if t > rounds or not live:
            break
        settled(growing, live, pending, rate)
        jobs += 1
        kept.append(growing)
        for h in by_h:
            pending[h].append(growing[h])
        if t % RENEW == 0:
            blocks = _renewed(blocks, by_h, pending)
            pending = {h: [] for h in by_h}
            jobs += 1
    last = {k: best[k][1] if patience is not None and k in best else len(kept) - 1 for k in every}
    return Fitted(_table(kept, by_h, features, cuts, last), {(h, by_h[h][m].name): n for (h, m), n in last.items()}, {(h, by_h[h][m].name): best.get((h, m), (np.nan, 0))[0] for h, m in every}, jobs)


def _table(kept, by_h, features, cuts, last) -> pa.Table:
    rows = []
    for t, trees in enumerate(kept):
        for h, own in trees.items():
            for m, model in enumerate(by_h[h]):
                if t > last[h, m] or not own[m, 1]["on"]:
                    continue
                todo = [1]
                while todo:
                    at = todo.pop()
                    n = own[m, at]
                    f = int(n["feature"])
                    if f < 0:
                        rows.append((h, model.name, t, at, None, None, None, None, float(n["value"]), 0.0))
                        continue
                    cut = int(n["cut"])
                    threshold = float(cuts[h][f][cut - 1]) if 1 <= cut <= len(cuts[h][f]) else float("-inf") if cut < 1 else float("inf")
                    rows.append((h, model.name, t, at, features[h][f], threshold, 2 * at, 2 * at + 1, None, float(n["gain"])))
                    todo += [2 * at, 2 * at + 1]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in NODES.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def importance(nodes: DataFrame) -> DataFrame:
    """(h, model, feature, gain): each feature's share of a model's gains."""
    gains = nodes.where("feature is not null").groupBy("h", "model", "feature").agg(F.sum("gain").alias("g"))
    total = gains.groupBy("h", "model").agg(F.sum("g").alias("all"))
    return gains.join(total, ["h", "model"]).select("h", "model", "feature", F.try_divide("g", "all").alias("gain"))


# ---- evaluation ----


class Forest:
    """Nodes of all models of all horizons as arrays. A row's features are given in the order of `columns`."""

    def __init__(self, nodes: pa.Table, columns: Sequence[str], names: Sequence[str], binary: Sequence[str] = ()):
        self.columns, self.names, self.binary = list(columns), list(names), set(binary)
        place = {c: i for i, c in enumerate(self.columns)}
        table = nodes.select(["h", "model", "tree", "node", "feature", "threshold", "left", "right", "value"]).to_pylist()
        index = {(r["h"], r["model"], r["tree"], r["node"]): i for i, r in enumerate(table)}
        child = lambda r, side: index[r["h"], r["model"], r["tree"], r[side]] if r[side] is not None else index[r["h"], r["model"], r["tree"], r["node"]]
        self.feature = np.array([-1 if r["feature"] is None else place[r["feature"]] for r in table], np.int64)
        self.threshold = np.array([0.0 if r["threshold"] is None else r["threshold"] for r in table])
        self.left, self.right = (np.array([child(r, s) for r in table], np.int64) for s in ("left", "right"))
        self.value = np.array([r["value"] or 0.0 for r in table])
        inner = {self.left[i] for i in range(len(table)) if self.feature[i] >= 0} | {self.right[i] for i in range(len(table)) if self.feature[i] >= 0}
        self.roots: dict[tuple[int, str], np.ndarray] = {}
        grouped: dict[tuple[int, str], list[int]] = defaultdict(list)
        for i, r in enumerate(table):
            if i not in inner:
                grouped[r["h"], r["model"]].append(i)
        self.roots = {k: np.array(v, np.int64) for k, v in grouped.items()}
        self.horizons = sorted({h for h, _ in self.roots})

    def margins(self, x: np.ndarray, h: int, name: str) -> np.ndarray | None:
        """The sum of a model's trees for each row; none if the horizon lacks the model."""
        roots = self.roots.get((h, name))
        if roots is None:
            return None
        at, row = np.broadcast_to(roots, (len(x), len(roots))), np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at].sum(1)
            v = x[row, np.maximum(f, 0)]
            at = np.where(inner, np.where(np.isnan(v) | (v <= self.threshold[at]), self.left[at], self.right[at]), at)

    def predict(self, x: np.ndarray, h: int) -> list[np.ndarray | None]:
        out = []
        for name in self.names:
            f = self.margins(x, h, name)
            out.append(1 / (1 + np.exp(-np.clip(f, -700, 700))) if f is not None and name in self.binary else f)
        return out


def predict(df: DataFrame, forest: Forest, keys: Sequence[str], together: int = 512) -> DataFrame:
    """(keys, h, a column for each model) for every row and horizon, in one pass over wide rows; null where a horizon lacks a model."""
    shipped = df.sparkSession.sparkContext.broadcast(forest)
    rows = df.select(*keys, *(F.col(f"`{c}`").cast("double").alias(f"__{i}") for i, c in enumerate(forest.columns)))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for whole in batches:
            for a in range(0, whole.num_rows, together):
                batch = whole.slice(a, together)
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[n:]], 1)
                for h in own.horizons:
                    found = [pa.nulls(len(x), pa.float64()) if p is None else pa.array(p) for p in own.predict(x, h)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.full(len(x), h, np.int32)), *found], names=[*keys, "h", *own.names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n]), "h int", *(f"`{m}` double" for m in forest.names)])
    return rows.mapInArrow(run, schema)


def flattened(spark, model, h: int, name: str, path: str, features: Sequence[str], scale: float = 1.0) -> pa.Table:
    """The trees of a saved MLlib ensemble (the last stage of a pipeline at `path`) as a table of nodes. scale: 2 for a classifier's margin as log odds."""
    stage = model.stages[-1]
    at = f"{path}/stages/{len(model.stages) - 1}_{stage.uid}"
    weights = stage.treeWeights
    rows = []
    for r in spark.read.parquet(f"{at}/data").select("treeID", "nodeData.*").collect():
        inner = r["leftChild"] >= 0
        cut = r["split"]
        rows.append((h, name, r["treeID"], r["id"], features[cut["featureIndex"]] if inner else None, cut["leftCategoriesOrThreshold"][0] if inner else None, r["leftChild"] if inner else None, r["rightChild"] if inner else None, None if inner else scale * weights[r["treeID"]] * r["prediction"], float(r["gain"])))
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in NODES.split(", ")])
