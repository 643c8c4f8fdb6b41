"""Exact top-k inner products by a Voronoi kNN join.

Vectors are turned into integers, floor(256 * x), and every vector belongs to the cell of its nearest pivot (a fixed
number of pivots, taken by a hash of vec_id). Split along the direction of pivot p, a vector is (along, across): its part on
p's line and the length of the rest. So for a query with parts (c, e) and a vector with parts (a, b), q.v <= c a + e b. A cell is
cut into `RINGS` rings by b; a ring's summary is its size, the least and greatest a and the greatest b.

  1. Each query meets its own cell, which is solved. The k-th score there, or among the pivots (which are rows too), is the
     query's lower bound.
  2. Cells of queries are put together, nearest pivots first, to groups of about `QUERY_BLOCK` queries. A ring is replicated
     to a group only if its upper bound reaches the lower bound of one of the group's queries.
  3. A group's rings are cut into blocks by a hash of vec_id, its queries likewise; a block of data and a block of queries meet in one
     task. There every (query, ring) pair is bounded once more by the block's own summary, and only pairs that can matter
     are multiplied, ring by ring. The k best of all blocks are merged for each query.

Pivots, summaries and the table of (group, ring) pairs are bounded by `PIVOTS` and `RINGS`, whatever the input. Equal
vectors spread over the blocks of their ring. What is replicated depends on the data: on clustered vectors a small part,
on directions without any structure everything, as no bound of this kind can exclude a ring there. `shares` measures it.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded
with zeros; a query with fewer than k partners gets what there is, with none no rows; equal scores go to the smaller
vec_id; a repeated vec_id counts as one row each, and a query never meets rows of its own vec_id; repeated query rows
answer once; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm import scratch

PIVOTS, RINGS = 48, 8
#: Most vectors of a data block and of a query block, on average.
DATA_BLOCK, QUERY_BLOCK = 16_384, 2_048
SCALE = 256
FOUND = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id and v (doubles that are integers), of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * SCALE).cast("double")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of `width`, shorter ones padded with zeros."""
    n = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(n) and (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products as integers: doubles are exact below 2**53, larger ones use 64-bit integers."""
    if len(q) and len(v) and np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1] >= 2.0**53:
        return q.astype(np.int64) @ v.astype(np.int64).T
    return (q @ v.T).astype(np.int64)


class Centres:
    """The pivots, their directions, and the parts of vectors along and across them."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows, ids
        length = np.sqrt((rows**2).sum(1))
        self.directions = rows / np.where(length > 0, length, 1.0)[:, None]

    @property
    def width(self) -> int:
        return self.rows.shape[1]

    def cell(self, v: np.ndarray) -> np.ndarray:
        return (v @ self.rows.T - (self.rows**2).sum(1) / 2).argmax(1) if len(v) else np.zeros(0, np.int64)

    def parts(self, v: np.ndarray, cells: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(along, across) for the given cell of each vector, or for all pivots."""
        along = v @ self.directions.T if cells is None else (v * self.directions[cells]).sum(1)
        square = (v**2).sum(1)
        return along, np.sqrt(np.maximum((square[:, None] if cells is None else square) - along**2, 0.0))


def upper(c: np.ndarray, e: np.ndarray, low: np.ndarray, high: np.ndarray, across: np.ndarray) -> np.ndarray:
    """The greatest inner product of queries with parts (c, e) and vectors whose parts lie in [low, high] and up to across."""
    a, b = np.maximum(c * low, c * high), e * across
    return a + b + 1e-9 * (np.abs(a) + b) + 1e-3


def _cells(centres: Centres):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), centres.width)
            cell = centres.cell(v)
            along, across = centres.parts(v, cell)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(along), pa.array(across)], names=["vec_id", "v", "cell", "along", "across"])

    return run


def _best(ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of s, column) of each row's k highest scores; columns are in order of id, which decides ties. Scores at the minimum don't count."""
    least = np.iinfo(np.int64).min
    cut = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), least)
    rows, columns = [], []
    for i in range(len(s)):
        at = np.flatnonzero((s[i] >= cut[i]) & (s[i] > least))
        at = at[np.lexsort((at, -s[i][at]))][:k]
        rows.append(np.full(len(at), i))
        columns.append(at)
    return np.concatenate(rows), np.concatenate(columns)


def _table(queries: list[np.ndarray], ids: list[np.ndarray], found: list[np.ndarray]) -> pa.Table:
    flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (queries, ids, found)]
    return pa.table(flat, names=["query_id", "vec_id", "score"])


def _own(k: int, width: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block of a cell and a block of the queries of that cell."""
        ids, v = left["vec_id"].to_numpy(), matrix(left["v"].combine_chunks(), width)
        queries, q = right["vec_id"].to_numpy(), matrix(right["v"].combine_chunks(), width)
        out: tuple[list, list, list] = ([], [], [])
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        for a in range(0, len(q), 256):
            s = np.where(ids[None] == queries[a : a + 256, None], np.iinfo(np.int64).min, scores(q[a : a + 256], v))
            row, at = _best(ids, s, k)
            for column, x in zip(out, (queries[a + row], ids[at], s[row, at]), strict=True):
                column.append(x)
        return _table(*out)

    return run


def _rest(k: int, centres: Centres):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block of rings and a block of queries of a group; a query's own cell is done."""
        cell, across = left["cell"].to_numpy(), left["across"].to_numpy()
        ids, along, v = left["vec_id"].to_numpy(), left["along"].to_numpy(), matrix(left["v"].combine_chunks(), centres.width)
        queries, q = right["vec_id"].to_numpy(), matrix(right["v"].combine_chunks(), centres.width)
        own, bound = right["cell"].to_numpy(), right["bound"].to_numpy()
        out: tuple[list, list, list] = ([], [], [])
        order = np.argsort(ids, kind="stable")
        ids, cell, ring, along, across, v = ids[order], cell[order], left["ring"].to_numpy()[order], along[order], across[order], v[order]
        parts = np.unique(cell.astype(np.int64) * RINGS + ring, return_inverse=True)
        rows = [np.flatnonzero(parts[1] == i) for i in range(len(parts[0]))]
        for a in range(0, len(q), 256):
            some = slice(a, a + 256)
            c, e = centres.parts(q[some])
            s = np.full((len(c), len(ids)), np.iinfo(np.int64).min)
            for key, at in zip((parts[0] // RINGS).tolist(), rows, strict=True):
                use = np.flatnonzero((own[some] != key) & (upper(c[:, key], e[:, key], along[at].min(), along[at].max(), across[at].max()) >= bound[some]))
                if len(use):
                    s[use[:, None], at[None]] = scores(q[some][use], v[at])
            s[ids[None] == queries[some, None]] = np.iinfo(np.int64).min
            row, at = _best(ids, s, k)
            for column, x in zip(out, (queries[a + row], ids[at], s[row, at]), strict=True):
                column.append(x)
        return _table(*out)

    return run


def gathered(counts: dict[int, int], centres: Centres, limit: int) -> dict[int, int]:
    """Cell of queries to group: from the fullest cell on, the nearest ones that are left, as long as a group stays within `limit`."""
    left, group, out = dict(counts), 0, {}
    while left:
        seed = max(left, key=lambda i: (left[i], -i))
        near = sorted(left, key=lambda i: (i != seed, ((centres.rows[i] - centres.rows[seed]) ** 2).sum(), i))
        size = 0
        for i in near:
            if i == seed or size + left[i] <= limit:
                size += left.pop(i)
                out[i] = group
        group += 1
    return out


class Plan(NamedTuple):
    """What the summaries say: data and queries laid out, and which rings go to which groups."""

    centres: Centres
    data: DataFrame  # vec_id, v, cell, along, across, ring
    asked: DataFrame  # vec_id, v, cell, bound, grp
    first: DataFrame  # results of the queries' own cells
    rings: dict[tuple[int, int], int]  # (cell, ring): rows
    needs: dict[tuple[int, int, int], int]  # (group, cell, ring): queries that may need it
    queries: dict[int, int]  # group: queries


def plan(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str, pivots: int) -> Plan | None:
    """None if no vector takes part."""
    spark = vectors.sparkSession
    data, asked = integers(vectors, id_col, vector), integers(queries, id_col, vector).dropDuplicates(["vec_id"])
    chosen = data.dropDuplicates(["v"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    if not chosen:
        return None
    rows = np.zeros((len(chosen), max(1, data.agg(F.max(F.size("v"))).first()[0] or 1)))
    for i, r in enumerate(chosen):
        rows[i, : len(r["v"])] = r["v"]
    centres = Centres(rows, np.array([r["vec_id"] for r in chosen]))
    laid = "vec_id long, v array<double>, cell int, along double, across double"
    cells = scratch.keep(data.mapInArrow(_cells(centres), laid), "cells")
    asked = scratch.keep(asked.mapInArrow(_cells(centres), laid).select("vec_id", "v", "cell"), "asked")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("across").alias("across")).collect()
    wide = F.create_map(*(F.lit(x) for r in sizes for x in (r["cell"], r["across"])))
    ring = F.when(wide[F.col("cell")] > 0, F.least(F.lit(RINGS - 1), F.floor(F.col("across") / wide[F.col("cell")] * RINGS))).otherwise(0)
    data = cells.withColumn("ring", ring.cast("int"))
    summary = data.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("across").alias("across")).collect()
    n_queries = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    groups = gathered(n_queries, centres, QUERY_BLOCK)

    rows_of = {r["cell"]: r["n"] for r in sizes}
    blocks = [(i, -(-rows_of.get(i, 0) // DATA_BLOCK), -(-n_queries.get(i, 0) // QUERY_BLOCK), groups.get(i, -1)) for i in range(len(chosen))]
    blocks = F.broadcast(spark.createDataFrame(blocks, "cell int, d int, q int, grp int"))  # one row for each pivot
    left = cells.join(blocks, "cell").where("q > 0").select("cell", _slot("d").alias("db"), _spread("q").alias("qb"), "vec_id", "v")
    asked = asked.join(blocks, "cell")
    right = asked.where("d > 0").select("cell", _spread("d").alias("db"), _slot("q").alias("qb"), "vec_id", "v")
    keys = ["cell", "db", "qb"]
    own = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_own(k, centres.width), FOUND)
    first = scratch.keep(_merged(own, k), "own")
    bound = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("bound"))
    asked = asked.join(bound, asked["vec_id"] == bound["query_id"], "left").select("vec_id", "v", "cell", "grp", "bound")
    asked = scratch.keep(asked.mapInArrow(_bounds(centres, k), "vec_id long, v array<double>, cell int, grp int, bound double"), "bounds")
    needed = asked.mapInArrow(_needs(centres, summary), "grp int, cell int, ring int, n long").groupBy("grp", "cell", "ring").agg(F.sum("n").alias("n")).collect()
    per_group: dict[int, int] = {}
    for cell, n in n_queries.items():
        per_group[groups[cell]] = per_group.get(groups[cell], 0) + n
    return Plan(centres, data, asked, first, {(r["cell"], r["ring"]): r["n"] for r in summary}, {(r["grp"], r["cell"], r["ring"]): r["n"] for r in needed}, per_group)


def _slot(n: str):
    return F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")


def _spread(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _bounds(centres: Centres, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Raises each bound to the k-th score among the pivots."""
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), matrix(batch.column(1), centres.width)
            bound = batch.column(4).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            if len(centres.ids) >= k:
                seen = np.where(centres.ids[None] == ids[:, None], -np.inf, q @ centres.rows.T)
                bound = np.maximum(bound, np.sort(seen, 1)[:, -k])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bound)], names=["vec_id", "v", "cell", "grp", "bound"])

    return run


def _needs(centres: Centres, summary: list):
    cell, ring = (np.array([r[c] for r in summary], np.int64) for c in ("cell", "ring"))
    low, high, across = (np.array([r[c] for r in summary]) for c in ("low", "high", "across"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many queries of a batch may need each ring of another cell, by group."""
        for batch in batches:
            q, own = matrix(batch.column(1), centres.width), batch.column(2).to_numpy()
            group, bound = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            c, e = centres.parts(q)
            use = (upper(c[:, cell], e[:, cell], low, high, across) >= bound[:, None]) & (own[:, None] != cell)
            which = np.unique(group)
            n = np.stack([use[group == g].sum(0) for g in which]) if len(which) else np.zeros((0, len(cell)), np.int64)
            row, at = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(which[row].astype(np.int32)), pa.array(cell[at].astype(np.int32)), pa.array(ring[at].astype(np.int32)), pa.array(n[row, at].astype(np.int64))], names=["grp", "cell", "ring", "n"])

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def shares(p: Plan) -> tuple[float, float]:
    """(share of all (query, vector) pairs that are multiplied or bounded one by one, rows replicated for each data row)."""
    rows, asked = sum(p.rings.values()), sum(p.queries.values())
    pairs = sum(n * p.rings[cell, ring] for (_, cell, ring), n in p.needs.items())
    return pairs / max(1, rows * asked), sum(p.rings[cell, ring] for _, cell, ring in p.needs) / max(1, rows)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of every query with all other rows."""
    spark = vectors.sparkSession
    p = plan(vectors, queries, k, id_col, vector, pivots)
    if p is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = p.first.select("query_id", "vec_id", "score")
    if p.needs:
        rows: dict[int, int] = {}
        for g, cell, ring in p.needs:
            rows[g] = rows.get(g, 0) + p.rings[cell, ring]
        size = {g: (-(-n // DATA_BLOCK), -(-p.queries[g] // QUERY_BLOCK)) for g, n in rows.items()}
        # at most PIVOTS groups times PIVOTS * RINGS rings
        needs = F.broadcast(spark.createDataFrame([(g, cell, ring, *size[g]) for g, cell, ring in p.needs], "grp int, cell int, ring int, d int, q int"))
        blocks = F.broadcast(spark.createDataFrame([(g, *x) for g, x in size.items()], "grp int, d int, q int"))
        left = p.data.join(needs, ["cell", "ring"]).select("grp", _slot("d").alias("db"), _spread("q").alias("qb"), "vec_id", "v", "cell", "ring", "along", "across")
        right = p.asked.join(blocks, "grp").select("grp", _spread("d").alias("db"), _slot("q").alias("qb"), "vec_id", "v", "cell", "bound")
        keys = ["grp", "db", "qb"]
        found = found.unionByName(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_rest(k, p.centres), FOUND))
    return _merged(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(50)) == 0))


SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from e q join e c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""
