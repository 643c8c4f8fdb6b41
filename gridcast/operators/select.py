"""Feature scores, ranks, duplicates, folds and samples, in long form (feature, h, ...)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.operators import shared, sketches


def correlations(df: DataFrame, names: Sequence[str], method: str = "pearson") -> DataFrame:
    """(a, b, r) for each pair of columns in the given order, missing values left out pairwise; undefined ones are 0.

    Each task adds up the products of all pairs as matrices, and only these sums are shuffled. Spearman takes
    average ranks within each pair's complete rows first.
    """
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    found = (_spearman if method == "spearman" else _pearson)(df, names)
    # a pair without complete rows has no sums
    every = df.sparkSession.createDataFrame(pairs, "a string, b string")
    return every.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("r", F.lit(0.0)).alias("r"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Columns as floating-point numbers, missing ones as NaN."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1) if batch.num_rows else np.zeros((0, batch.num_columns))


def _pearson(df: DataFrame, names: Sequence[str]) -> DataFrame:
    x = df.select(*(F.col(n).cast("double").alias(n) for n in names))
    centre = np.array([v or 0.0 for v in x.agg(*(F.avg(n) for n in names)).first()])  # near zero, so that little is lost by cancellation
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            v = _matrix(batch) - centre
            there = ~np.isnan(v)
            v, m = np.where(there, v, 0.0), there.astype(float)
            # for columns i and j: rows, sum of i, sum of i squared, sum of i times j, over the rows that have both
            total += np.stack((m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v))
        i, j = np.triu_indices(k, 1)
        n, s, q, c = total
        columns = (i, j, n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], c[i, j])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32) if at < 2 else x) for at, x in enumerate(columns)], names=["i", "j", "n", "sx", "sy", "qx", "qy", "c"])

    sums = x.mapInArrow(run, "i int, j int, n double, sx double, sy double, qx double, qy double, c double").groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "qx", "qy", "c")))
    col = F.col
    spread = lambda q, s: F.greatest(col(q) - col(s) * col(s) / col("n"), F.lit(0.0))
    # a spread within rounding of zero is that of a constant column
    flat = lambda q, s: spread(q, s) <= col(q) * 1e-13
    r = F.when((col("n") > 0) & ~flat("qx", "sx") & ~flat("qy", "sy"), (col("c") - col("sx") * col("sy") / col("n")) / F.sqrt(spread("qx", "sx") * spread("qy", "sy")))
    name = F.array(*(F.lit(n) for n in names))
    return sums.select(name[col("i")].alias("a"), name[col("j")].alias("b"), r.alias("r"))


def pearson(a: Column, b: Column) -> Column:
    """Correlation over complete pairs; null where a side is constant (Spark's corr fails on it under ANSI rules)."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def _melted(edges: list[np.ndarray], patterns: dict[int, bytes]):
    of = {p: i for i, p in patterns.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(c, slice, v, p, row): each value that is there, with its slice of the column's range and its row's pattern of nulls."""
        for batch in batches:
            v, row = _matrix(batch.slice(0).select(batch.schema.names[1:])), batch.column(0).to_numpy()
            there = ~np.isnan(v)
            p = np.array([of[x.tobytes()] for x in np.packbits(there, axis=1)], np.int32) if len(v) else np.zeros(0, np.int32)
            at, c = np.nonzero(there)
            slot = np.concatenate([np.searchsorted(e, v[there[:, k], k]) for k, e in enumerate(edges)]) if len(v) else np.zeros(0, np.int64)
            order = np.lexsort((at, c))  # by column, as the slots are
            at, c = at[order], c[order]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(v[at, c]), pa.array(p[at]), pa.array(row[at])], names=["c", "slice", "v", "p", "row"])

    return run


def _spearman(df: DataFrame, names: Sequence[str], slice_rows: int = 200_000) -> DataFrame:
    """Average ranks of each column by one distributed sort, then rank products as sums of matrices; no row is made for a pair.

    The rank of a value among the rows that have another column too is a sum over those rows' patterns of nulls, so a value is ranked against each pattern: its column is cut into
    slices of values, each sorted by itself, with the counts of the slices before it added. Ranked values meet again by blocks of rows, where all pairs' ranks follow from the patterns.
    Equal values lie in one slice. The driver holds the patterns that occur and their counts by column and slice.
    """
    spark, k = df.sparkSession, len(names)
    x = df.select(F.monotonically_increasing_id().alias("row"), *(F.col(f"`{n}`").cast("double").alias(f"c{i}") for i, n in enumerate(names)))
    x = shared.keep(x.select("row", *(F.when(~F.isnan(f"c{i}"), F.col(f"c{i}")).alias(f"c{i}") for i in range(k))), "rows")
    bits = F.concat(*(F.when(F.col(f"c{i}").isNotNull(), "1").otherwise("0") for i in range(k)))
    found = x.groupBy(bits.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    member = np.array([[c == "1" for c in r["p"]] for r in found]).reshape(len(found), k)
    rows = np.array([r["n"] for r in found], np.int64)
    patterns = {i: np.packbits(m).tobytes() for i, m in enumerate(member)}
    slices = max(1, -(-int(rows.sum()) // slice_rows))
    cuts = sketches.quantiles(x, [f"c{i}" for i in range(k)], [i / slices for i in range(1, slices)]) if slices > 1 else {}
    edges = [np.unique(cuts.get(f"c{i}", [])) for i in range(k)]
    melted = shared.keep(x.mapInArrow(_melted(edges, patterns), "c int, slice int, v double, p int, row long"), "melted")
    counts = np.zeros((k, slices, len(found)), np.int64)
    for r in melted.groupBy("c", "slice", "p").agg(F.count("*").alias("n")).collect():
        counts[r["c"], r["slice"], r["p"]] = r["n"]
    before = spark.sparkContext.broadcast(np.cumsum(counts, 1) - counts)

    def rank(group: pa.Table) -> pa.Table:
        c, at = group["c"][0].as_py(), group["slice"][0].as_py()
        v, p = group["v"].to_numpy(), group["p"].to_numpy()
        order = np.argsort(v, kind="stable")
        first = np.searchsorted(v[order], v[order], "left")
        last = np.searchsorted(v[order], v[order], "right")
        upto = np.zeros((len(v) + 1, before.value.shape[2]), np.int64)
        upto[np.arange(1, len(v) + 1), p[order]] = 1
        upto = np.cumsum(upto, 0)
        # for each pattern the rows below, and half of the equal ones
        half = 2 * (upto[first] + before.value[c, at]) + upto[last] - upto[first]
        cell = pa.ListArray.from_arrays(pa.array((np.arange(len(v) + 1) * half.shape[1]).astype(np.int32)), pa.array(half.ravel()))
        return pa.table({"row": group["row"].to_numpy()[order], "c": pa.array(np.full(len(v), c, np.int32)), "half": cell})

    together = max(16, min(1024, (8 << 20) // (k * k)))
    ranked = melted.groupBy("c", "slice").applyInArrow(rank, "row long, c int, half array<long>")
    dealt = ranked.withColumn("block", F.floor(F.col("row") / together)).repartition("block").sortWithinPartitions("block").select("block", "row", "c", "half")
    shared_rows = member.T.astype(np.int64) @ (rows[:, None] * member)  # rows that have both columns

    def solve(parts: list[tuple[np.ndarray, ...]], sums: np.ndarray) -> None:
        row, c, half = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, at = np.unique(row, return_inverse=True)
        n = int(at.max()) + 1
        ranks, there = np.zeros((k, n, k)), np.zeros((k, n), bool)
        # twice the rank among the rows that have column j too, less twice its mean
        ranks[c, at] = half @ member + 1 - (shared_rows[c] + 1)
        there[c, at] = True
        ranks *= there[:, :, None] & there.T[None]
        other = ranks.transpose(2, 1, 0)
        sums[0] += np.einsum("inj,inj->ij", ranks, ranks)
        sums[1] += np.einsum("inj,inj->ij", ranks, other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, now, parts = np.zeros((2, k, k)), None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            row, c = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            half = batch.column(3).flatten().to_numpy().reshape(len(block), -1)
            for a, b in zip(cut, cut[1:], strict=False):
                if block[a] != now and parts:
                    solve(parts, sums)
                    parts = []
                now = block[a]
                parts.append((row[a:b], c[a:b], half[a:b]))
        if parts:
            solve(parts, sums)
        i, j = np.triu_indices(k, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(v) for v in (sums[0][i, j], sums[0][j, i], sums[1][i, j]))], names=["i", "j", "qx", "qy", "c"])

    total = dealt.mapInArrow(run, "i int, j int, qx double, qy double, c double").groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("qx", "qy", "c")))
    name = F.array(*(F.lit(n) for n in names))
    r = F.when((F.col("qx") > 0) & (F.col("qy") > 0), F.col("c") / F.sqrt(F.col("qx") * F.col("qy")))
    return total.select(name[F.col("i")].alias("a"), name[F.col("j")].alias("b"), r.alias("r"))


def mutual_information(df: DataFrame, features: Sequence[str], targets: Sequence[str], bins: int = 8) -> DataFrame:
    """(feature, target, mi) in nats from equal-frequency bins of both, on complete pairs; 0 for a pair without any, or with a constant side.

    The edges are quantiles of each column from mergeable sketches of all columns in one scan; equal values share a bin, so a monotone transform of a column changes
    nothing. The estimate is corrected for the number of cells (half of what chance fills, over the rows) and isn't below 0. Each task counts its cells; bins * bins rows of
    each pair are shuffled.
    """
    names = [*features, *targets]
    x = df.select(*(F.col(n).cast("double").alias(n) for n in names))
    found = sketches.quantiles(x, names, [k / bins for k in range(1, bins)])
    edges = [np.asarray(found[n]) for n in names]
    nf, nt, cells = len(features), len(targets), bins * bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((nf, nt, cells), np.int64)
        for batch in batches:
            v = _matrix(batch)
            slot = np.stack([np.searchsorted(e, c) for e, c in zip(edges, v.T, strict=True)], 1) if len(v) else np.zeros(v.shape, np.int64)
            there = ~np.isnan(v)
            for t in range(nt):
                for f in range(nf):
                    both = (slot[:, f] * bins + slot[:, nf + t])[there[:, f] & there[:, nf + t]]
                    count[f, t] += np.bincount(both, minlength=cells)
        f, t, cell = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (f, t, cell // bins, cell % bins)] + [pa.array(count[f, t, cell])], names=["f", "t", "x", "y", "n"])

    joint = x.mapInArrow(run, "f int, t int, x int, y int, n long").groupBy("f", "t", "x", "y").agg(F.sum("n").alias("n"))
    w = lambda *k: F.sum("n").over(Window.partitionBy("f", "t", *k))
    terms = joint.select("f", "t", "x", "y", w().alias("all"), (F.col("n") / w() * F.log(F.col("n") * w() / (w("x") * w("y")))).alias("m"))
    chance = (F.count("*") - F.count_distinct("x") - F.count_distinct("y") + 1) / (2 * F.max("all"))
    name = lambda of: F.array(*(F.lit(n) for n in of))
    found = terms.groupBy("f", "t").agg(F.greatest(F.sum("m") - chance, F.lit(0.0)).alias("mi")).select(name(features)[F.col("f")].alias("feature"), name(targets)[F.col("t")].alias("target"), "mi")
    every = df.sparkSession.createDataFrame([(f, t) for f in features for t in targets], "feature string, target string")
    return every.join(found, ["feature", "target"], "left").select("feature", "target", F.coalesce("mi", F.lit(0.0)).alias("mi"))


def rank_scores(scores: DataFrame) -> DataFrame:
    """scores: feature, h, mi. Adds the mean over horizons, the global order (best mean first, then by name) and each horizon's minimum rank."""
    mean = scores.groupBy("feature").agg(F.avg("mi").alias("mean_mi"))
    order = mean.withColumn("position", F.row_number().over(Window.orderBy(F.desc(F.round("mean_mi", 9)), "feature")))
    ranked = scores.withColumn("rank", F.rank().over(Window.partitionBy("h").orderBy(F.desc(F.round("mi", 9)))))
    return ranked.join(order, "feature").select("feature", "h", "mi", "rank", "mean_mi", "position")


def strong_pairs(pearson: DataFrame, spearman: DataFrame, limit: float = 0.95) -> DataFrame:
    """Pairs whose absolute correlation of either kind is above the limit."""
    both = pearson.unionByName(spearman)
    return both.where(F.abs("r") > limit).select("a", "b").distinct()


def greedy_keep(order: Sequence[str], strong: set[tuple[str, str]]) -> list[str]:
    """Walks features best first and drops one that is strongly correlated with a kept one. The edge list has a row for each strong pair of features only."""
    kept: list[str] = []
    for f in order:
        if not any((f, k) in strong or (k, f) in strong for k in kept):
            kept.append(f)
    return kept


def deduplicate(df: DataFrame, order: Sequence[str], limit: float = 0.95) -> DataFrame:
    """(feature, position, kept) for the features in rank order."""
    edges = strong_pairs(correlations(df, order), correlations(df, order, "spearman"), limit)
    kept = set(greedy_keep(order, {(r["a"], r["b"]) for r in edges.collect()}))
    return df.sparkSession.createDataFrame([(f, i + 1, f in kept) for i, f in enumerate(order)], "feature string, position int, kept boolean")


def folds(df: DataFrame, n: int = 3, ts: str = "ts") -> DataFrame:
    """Expanding-window folds: (fold, train rows' end, test begin and end). Rows are times; test parts are the last n of n + 1 equal parts.

    Row positions come from counts by day and a running sum over days, not from one window over all rows.
    """
    per_day = df.groupBy(F.to_date(ts).alias("d")).agg(F.count("*").alias("n"))
    before = per_day.select("d", F.coalesce(F.sum("n").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = per_day.agg(F.sum("n").alias("rows"))
    inside = F.row_number().over(Window.partitionBy(F.to_date(ts)).orderBy(ts)) - 1
    pos = df.withColumn("d", F.to_date(ts)).withColumn("i", inside).join(F.broadcast(before), "d").crossJoin(F.broadcast(total))
    size = F.floor(F.col("rows") / (n + 1))
    start = F.col("rows") - n * size
    fold = F.floor((F.col("before") + F.col("i") - start) / size)
    return pos.withColumn("fold", F.when(F.col("before") + F.col("i") >= start, fold + 1).otherwise(0).cast("int")).drop("d", "i", "before", "rows")


def sample(df: DataFrame, n: int, seed: int, ts: str = "ts") -> DataFrame:
    """n rows without replacement, the same for the same seed whatever the partitions: those with the smallest hashes of time and seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(seed))), ts).limit(n)


def sampled_times(df: DataFrame, n: int, seed: int, ts: str = "ts") -> DataFrame:
    """The rows of n sampled times."""
    return df.join(sample(df.select(ts).distinct(), n, seed, ts), ts, "left_semi")


def top_n(scores: DataFrame, n: int, per: Sequence[str], best: Column) -> DataFrame:
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(best, "feature"))).where(F.col("place") <= n)


def normalised(mi: Column) -> Column:
    return 1 - F.exp(-mi)


def best_count(scores: DataFrame) -> DataFrame:
    """scores: h, n, mae. The n with the smallest error of each horizon; the first of equals."""
    return scores.groupBy("h").agg(F.min_by("n", F.struct("mae", "n")).alias("n"), F.min("mae").alias("mae"))


def selection_period(df: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """Rows of the selection period, both ends included; the filter reaches the scan."""
    return df.where(F.col(ts).between(start, end))


def split_ranks(ranked: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of unique features, rows of duplicates). kept: feature, kept."""
    unique = kept.where("kept").select("feature")
    return ranked.join(unique, "feature", "left_semi"), ranked.join(unique, "feature", "left_anti")


def selected(scores: DataFrame, best: DataFrame) -> DataFrame:
    """(feature, h, place, selected): whether a feature is among the best n of its horizon. scores: feature, h, mi; best: h, n."""
    placed = scores.withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy(F.desc(F.round("mi", 9)), "feature")))
    return placed.join(best.select("h", "n"), "h", "left").select("feature", "h", "place", F.coalesce(F.col("place") <= F.col("n"), F.lit(False)).alias("selected"))


def feature_matrix(selection: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """A row for each feature and a boolean column h<h> for each horizon."""
    return selection.groupBy("feature").agg(*(F.coalesce(F.bool_or(F.when(F.col("h") == h, F.col("selected"))), F.lit(False)).alias(f"h{h}") for h in horizons))


def top_matrix(scores: DataFrame, n: int) -> DataFrame:
    """A row for each horizon with the n best features and their normalised scores: label_<place>, value_<place>. scores: feature, h, mi."""
    top = top_n(scores, n, ["h"], F.desc(F.round("mi", 9)))
    pick = lambda c, k: F.max(F.when(F.col("place") == k, c))
    made = [x for k in range(1, n + 1) for x in (pick(F.col("feature"), k).alias(f"label_{k}"), pick(normalised(F.col("mi")), k).alias(f"value_{k}"))]
    return top.groupBy("h").agg(*made)
