"""Quality: logistic regression over hashed word n-grams, learned by follow-the-regularised-leader updates.

Features. A text's tokens are its runs of letters and digits and its runs of other characters, as they stand (case and marks tell
much about quality). Single tokens and pairs of neighbours fall into `2**BITS` buckets by their hash; a bucket's value is
1 + log(occurrences), and all values of a text are divided by their Euclidean length. A score is the logistic function of the
sparse dot product with the weights, and of a bias.

Learning. At most about `rows_per_label` labelled rows of either label are sampled by a hash of doc_id, weighted back to the shares that
the labels have. They are dealt to `LEARNERS` learners by another hash and sorted, so that the result doesn't depend on how the
input is partitioned. In each of `ROUNDS` rounds every learner makes one pass of FTRL-proximal updates, a row at a time as the rows stream in; then Spark
averages the learners' weights and gradient sums, chunk by chunk, and the next round starts from them. The driver holds one weight for each bucket.

Scoring reads every whole text in one pass without a shuffle.

Defined cases: null and empty texts have no features and get the score of the bias; without labels every score is 0.5, with one label
the share of label 1; a doc_id with several labels counts once, by the larger one; labels other than 0 and 1 are left out; repeated rows
are scored alike; a null doc_id is held out; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm import scratch
from gridcast.llm import text as tx

BITS = 18
SAMPLE_ROWS = 10_000
LEARNERS, ROUNDS = 4, 4
CHUNKS = 64
#: Of the FTRL updates: learning rate, its offset, and the penalties on absolute and squared weights.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.05

# 0 between tokens, 1 in words, 2 in runs of marks
_KIND = np.full(256, 2, np.uint8)
_KIND[tx.ALNUM] = 1
_KIND[65:91] = 1
_KIND[~tx.SPACED] = 0


def tokens(data: np.ndarray, at: np.ndarray) -> tx.Words:
    """Tokens of the documents that lie at `at` in `data`."""
    kind = np.zeros(len(data) + 2, np.uint8)
    kind[1:-1] = _KIND[data]
    edge = kind[1:] != kind[:-1]  # between a byte and the one before it
    edge[at] = True
    begin = np.flatnonzero(edge[:-1] & (kind[1:-1] > 0))
    end = np.flatnonzero(edge[1:] & (kind[1:-1] > 0)) + 1
    return tx.Words(data, begin, end, np.searchsorted(begin, at))


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, first feature of each document and the end, buckets, values) for run after run of documents."""
    data, at = tx.buffer(texts)
    for i, j in tx.ranges(at):
        w = tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
        h, doc = w.hashes(), w.doc()
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        bucket = np.concatenate((tx.mix(h, 11), tx.Rolling(h).of(pair, 2, 12))) >> tx.U(64 - BITS)
        key, count = np.unique((np.concatenate((doc, doc[pair])) << BITS) | bucket.astype(np.int64), return_counts=True)
        doc, value = key >> BITS, 1 + np.log(count)
        norm = np.sqrt(np.bincount(doc, value * value, j - i))
        yield i, j, np.searchsorted(doc, np.arange(j - i + 1)), (key & ((1 << BITS) - 1)).astype(np.int32), (value / norm[doc]).astype(np.float32)


def logistic(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Leader:
    """FTRL-proximal state: for each bucket, and last the bias, the shifted sum of gradients and the sum of their squares."""

    def __init__(self, weights: np.ndarray, squares: np.ndarray):
        self.n = squares.astype(np.float64)
        # the sum that has these weights as its minimiser
        self.z = -weights * ((BETA + np.sqrt(self.n)) / ALPHA + L2) - np.sign(weights) * self._free(np.full(len(weights), L1))

    @staticmethod
    def _free(penalty: np.ndarray) -> np.ndarray:
        """The bias has no penalty on its absolute value."""
        penalty[-1] = 0.0
        return penalty

    def weights(self, at: np.ndarray | slice = slice(None), l1: np.ndarray | float | None = None) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = self._free(np.full(len(z), L1)) if l1 is None else l1
        return -(z - np.clip(z, -l1, l1)) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, bucket: np.ndarray, value: np.ndarray, label: int, weight: float) -> None:
        """One row; the bias is a feature of every row."""
        at, x = np.append(bucket, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        g = (logistic(float(w @ x)) - label) * weight * x
        n = self.n[at]
        self.n[at] = n + g * g
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w


@dataclass
class Model:
    weights: np.ndarray  # by bucket
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for i, j, first, bucket, value in features(texts):
            doc = np.repeat(np.arange(j - i), np.diff(first))
            out.append(logistic(np.bincount(doc, self.weights[bucket] * value, j - i) + self.bias))
        return np.concatenate(out)


def fold(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sampled rows with their features as bytes; the text is left behind."""
    for batch in batches:
        for i, j, first, bucket, value in features(batch.column(3)):
            cut = list(zip(first[:-1], first[1:], strict=True))
            columns = [c.slice(i, j - i) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([bucket[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([value[a:b].tobytes() for a, b in cut], pa.binary())], names=["learner", "place", "label", "buckets", "values"])


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = SAMPLE_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, quality."""
    spark, size = docs.sparkSession, (1 << BITS) + 1
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    have = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(have) < 2:
        return Model(np.zeros(size - 1, np.float32), 35.0 if 1 in have else -35.0 if 0 in have else 0.0)
    least = {k: min(1 << 20, int(rows_per_label / n * (1 << 20)) + 1) for k, n in have.items()}
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.when(F.col("label") == 1, least[1]).otherwise(least[0]))
    # at most about 2 * rows_per_label rows of two numbers are broadcast
    mine = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    mine = mine.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(LEARNERS)).cast("int").alias("learner"), F.xxhash64("doc_id", "text", F.lit(2)).alias("place"), "label", "text")
    dealt = mine.mapInArrow(_rows, "learner int, place long, label int, buckets binary, values binary").repartition(LEARNERS, "learner").sortWithinPartitions("learner", "place", "label")
    dealt = scratch.keep(dealt, "features")
    seen = {r["label"]: r["n"] for r in dealt.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return Model(np.zeros(size - 1, np.float32), 35.0 if 1 in seen else -35.0 if 0 in seen else 0.0)
    # rows stand for those of their label that weren't sampled; the mean weight is 1
    weight = {k: have[k] / seen[k] * sum(seen.values()) / sum(have.values()) for k in seen}
    state = np.zeros(size), np.zeros(size)
    for _ in range(ROUNDS):
        shipped = spark.sparkContext.broadcast(state)

        def learn(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            """The learners' states after a pass over their rows, which arrive learner by learner."""
            own, learner, n = None, None, 0
            for batch in batches:
                for who, label, b, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                    if who != learner:
                        yield from _chunks(own, n)
                        own, learner, n = Leader(*shipped.value), who, 0
                    own.learn(np.frombuffer(b.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32), label, weight[label])
                    n += 1
            yield from _chunks(own, n)

        # each learner's rows are dealt to one task and sorted again; what is kept lies so already, but its files may be split
        rows = dealt.repartition(LEARNERS, "learner").sortWithinPartitions("learner", "place", "label")
        mixed = rows.mapInArrow(learn, "chunk int, rows long, weights binary, squares binary").groupBy("chunk").applyInArrow(_mixed, "chunk int, weights binary, squares binary")
        got = sorted(mixed.collect(), key=lambda r: r["chunk"])
        state = tuple(np.concatenate([np.frombuffer(r[k]) for r in got]) for k in ("weights", "squares"))
        shipped.destroy()
    return Model(state[0][:-1].astype(np.float32), float(state[0][-1]))


def _chunks(own: Leader | None, rows: int) -> Iterator[pa.RecordBatch]:
    if own is None:
        return
    parts = zip(np.array_split(own.weights(), CHUNKS), np.array_split(own.n, CHUNKS), strict=True)
    w, n = zip(*((a.tobytes(), b.tobytes()) for a, b in parts), strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([rows] * CHUNKS), pa.array(w, pa.binary()), pa.array(n, pa.binary())], names=["chunk", "rows", "weights", "squares"])


def _mixed(group: pa.Table) -> pa.Table:
    """One chunk of all learners' states, each weighted by its rows and added up in a fixed order."""
    rows = sorted(zip(group["rows"].to_pylist(), group["weights"].to_pylist(), group["squares"].to_pylist(), strict=True))
    total = sum(r[0] for r in rows)
    mean = lambda k: sum(np.frombuffer(r[k]) * (r[0] / total) for r in rows).tobytes()
    return pa.table({"chunk": group["chunk"][:1], "weights": pa.array([mean(1)], pa.binary()), "squares": pa.array([mean(2)], pa.binary())})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) for every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shipped.value.scores(batch.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents")
    model = fit(docs, scratch.table(spark, sf_dir, "labels").where(fold(3) != 1))
    return score(docs, model).select("doc_id", F.coalesce(fold(3) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
