"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit tells, from byte trigrams, on which side of the bit a text
lies, and loss-weighted decoding takes the language whose codeword costs least. A text whose second-best codeword is
nearly as near is flagged ambiguous.

A classifier's weight for a trigram is the log ratio of its smoothed frequency in the languages of either side; its
margin is a logistic function of the text's mean weight. Both are fitted on a bounded sample: at most about
`rows_per_language` labelled rows of each language, taken by a hash of doc_id (no more than there are). Prediction reads
every whole text in one pass without a shuffle.

Defined cases: a null text, or one without any letter (Unicode L), gets `und` with score 0; null languages aren't
learned; with one language every text with letters gets it; with none every text gets `und`; repeated rows and ties
(lower language name first) are predicted alike; a null doc_id counts as held out; further columns are left out by
`predict` and kept by `accept`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm import text as tx

BUCKETS = 1 << 15
SAMPLE_PARTS = 8
PREDICTED = "doc_id long, lang_pred string, score double, ambiguous boolean"


def codewords(n: int, most_bits: int = 31) -> np.ndarray:
    """n rows of -1 and 1: all two-sided splits for up to six languages, else well separated random ones of a fixed seed."""
    if n <= 6:
        columns = [c for c in itertools.product((-1, 1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns or [[1]] * (n > 0), np.int8).reshape(-1, max(n, 1)).T[:n]
    rng, best, apart = np.random.default_rng(8), None, -1
    bits = min(255, max(most_bits, int(np.ceil(10 * np.log2(n)))))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        near = min(int((code[i] != code[i + 1 :]).sum(1).min()) for i in range(n - 1))
        if near > apart and (np.abs(code.sum(0)) < n).all():
            best, apart = code, near
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # bucket x bit
    slope: np.ndarray
    bias: np.ndarray


def trigrams(data: np.ndarray) -> np.ndarray:
    """A bucket for each byte and the two after it, letters lower-cased."""
    x = tx.LOWER[data].astype(np.uint32)
    h = np.zeros(len(x), np.uint32)
    if len(x) >= 3:
        h[:-2] = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(17)
    return h.astype(np.int64)


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which positions begin a trigram of one document, and how many each document has."""
    keep = np.ones(at[-1], bool)
    for back in (1, 2):
        edge = at[1:] - back
        keep[edge[edge >= at[:-1]]] = False
    return keep, np.maximum(np.diff(at) - 2, 0)


def means(data: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each document and bit, the mean weight of the document's trigrams."""
    keep, n = runs(at)
    out = np.zeros((len(n), weights.shape[1]), np.float64)
    got = weights[trigrams(data)[keep]]
    full = np.flatnonzero(n)
    if len(full):
        begin = (np.cumsum(n) - n)[full]
        out[full] = np.add.reduceat(got, begin, axis=0) / n[full, None]
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language, one row for each language of a partition. Texts of one language count by their shares, so none outweighs the rest."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, at = tx.buffer(batch.column(1))
        for i, lang in enumerate(langs):
            own = data[at[i] : at[i + 1]]
            if len(own) >= 3:
                total.setdefault(lang, np.zeros(BUCKETS)).__iadd__(np.bincount(trigrams(own)[:-2], minlength=BUCKETS))
    names = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[x].tobytes() for x in names], pa.binary())], names=["lang", "counts"])


def fit(labelled: DataFrame, rows_per_language: int = 2000) -> Model:
    """labelled: doc_id, text, lang. The driver gets one count table per language and sample part, and a margin per sampled row and bit."""
    rows = labelled.where("lang is not null").select("doc_id", "lang", "text")
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(size)
    if not languages:
        return Model([], np.zeros((0, 1), np.int8), np.zeros((BUCKETS, 1), np.float32), np.ones(1), np.zeros(1))
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1 << 20, int(rows_per_language / n * (1 << 20)) + 1))) for k, n in size.items()))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")]).select("lang", "text").repartition(SAMPLE_PARTS)
    sums = {k: np.full(BUCKETS, 0.05) for k in languages}
    for r in sample.mapInArrow(_counts, "lang string, counts binary").toLocalIterator():
        sums[r["lang"]] += np.frombuffer(r["counts"])
    p = np.stack([sums[k] / sums[k].sum() for k in languages])
    code = codewords(len(languages))
    side = lambda s: np.stack([np.log(p[code[:, b] == s].mean(0)) if (code[:, b] == s).any() else np.zeros(BUCKETS) for b in range(code.shape[1])], 1)
    weights = (side(1) - side(-1)).astype(np.float32)

    def margins(batches):
        for batch in batches:
            data, at = tx.buffer(batch.column(1))
            out = [means(data[at[i] : at[j]], at[i : j + 1] - at[i], weights) for i, j in tx.ranges(at, tx.CHUNK_BYTES // 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.concatenate(out)] if out else [], pa.binary())], names=["lang", "means"])

    got = sample.mapInArrow(margins, "lang string, means binary").collect()
    x = np.stack([np.frombuffer(r["means"]) for r in got]) if got else np.zeros((0, code.shape[1]))
    y = np.stack([code[languages.index(r["lang"])] for r in got]) if got else np.zeros((0, code.shape[1]))
    slope, bias = np.ones(code.shape[1]), np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        if len(x) and x[:, b].std() > 0:
            slope[b], bias[b] = _logistic(x[:, b], y[:, b] > 0)
    return Model(languages, code, weights, slope, bias)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[float, float]:
    """Slope and bias of a logistic function in one variable; each side weighs the same, and a small penalty keeps the slope finite."""
    scale = x.std()
    z, a, b = x / scale, 1.0, 0.0
    weight = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = (p - y) * weight
        a -= 2.0 * (g @ z + 0.002 * a)
        b -= 2.0 * g.sum()
    return a / scale, b


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codeword, score, ambiguous) by the mean logistic loss of each codeword's bits."""
    loss = np.log1p(np.exp(-np.clip(margins[:, None, :] * code[None], -40, 40))).mean(2)
    best = loss.argmin(1)
    share = np.exp(-(loss - loss.min(1, keepdims=True)) * code.shape[1])
    score = share.max(1) / share.sum(1)
    second = np.sort(loss, 1)[:, 1] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    return best, score, second - loss.min(1) < 0.05


def lettered(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII letter are looked at by character."""
    data, at = tx.buffer(texts)
    ascii_letter = np.concatenate(([0], np.cumsum(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A))))
    has = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
    for i in np.flatnonzero(~has):
        has[i] = any(map(str.isalpha, data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")))
    return has


class Reader:
    """Predictions for the texts of Arrow columns."""

    def __init__(self, model: Model):
        self.model = model

    def read(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of each text."""
        model, data, at = self.model, *tx.buffer(texts)
        lang, score, unsure = [], [np.zeros(0)], [np.zeros(0, bool)]
        for i, j in tx.ranges(at, tx.CHUNK_BYTES // 4):
            if not model.languages:
                lang += ["und"] * (j - i)
                score.append(np.zeros(j - i))
                unsure.append(np.ones(j - i, bool))
                continue
            has = lettered(texts.slice(i, j - i))
            x = means(data[at[i] : at[j]], at[i : j + 1] - at[i], model.weights)
            best, s, near = decode(x * model.slope + model.bias, model.code)
            lang += [model.languages[b] if h else "und" for b, h in zip(best, has, strict=True)]
            score.append(np.where(has, s, 0.0))
            unsure.append(near | ~has)
        return lang, np.concatenate(score), np.concatenate(unsure)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            lang, score, unsure = reader.read(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PREDICTED)


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose predicted language isn't `und`, all columns as they are, except that a null lang becomes the predicted one.

    Every row is predicted, those with a lang too. Where there was no language to learn, documents with a letter are accepted.
    """
    names = docs.columns
    at, lang = names.index("text"), names.index("lang") if "lang" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for whole in batches:
            for i, j in tx.ranges(tx.buffer(whole.column(at))[1], tx.CHUNK_BYTES):
                batch = whole.slice(i, j - i)
                columns = list(batch.columns)
                if model.languages:
                    found = pa.array(reader.read(batch.column(at))[0], pa.string())
                    good = pc.not_equal(found, "und")
                    if lang is not None:
                        columns[lang] = pc.coalesce(columns[lang], found)
                else:
                    good = pa.array(lettered(batch.column(at)))
                yield pa.RecordBatch.from_arrays([c.filter(good) for c in columns], names=names)

    return docs.mapInArrow(run, docs.schema)


def fold(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def learned(docs: DataFrame) -> Model:
    return fit(docs.where(fold(3) != 1).select("doc_id", "text", "lang"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learned(docs)).withColumn("held_out", F.coalesce(fold(3) == 1, F.lit(True))).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
