"""Language-model scores of whole documents: a gated recurrent network with a class-factored output softmax.

Counts. Every word of all training documents is counted (by a 64-bit hash; a hash aggregation with one row for each
word, task and batch), so what the model gathers grows with the corpus. The most frequent `OUTPUTS` tokens are outputs of the
network, in classes of about equal size; all other words fall into `KINDS` kinds by their last two letters, which tell languages and
word forms apart. A kind is an output too, and within it a word has its share (c + 0.1) of the counts, an unseen one the share
0.1. So the model is a distribution over the words counted and one unseen word of each kind.

Network. A GRU over token embeddings, trained in numpy by truncated backpropagation through time; output biases start at the
unigram model. It starts on the driver from a bounded sample (about `SAMPLE_ROWS` training documents in the order of a hash of
doc_id, at most `SAMPLE_TOKENS` tokens of them; longer texts are passed over) and then learns from all training documents in
`len(RATES)` rounds: each round takes the documents of one hash class, deals them to learners by a hash of doc_id, and averages the learners' weights
by their tokens. What a learner sees, and in which order, depends on the documents only, so a score doesn't depend on how the input is partitioned (but for single-precision
rounding in batches of other documents). Scoring runs documents of similar length in lock-step, about `WINDOW` tokens at a time, and carries the state
from window to window, so the likelihood is that of the complete text. Arrays lie by feature, a token a column, so that gates and softmaxes run
along whole rows, and tokens are sorted by class for the output layer.

Lookup. The words with the highest counts (all words of a count or above, at most `FREQUENT` of them) are shipped to the
tasks; only the rest of a document's words meets the count table in a join, and their logarithms are summed for each row.

Defined cases: a null text is empty and has the end token only; without training documents every probability is that of
the unseen word; repeated rows are scored each; a null doc_id is held out; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm import scratch
from gridcast.llm import text as tx

OUTPUTS, KINDS, CLASS_SIZE = 896, 128, 32
EMBEDDED, HIDDEN = 16, 24
FREQUENT = 200_000
SAMPLE_ROWS, SAMPLE_TOKENS = 1200, 500_000
STEPS, TOGETHER, WINDOW = 32, 1024, 8000
STREAMS, RATES = 512, (0.002, 0.001)
#: Tokens of a learner and of a portion that it learns from at once, and pieces in which weights are averaged.
SHARE, PORTION, PIECES = 2_000_000, 250_000, 16
SLICE_BYTES = 12 << 20
END = tx.U(0x1B873593CC9E2D51)  # stands for the end token among the hashes of words
LOG10 = np.log(10.0)


def fold(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def endings(w: tx.Words) -> np.ndarray:
    """The kind of each word: a hash of its last two letters, one mark at the end left out; digits count as one letter."""
    data = np.concatenate((np.zeros(2, np.uint8), w.data)).astype(np.uint32)
    data[(data >= 0x30) & (data <= 0x39)] = 0x30
    letter = (data >= 0x61) | (data == 0x30)
    end = w.end + 1  # places in data, two bytes further; the last letter
    end = end - (~letter[end] & (w.end - w.begin > 1))
    last, before = data[end], np.where(end > w.begin + 2, data[end - 1], 0)
    return ((last * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA77)) >> np.uint32(25)).astype(np.int64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and kinds of all tokens, each text's words and then its end, and where each text begins."""
    parts, kinds, counts = [], [], []
    for _, _, w in tx.words(texts):
        n = w.counts
        out, kind = np.full(len(w.begin) + len(n), END, tx.U), np.zeros(len(w.begin) + len(n), np.int64)
        at = np.arange(len(w.begin)) + w.doc()
        out[at], kind[at] = w.hashes(), endings(w)
        parts.append(out)
        kinds.append(kind)
        counts.append(n + 1)
    if not parts:
        return np.zeros(0, tx.U), np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate(kinds), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


class Lookup:
    """Places of hashes in a sorted array without repetitions. Hashes are spread evenly, so their upper bits tell nearly where to look."""

    def __init__(self, known: np.ndarray, bits: int = 18):
        self.shift, self.known = tx.U(64 - bits), np.append(known, tx.U(2**64 - 1))
        self.start = np.searchsorted(known, np.arange(1 << bits, dtype=tx.U) << self.shift)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """The number of known hashes stands for one that isn't known."""
        at = self.start[(ids >> self.shift).view(np.int64)]
        rest = np.flatnonzero(self.known[at] < ids)
        while len(rest):
            at[rest] += 1
            rest = rest[self.known[at[rest]] < ids[rest]]
        return np.where(self.known[at] == ids, at, len(self.known) - 1)


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most `SLICE_BYTES` of text (or of one row): a token takes some sixty bytes while it is worked on."""
    for batch in batches:
        for i, j in tx.ranges(tx.buffer(batch.column(text))[1], SLICE_BYTES):
            yield batch.slice(i, j - i)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, 0):
        ids, kinds, _ = tokens(batch.column(0))
        word, n = np.unique(ids, return_counts=True)
        kind = np.zeros(len(word), np.int16)
        kind[Lookup(word)(ids)] = kinds
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(kind), pa.array(n)], names=["word", "kind", "c"])


@dataclass
class Network:
    """Arrays of the network and the vocabulary that goes with it."""

    known: np.ndarray  # sorted hashes of the frequent words
    counts: np.ndarray
    output: np.ndarray  # for each frequent word its output, or that of its kind
    classes: int
    p: dict[str, np.ndarray]
    total: int
    distinct: int
    rare: np.ndarray  # for each kind the sum of (c + 0.1) over its words that aren't outputs, and 0.1; one kind without training documents
    learnt: int = 0  # tokens that the network learnt from in tasks

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def start(n_outputs: int, frequency: np.ndarray, rng: np.random.Generator) -> tuple[int, dict[str, np.ndarray]]:
    """Small random weights; output biases are those of the unigram model. Outputs fill classes in order; slots without output are closed."""
    classes = -(-n_outputs // CLASS_SIZE)
    logs = np.full(classes * CLASS_SIZE, -30.0)
    logs[:n_outputs] = np.log(frequency / frequency.sum())
    logs = logs.reshape(classes, CLASS_SIZE)
    whole = np.log(np.exp(logs).sum(1))
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    p = {"e": small(n_outputs + 1, EMBEDDED), "wx": small(EMBEDDED, 3 * HIDDEN), "wh": small(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32)}
    p |= {"c": small(HIDDEN, classes), "cb": whole.astype(np.float32), "o": small(classes, HIDDEN, CLASS_SIZE), "ob": (logs - whole[:, None]).astype(np.float32)}
    return classes, p


def _step(px: np.ndarray, h: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next states, and what the backward pass needs. One row for each document, but the arrays lie by feature (as transposed views): so each operation runs over all documents at once."""
    px, h = px.T, h.T
    ph = wh.T @ h
    gates = px[: 2 * HIDDEN] + ph[: 2 * HIDDEN]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)  # may be infinite: the gate is 0 then
    gates += 1
    np.reciprocal(gates, out=gates)
    z, r = gates[:HIDDEN], gates[HIDDEN:]
    new = r * ph[2 * HIDDEN :]
    new += px[2 * HIDDEN :]
    np.tanh(new, out=new)
    out = h - new
    out *= z
    out += new
    return out.T, z.T, r.T, new.T, ph.T


def _inputs(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings of tokens by feature with a last row of ones, and the matrix that turns them into what gates and candidate get."""
    ex = np.ones((EMBEDDED + 1, len(x)), np.float32)
    np.take(np.ascontiguousarray(p["e"].T), x, axis=1, out=ex[:EMBEDDED], mode="clip")
    return ex, np.vstack((p["wx"], p["b"])).T


def _logits(p: dict[str, np.ndarray], hs: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logits of the classes and of the outputs in the target's class, by feature; tokens are sorted by class.

    Also their order, states with a last row of ones, classes, places in the class and where each class begins.
    """
    cls = (target // CLASS_SIZE).astype(np.uint16)  # two bytes: sorted by radix
    order = np.argsort(cls, kind="stable")
    cls, unit, m = cls[order], (target % CLASS_SIZE)[order], len(target)
    at = np.searchsorted(cls, np.arange(len(p["cb"]) + 1)).tolist()
    h1 = np.ones((HIDDEN + 1, m), np.float32)
    np.take(hs.T, order, axis=1, out=h1[:HIDDEN], mode="clip")
    inner = np.empty((CLASS_SIZE, m), np.float32)
    o1 = np.concatenate((p["o"], p["ob"][:, None]), 1)
    for k, (i, j) in enumerate(pairwise(at)):
        if j > i:
            np.matmul(o1[k].T, h1[:, i:j], out=inner[:, i:j])
    return np.vstack((p["c"], p["cb"])).T @ h1, inner, order, h1, cls, unit, at


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place, down the columns."""
    np.subtract(x, x.max(0), out=x)
    np.exp(x, out=x)
    return np.divide(x, x.sum(0), out=x)


def train(streams: np.ndarray, n_outputs: int, frequency: np.ndarray, end: int, epochs: int = 3, rate: float = 0.01) -> tuple[int, dict[str, np.ndarray]]:
    """streams: outputs, one row for each parallel stream of documents. The state is cleared after each end token."""
    classes, p = start(n_outputs, frequency, np.random.default_rng(4))
    own, windows = Learner(p, n_outputs, end), -(-streams.shape[1] // (STEPS // 2))
    for epoch in range(epochs):
        own.run(streams, np.ones(streams.shape, bool), lambda k: rate * (1 - 0.9 * (epoch * windows + k) / (epochs * windows)))  # noqa: B023
    return classes, own.p


class Learner:
    """Weights under training with the Adam moments of their gradients."""

    def __init__(self, p: dict[str, np.ndarray], begin: int, end: int):
        self.p, self.begin, self.end, self.steps = dict(p), begin, end, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    @np.errstate(over="ignore")
    def run(self, streams: np.ndarray, live: np.ndarray, rate) -> None:
        """One pass; entries that aren't live are padding. rate(k): that of the k-th window."""
        h = np.zeros((len(streams), HIDDEN), np.float32)
        before = np.full(len(streams), self.begin)
        for k, a in enumerate(range(0, streams.shape[1], STEPS // 2)):
            h, before = self._window(h, before, streams[:, a : a + STEPS // 2], live[:, a : a + STEPS // 2], rate(k))

    def _window(self, h: np.ndarray, before: np.ndarray, y: np.ndarray, live: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        p, begin, n = self.p, self.begin, len(y)
        x = np.concatenate((before[:, None], y[:, :-1]), 1).T
        x = np.where(x == self.end, begin, x)
        on = (x != begin).astype(np.float32)
        ex, wx = _inputs(p, x.ravel())
        h, kept, hs = h.T, [], np.empty((HIDDEN, x.size), np.float32)
        for t in range(len(x)):
            h = h * on[t]
            new, *rest = _step((wx @ ex[:, t * n : t * n + n]).T, h.T, p["wh"])
            kept.append((h, *(a.T for a in rest)))
            h = hs[:, t * n : t * n + n] = new.T
        dh, grad = self._output(hs, y.T.ravel(), live.T.ravel())
        carry, inner, dph = np.zeros((HIDDEN, n), np.float32), np.empty((3 * HIDDEN, n), np.float32), np.empty((3 * HIDDEN, n), np.float32)
        dn, (dz, dr, dnr) = inner[2 * HIDDEN :], np.split(dph, 3)
        dex, dwx, grad["wh"] = np.empty((EMBEDDED, x.size), np.float32), np.zeros((EMBEDDED + 1, 3 * HIDDEN), np.float32), np.zeros_like(p["wh"])
        for t in range(len(x) - 1, -1, -1):
            (h0, z, r, new, ph), at = kept[t], slice(t * n, t * n + n)
            d, less = carry, 1 - z
            d += dh[:, at]
            np.multiply(d, less, out=dn)
            np.subtract(h0, new, out=dz)
            dz *= dn
            dz *= z
            dn *= 1 - new * new
            np.multiply(dn, r, out=dnr)
            np.multiply(dnr, ph[2 * HIDDEN :], out=dr)
            dr *= 1 - r
            inner[: 2 * HIDDEN] = dph[: 2 * HIDDEN]
            d *= z
            carry = p["wh"] @ dph
            carry += d
            carry *= on[t]
            grad["wh"] += (dph @ h0.T).T
            dwx += (inner @ ex[:, at].T).T
            dex[:, at] = p["wx"] @ inner
        grad["wx"], grad["b"] = dwx[:-1], dwx[-1]
        met = x.ravel().astype(np.uint16) if begin < 1 << 16 else x.ravel()
        order = np.argsort(met, kind="stable")
        keys, at = np.unique(met[order], return_index=True)
        grad["e"] = np.zeros_like(p["e"])
        grad["e"][keys] = np.add.reduceat(np.take(dex, order, axis=1), at, axis=1).T
        self._descend(grad, max(1, int(live.sum())), rate)
        return h.T, y[:, -1]

    def _output(self, hs: np.ndarray, target: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients of the states (by feature) and of the weights of the output layer."""
        p = self.p
        dc, d, order, h1, cls, unit, at = _logits(p, hs.T, target)
        m, padding = np.arange(len(target)), np.flatnonzero(~live[order])
        for x, chosen in ((_softmax(dc), cls), (_softmax(d), unit)):
            x[chosen, m] -= 1
            x[:, padding] = 0
        both, dh = h1 @ dc.T, p["c"] @ dc
        grad = {"c": both[:-1], "cb": both[-1], "o": np.zeros_like(p["o"]), "ob": np.zeros_like(p["ob"])}
        inner = np.empty_like(dh)
        for k, (i, j) in enumerate(pairwise(at)):
            if j > i:
                both = h1[:, i:j] @ d[:, i:j].T
                grad["o"][k], grad["ob"][k] = both[:-1], both[-1]
                np.matmul(p["o"][k], d[:, i:j], out=inner[:, i:j])
        dh += inner
        place = np.empty_like(order)
        place[order] = m
        return np.take(dh, place, axis=1), grad

    def _descend(self, grad: dict[str, np.ndarray], m: int, rate: float) -> None:
        self.steps += 1
        rate *= float(np.sqrt(1 - 0.999**self.steps)) / (1 - 0.9**self.steps)
        scale = 1 / m
        norm = float(np.sqrt(sum(float((g * scale).ravel() @ (g * scale).ravel()) for g in grad.values())))
        scale *= min(1.0, 1.0 / (norm + 1e-9))
        for k, p in self.p.items():
            g = grad[k] * scale
            first, second = self.first[k], self.second[k]
            first *= 0.9
            first += 0.1 * g
            second *= 0.999
            g *= g
            second += 0.001 * g
            np.sqrt(second, out=g)
            g += 1e-8
            np.divide(first, g, out=g)
            g *= rate
            self.p[k] = p - g


def _streams(flat: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens as parallel streams, filled up at the end, and which entries are tokens."""
    n = max(1, min(most, len(flat) // 64))
    length = -(-len(flat) // n)
    out, live = np.zeros(n * length, np.int64), np.arange(n * length) < len(flat)
    out[: len(flat)] = flat
    return out.reshape(n, length), live.reshape(n, length)


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(learner, hashes, kinds) of about `PORTION` tokens at a time; rows come sorted by learner. Portions depend on a learner's own texts only, not on how rows are batched."""
    learner, parts, size = None, [], 0
    for batch in _slices(batches, 2):
        ids, kinds, first = tokens(batch.column(2))
        for who, x, y in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            if (who != learner and parts) or size >= PORTION:
                yield learner, *(np.concatenate(x) for x in zip(*parts, strict=True))
                parts, size = [], 0
            learner = who
            parts.append((ids[x:y], kinds[x:y]))
            size += y - x
    if parts:
        yield learner, *(np.concatenate(x) for x in zip(*parts, strict=True))


def _mean(group: pa.Table) -> pa.Table:
    """The mean of a piece of the weights, by tokens, in a fixed order."""
    rows = sorted(zip(group["learner"].to_pylist(), group["n"].to_pylist(), group["weights"].to_pylist(), strict=True))
    n = sum(r[1] for r in rows)
    whole = sum(np.frombuffer(r[2]) * (r[1] / n) for r in rows)
    return pa.table([group["piece"][:1], pa.array([rows[0][0]], pa.int64()), pa.array([n], pa.int64()), pa.array([whole.tobytes()], pa.binary())], names=["piece", "learner", "n", "weights"])


PIECED = "piece int, learner long, n long, weights binary"


def rounds(docs: DataFrame, p: dict[str, np.ndarray], known: np.ndarray, unit: np.ndarray, n_outputs: int, end: int, total: int) -> tuple[dict[str, np.ndarray], int]:
    """The weights after learning from every document once, and the tokens that they learnt from. total: tokens of all documents.

    Documents are dealt to learners by a hash of doc_id, so many that each has about `SHARE` tokens, and are sorted within. Spark averages the weights piece by piece, in groups of learners first.
    """
    spark, learnt = docs.sparkSession, 0
    learners = max(4, -(-total // len(RATES) // SHARE))
    cut = np.cumsum([v.size for v in p.values()])[:-1]
    for i, rate in enumerate(RATES):
        shipped = spark.sparkContext.broadcast((p, known, unit))

        def learn(batches: Iterator[pa.RecordBatch], shipped=shipped, rate=rate) -> Iterator[pa.RecordBatch]:
            p, known, unit = shipped.value
            own, now, n, find = None, None, 0, Lookup(known)

            def told() -> Iterator[pa.RecordBatch]:
                if own is not None and n:
                    flat = np.concatenate([own.p[k].ravel() for k in p]).astype(float)
                    pieces = [x.tobytes() for x in np.array_split(flat, PIECES)]
                    yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([now] * PIECES, pa.int64()), pa.array([n] * PIECES, pa.int64()), pa.array(pieces, pa.binary())], names=["piece", "learner", "n", "weights"])

            for learner, ids, kinds in _learnt(batches):
                if learner != now:
                    yield from told()
                    own, now, n = Learner(p, n_outputs, end), learner, 0
                flat = _units(ids, kinds, find, unit, n_outputs)
                own.run(*_streams(flat, STREAMS), lambda k: rate)
                n += len(flat)
            yield from told()

        hashed = F.xxhash64("doc_id", F.lit(i))
        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(len(RATES))) == i).select(F.pmod(hashed, F.lit(learners)).alias("learner"), F.xxhash64("doc_id", "text", F.lit(7)).alias("place"), F.col("text").cast("string").alias("text"))
        dealt = part.repartition("learner").sortWithinPartitions("learner", "place", "text")
        grouped = dealt.mapInArrow(learn, PIECED).groupBy("piece", F.floor(F.col("learner") / 1024)).applyInArrow(_mean, PIECED)
        rows = sorted(grouped.groupBy("piece").applyInArrow(_mean, PIECED).collect(), key=lambda r: r["piece"])
        shipped.destroy()
        if rows:
            flat = np.concatenate([np.frombuffer(r["weights"]) for r in rows])
            p = {k: x.reshape(v.shape).astype(np.float32) for (k, v), x in zip(p.items(), np.split(flat, cut), strict=True)}
            learnt += rows[0]["n"]
    return p, learnt


def fit(docs: DataFrame, frequent: int = FREQUENT) -> tuple[Network, DataFrame]:
    """docs: doc_id, text of the training documents. Returns the network and the table of all counts (word, c)."""
    counts = docs.select(F.col("text").cast("string")).mapInArrow(_count, "word long, kind short, c long").groupBy("word").agg(F.max("kind").alias("kind"), F.sum("c").alias("c"))
    counts = scratch.keep(counts, "counts")
    whole = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    total, distinct = (sum(x[i] for x in whole.values()) for i in (0, 1))
    least, above = None, 0
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        if above + r["n"] > frequent:
            break
        above, least = above + r["n"], r["c"]
    top = counts.where(F.col("c") >= least).toPandas() if least is not None else None
    word = top["word"].to_numpy().view(tx.U) if top is not None else np.zeros(0, tx.U)
    c, kind = (top[x].to_numpy().astype(np.int64) if top is not None else np.zeros(0, np.int64) for x in ("c", "kind"))
    order = np.lexsort((word, -c))
    outputs = order[:OUTPUTS]
    if len(word) and END not in word[outputs]:
        outputs = np.append(outputs[: OUTPUTS - 1], np.flatnonzero(word == END))
    rare = np.full(KINDS if total else 1, 0.1)
    for k, (n, v) in whole.items():
        rare[k] += n + 0.1 * v
    rare = np.maximum(rare - np.bincount(kind[outputs], c[outputs] + 0.1, len(rare)), 0.1)
    unit = len(outputs) + kind
    unit[outputs] = np.arange(len(outputs))
    by = np.argsort(word)
    frequency = np.concatenate((c[outputs] + 0.1, rare))
    known, c, unit = word[by], c[by], unit[by]
    n_outputs, find = len(frequency), Lookup(known)

    share = min(1 << 20, int(SAMPLE_ROWS / max(1, docs.select("doc_id").count()) * (1 << 20)) + 1)
    texts, size = [], 0
    chosen = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share) & (F.coalesce(F.length("text"), F.lit(0)) <= 2 * SAMPLE_TOKENS))
    for x in chosen.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text").select("text").toLocalIterator():
        ids, kinds, _ = tokens(pa.array([x["text"]], pa.string()))
        if size + len(ids) > SAMPLE_TOKENS:
            continue
        size += len(ids)
        texts.append(_units(ids, kinds, find, unit, n_outputs))
    flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    n_streams = max(1, min(48, len(flat) // 64))
    flat = flat[: len(flat) // n_streams * n_streams].reshape(n_streams, -1)
    end = int(unit[np.searchsorted(known, END)]) if END in known else n_outputs
    classes, p = train(flat, n_outputs, frequency, end)
    p, learnt = rounds(docs, p, known, unit, n_outputs, end, total)
    return Network(known, c, unit, classes, p, total, distinct, rare, learnt), counts


def _units(ids: np.ndarray, kinds: np.ndarray, find: Lookup, unit: np.ndarray, n_outputs: int) -> np.ndarray:
    """Outputs of tokens: kinds are the last ones (one, if nothing is known)."""
    if not len(unit):
        return np.full(len(ids), n_outputs - 1) if n_outputs == 1 else n_outputs - KINDS + kinds
    at = find(ids)
    return np.where(at < len(unit), np.append(unit, 0)[at], n_outputs - KINDS + kinds)


@np.errstate(over="ignore")
def likelihood(net: Network, out: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 of the probability of each document's outputs; `first` says where a document begins (and the end)."""
    length = np.diff(first)
    total = np.zeros(len(length))
    begin = len(net.p["e"]) - 1
    order = np.argsort(-length, kind="stable")
    for a in range(0, len(order), TOGETHER):
        docs = order[a : a + TOGETHER]
        base, n = first[docs], length[docs]
        h = np.zeros((HIDDEN, len(docs)), np.float32)
        alive = np.searchsorted(-n, -np.arange(int(n[0])))  # documents that have a token at each place
        upto, t0 = np.concatenate(([0], np.cumsum(alive))), 0
        while t0 < len(alive):
            t1 = max(t0 + 1, int(np.searchsorted(upto, upto[t0] + WINDOW, side="right")) - 1)
            s = upto[t0 : t1 + 1] - upto[t0]
            t = np.repeat(np.arange(t0, t1), alive[t0:t1])
            who = np.arange(s[-1]) - np.repeat(s[:-1], alive[t0:t1])
            at = base[who] + t
            ex, wx = _inputs(net.p, np.where(t > 0, out[at - 1], begin))
            hs = np.empty((HIDDEN, len(at)), np.float32)
            for i, j in pairwise(s.tolist()):
                h = hs[:, i:j] = _step((wx @ ex[:, i:j]).T, h[:, : j - i].T, net.p["wh"])[0].T
            total += np.bincount(docs[who], _outputs(net, hs.T, out[at]), len(total))
            t0 = t1
    return total / LOG10


def _outputs(net: Network, hs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural logarithms of P(class) * P(output in class)."""
    outer, inner, order, _, cls, unit, _ = _logits(net.p, hs, target)
    got, m = np.empty(len(target)), np.arange(len(target))
    for x, chosen in ((outer, cls), (inner, unit)):
        np.subtract(x, x.max(0), out=x)
        here = x[chosen, m]
        here -= np.log(np.exp(x, out=x).sum(0))
        got[order] = here if x is outer else got[order] + here
    return got


FIRST = "kind int, row long, doc_id long, word long, ending int, tf long, n_known long, base double, score double"


def _score(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    """For each document what the frequent words give (kind 0; tf: tokens), and its other words to be joined (kind 1)."""
    n_outputs = len(net.p["e"]) - 1
    log_base = np.append(net.base(net.counts), 0.0)
    # a frequent word that isn't an output has its share of its kind
    of = net.output - (n_outputs - len(net.rare))
    find, output = Lookup(net.known), np.append(net.output, 0)
    in_kind = np.append(np.where(of >= 0, np.log10((net.counts + 0.1) / net.rare[np.maximum(of, 0)]), 0.0), 0.0)
    for batch in _slices(batches, 2):
        ids, kinds, first = tokens(batch.column(2))
        kinds = kinds if len(net.rare) > 1 else np.zeros_like(kinds)
        n = len(first) - 1
        doc = np.repeat(np.arange(n), np.diff(first))
        slot = find(ids)
        hit = slot < len(net.known)
        out = np.where(hit, output[slot], n_outputs - len(net.rare) + kinds)
        base = np.bincount(doc, log_base[slot], n)
        score = np.bincount(doc, in_kind[slot], n) + likelihood(net, out, first)
        known = np.bincount(doc, hit, n).astype(np.int64)
        rest = np.flatnonzero(~hit)
        order = np.lexsort((ids[rest], doc[rest]))
        rdoc, rword, rkind = doc[rest][order], ids[rest][order], kinds[rest][order]
        new = np.ones(len(rest), bool)
        new[1:] = (rdoc[1:] != rdoc[:-1]) | (rword[1:] != rword[:-1])
        head = np.flatnonzero(new)
        tf = np.diff(np.append(head, len(rest)))
        rows, docs = batch.column(0).to_numpy(), batch.column(1)
        m = len(head)
        null = lambda t, k: pa.nulls(k, t)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([0, 1], np.int32), (n, m))),
                pa.array(np.concatenate((rows, rows[rdoc[head]]))),
                pa.concat_arrays([docs, null(pa.int64(), m)]),
                pa.concat_arrays([null(pa.int64(), n), pa.array(rword[head].view(np.int64))]),
                pa.concat_arrays([null(pa.int32(), n), pa.array(rkind[head].astype(np.int32))]),
                pa.array(np.concatenate((np.diff(first), tf)).astype(np.int64)),
                pa.concat_arrays([pa.array(known), null(pa.int64(), m)]),
                pa.concat_arrays([pa.array(base), null(pa.float64(), m)]),
                pa.concat_arrays([pa.array(score), null(pa.float64(), m)]),
            ],
            names=["kind", "row", "doc_id", "word", "ending", "tf", "n_known", "base", "score"],
        )


def score(docs: DataFrame, net: Network, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every document."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(net)
    path = scratch.folder(spark, "scored")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered.mapInArrow(lambda batches: _score(batches, shipped.value), FIRST).write.partitionBy("kind").parquet(path)
    rows = spark.read.schema(FIRST).parquet(path)
    whole = net.total + 0.1 * (net.distinct + 1)
    rest = rows.where("kind = 1").select("row", "word", "ending", "tf").join(counts.select("word", "c"), "word", "left")
    rare = F.array(*(F.lit(float(x)) for x in net.rare))[F.col("ending")]
    log = lambda of: F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / of) * F.col("tf")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k"), F.sum(log(F.lit(float(whole)))).alias("b"), F.sum(log(rare)).alias("s"))
    full = rows.where("kind = 0").join(rest, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return full.select("doc_id", F.col("tf").alias("n_tokens"), add("n_known", "k").alias("n_known"), add("base", "b").alias("base_score"), add("score", "s").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net, counts = fit(docs.where(fold(10) != 0).select("doc_id", "text"))
    held = F.coalesce(fold(10) == 0, F.lit(True)).alias("held_out")
    return score(docs, net, counts).select("doc_id", held, "n_tokens", "n_known", F.lit(net.total).cast("long").alias("train_tokens"), "base_score", "score")
