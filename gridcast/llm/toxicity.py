"""Toxicity: a lexicon trie intersected with Levenshtein automata, and context windows around each hit.

The lexicon is learned on a bounded labelled sample (at most about `rows_per_label` rows of either label, by a hash of
doc_id; near copies count once, by their smallest shingle hash): words and stems (beginnings of `STEMS` letters) that are
much likelier in toxic than in other texts, beyond what chance gives among so many words. A word that holds none of them runs the automata for edit distance 1 (2 for terms
of ten letters or more; neighbouring letters that changed places are one edit) of the trie of all these words of `LEAST_FUZZY` letters
or more and of all stems, which match a word's beginning. A match is a misspelled term, unless the sample shows it to be an ordinary
word, and counts by its term's trust: how far the sampled words that come near the term, and stand in one text only (as words
do that the sample just missed), stand in toxic texts. Each hit has a window of `CONTEXT` words
to either side: quotation marks around it, words of reporting and the density of further hits separate quotation from abuse.
A logistic model, fitted on the sample, turns a text's sums over its hits into a score. Misspellings are rare in a sample,
so each toxic text with hits is also learned as if its terms were misspelled.

Defined cases: null and empty texts and texts without hits get the model's score for no hits; an empty or one-sided
training set gives the share of label 1 (0.0 if there are no labels); repeated labels of a doc_id count once by the
larger label; repeated documents give repeated rows; a null doc_id is held out; further columns are left out. Whole texts are read at any length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm import scratch
from gridcast.llm import text as tx

CONTEXT = 6
SAMPLE_ROWS = 3000
LEXICON, EXCEPTIONS = 300, 100_000
CACHE_WORDS = 200_000
LEAST_LETTERS, LEAST_FUZZY = 2, 4
STEMS = range(4, 9)
# Words of reporting speech in the four languages of the tables, and quotation marks.
REPORTING = frozenset("said says wrote quoted quote called reported according sagte schrieb zitat dit disait cita dijo".split())
QUOTES = ('"', "“", "”", "«", "»", "„")

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
FEATURES = 7


class Trie:
    """Levenshtein automata of all terms at once, as a trie of the terms that is read letter by letter of a word.

    A configuration is (node, edits so far, letter awaited after a swap); the configurations after a prefix of a word are one
    state. States and their transitions are made when first met, so a word costs a lookup for each letter until its
    state is dead, which is after a few letters for most words.
    """

    MOST_STATES = 50_000

    def __init__(self, terms: dict[str, float], edits):
        """edits(term): how many a term may have. A term that ends in a star matches the beginning of a word."""
        self.open: set[int] = set()
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, float] | None] = [None]
        self.most = [0]
        self.allowed = {t: edits(t) for t in terms}
        for term, weight in terms.items():
            node = 0
            self.most[0] = max(self.most[0], self.allowed[term])
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], self.allowed[term])
            if term.endswith("*"):
                self.open.add(node)
            if not self.ends[node] or weight > self.ends[node][1]:
                self.ends[node] = (term, weight)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.start = self._state({(0, 0, "")} if self.allowed else set())

    def _state(self, found: set) -> int:
        """The number of a state, closed under letters that the word leaves out; -1 if it is dead."""
        todo = list(found)
        while todo:
            node, e, awaited = todo.pop()
            if not awaited:
                for child in self.children[node].values():
                    if e < self.most[child] and (child, e + 1, "") not in found:
                        found.add((child, e + 1, ""))
                        todo.append((child, e + 1, ""))
        if not found:
            return -1
        key = frozenset(found)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        found = set()
        for node, e, awaited in self.states[state]:
            if awaited:
                if c == awaited:
                    found.add((node, e, ""))
                continue
            if node in self.open:
                found.add((node, e, ""))
            for x, child in self.children[node].items():
                if x == c:
                    found.add((child, e, ""))
                elif e < self.most[child]:
                    found.add((child, e + 1, ""))
                    if c in self.children[child] and e < self.most[self.children[child][c]]:
                        found.add((self.children[child][c], e + 1, x))
            if e < self.most[node]:
                found.add((node, e + 1, ""))
        made = self._state(found)
        self.next[state][c] = made
        return made

    def near(self, word: str) -> tuple[str, float, int] | None:
        """(term, weight, edits) of the nearest term within its edits, then the weightiest; or None."""
        if len(self.states) > self.MOST_STATES:
            self._reset()
        state = self.start
        for c in word:
            if state < 0:
                return None
            state = self.next[state].get(c, -2)
            if state == -2:
                state = self._walk(word)
                break
        if state < 0:
            return None
        ends = [(e, -self.ends[node][1], self.ends[node][0]) for node, e, awaited in self.states[state] if not awaited and self.ends[node] and e <= self.allowed[self.ends[node][0]]]
        if not ends:
            return None
        e, weight, term = min(ends)
        return term, -weight, e

    def _walk(self, word: str) -> int:
        state = self.start
        for c in word:
            if state < 0:
                break
            known = self.next[state].get(c, -2)
            state = self._step(state, c) if known == -2 else known
        return state


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    fuzzy: frozenset[str] = frozenset()
    ordinary: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -30.0
    trust: dict[str, float] = field(default_factory=dict)
    trie: Trie | None = None
    cache: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"terms": self.terms, "stems": self.stems, "fuzzy": self.fuzzy, "ordinary": self.ordinary, "weights": self.weights, "bias": self.bias, "trust": self.trust}

    def __setstate__(self, state):
        self.__dict__.update(state, trie=None, cache={})

    def hit(self, word: str) -> tuple[float, bool, float] | None:
        """(weight, spelled as in the lexicon, trust in its misspelled forms) of a lower-case word."""
        found = self.cache.get(word, self)
        if found is not self:
            return found
        if word in self.terms:
            found = (self.terms[word], True, self.trust.get(word, 1.0))
        elif stem := self.stem(word):
            found = (self.stems[stem], True, self.trust.get(stem + "*", 1.0))
        else:
            near = self.near(word) if word not in self.ordinary else None
            found = (near[1] / (1 + near[2]), False, self.trust.get(near[0], 1.0)) if near else None
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        self.cache[word] = found
        return found

    def stem(self, word: str) -> str | None:
        return next((x for n in STEMS if (x := word[:n]) in self.stems), None)

    def near(self, word: str) -> tuple[str, float, int] | None:
        """The term (a stem with a star), weight and edits of the nearest term in misspelled form."""
        if not LEAST_FUZZY - 1 <= len(word):
            return None
        if self.trie is None:
            looked = {t: self.terms[t] for t in self.fuzzy if len(t) >= LEAST_FUZZY} | {t + "*": w for t, w in self.stems.items()}
            self.trie = Trie(looked, lambda t: 2 if len(t) >= 10 else 1)
        return self.trie.near(word)

    def features(self, text: str, misspelled: bool = False) -> np.ndarray:
        """Sums over hits: any exact, exact, misspelled abuse, weight of exact abuse, quoted, reported, and hits in each other's window.

        misspelled: as if every term were.
        """
        out = np.zeros(FEATURES)
        if not self.terms and not self.stems:
            return out
        low = text.lower()
        spans = None
        known, words = self.cache, WORD.findall(low)
        hits = [(i, h) for i, w in enumerate(words) if (h := known[w] if w in known else self.hit(w))]
        if not hits:
            return out
        marked = any(q in low for q in QUOTES)
        places = np.array([i for i, _ in hits])
        for i, (weight, exact, trust) in hits:
            exact = exact and not misspelled
            reported = not REPORTING.isdisjoint(words[max(0, i - CONTEXT) : i + CONTEXT + 1])
            quoted = False
            if marked:
                spans = spans or [m.span() for m in WORD.finditer(low)]
                a, b = spans[max(0, i - CONTEXT)][0], spans[min(len(words) - 1, i + CONTEXT)][1]
                left, right = low[a : spans[i][0]], low[spans[i][1] : b + 1]
                quoted = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
            near = int(np.searchsorted(places, i + CONTEXT, "right") - np.searchsorted(places, i - CONTEXT)) - 1
            told = 0.3 if quoted or reported else 1.0
            found = (0, exact, 0.0 if exact else told, weight * told if exact else 0.0, quoted, reported, min(near, 3))
            out += found if exact else np.multiply(trust, found)
        out[0] = out[1] > 0
        out[1:] = np.log1p(out[1:])
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -35, 35)))


def fold(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def sample(docs: DataFrame, labels: DataFrame, rows_per_label: int) -> DataFrame:
    """At most about that many labelled rows of either label: doc_id, text, toxic."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    least = lambda k: min(1 << 20, int(rows_per_label / max(1, size.get(k, 0)) * (1 << 20)) + 1)
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, least(1)).otherwise(least(0)))
    # at most about 2 * rows_per_label rows of two numbers, so documents needn't be shuffled
    return scratch.keep(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sample")


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sampled text's distinct words and stems (with a star), and a hash that near copies mostly share."""
    for batch in batches:
        keys, words = [], []
        for i, j, w in tx.words(batch.column(0)):
            doc, h = tx.shingles(w, 5)
            least = np.zeros(j - i, tx.U)
            full, first = np.unique(doc, return_index=True)
            least[full] = h[first]
            keys += least.view(np.int64).tolist()
        for text in batch.column(0).to_pylist():
            found = {w for w in WORD.findall((text or "").lower()) if len(w) >= LEAST_LETTERS}
            words.append([*found, *{w[:n] + "*" for w in found for n in STEMS if n < len(w)}])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(1), pa.array(words, pa.list_(pa.string()))], names=["key", "toxic", "words"])


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = SAMPLE_ROWS, terms: int = LEXICON) -> Model:
    """The lexicon comes to the driver as at most `terms` words, the sample's features as one row each."""
    rows = sample(docs, labels, rows_per_label)
    once = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_distinct, "key long, toxic int, words array<string>").groupBy("key", "toxic").agg(F.first("words").alias("words"))
    texts = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = texts.get(1, 0), texts.get(0, 0)
    model = Model()
    if not pos or not neg:
        model.bias = 35.0 if pos else -35.0
        return model
    n = once.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    ratio = F.log(((F.col("a") + 0.5) / (pos + 1)) / ((F.col("b") + 0.5) / (neg + 1)))
    n = scratch.keep(n.withColumn("ratio", ratio), "words")
    # Chernoff's bound of the chance that toxic texts make up so many of a word's: below 1 % for all words of the sample together
    size, rate = F.col("a") + F.col("b"), pos / (pos + neg)
    chance = F.col("a") * F.log(F.col("a") / size / F.lit(rate)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / size / F.lit(1 - rate))).otherwise(0.0)
    found = n.where((F.col("a") >= 3) & (F.col("ratio") >= 3.5) & (chance >= math.log(100 * max(1, n.count())))).orderBy(F.desc(F.col("ratio") * F.sqrt("a")), "word").limit(8 * terms).collect()
    words = {r["word"]: r for r in found if not r["word"].endswith("*")}
    model.stems = _stems({r["word"][:-1]: r for r in found if r["word"].endswith("*")}, words)
    model.terms = {w: r["ratio"] for w, r in list(words.items())[:terms]}
    model.fuzzy = frozenset(w for w in model.terms if len(w) >= LEAST_FUZZY)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def fuzzy(batches):
        own = shipped.value
        for batch in batches:
            near = [None if w in own.terms or own.stem(w) else own.near(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x and x[0] for x in near], pa.string())], names=["word", "a", "b", "ratio", "term"]).filter(pa.array([x is not None for x in near], pa.bool_()))

    close = n.where("word not like '%*'").select("word", "a", "b", "ratio").mapInArrow(fuzzy, "word string, a long, b long, ratio double, term string")
    close = scratch.keep(close, "close")
    model.ordinary = frozenset(r["word"] for r in close.where("ratio < 1").orderBy(F.desc("b"), "word").limit(EXCEPTIONS).collect())
    alone = close.where("a + b = 1").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    model.trust = {r["term"]: _trust(r["a"] / pos, r["b"] / neg, 1 / neg) for r in alone}
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        own = shipped.value
        for batch in batches:
            kinds, out = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = own.features(text or "")
                kinds.append(toxic)
                out.append(x.tobytes())
                if toxic and x[1]:
                    kinds.append(2)
                    out.append(own.features(text, misspelled=True).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(out, pa.binary())], names=["kind", "features"])

    got = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(measure, "kind int, features binary").collect()
    kind = np.array([r["kind"] for r in got])
    x = np.stack([np.frombuffer(r["features"]) for r in got])
    # the sample holds either label at its own rate; weights give the labels back their shares of the training rows
    total = {r["toxic"]: r["n"] for r in labels.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = [total.get(k, 0) / max(1, (kind == k).sum()) for k in (0, 1)]
    weight = np.choose(kind, [share[0], share[1], 0.5 * share[1]])
    model.weights, model.bias = _logistic(x, (kind > 0).astype(float), weight)
    return model


def _trust(toxic: float, other: float, least: float) -> float:
    """The share of toxic texts among those with a near match of a term, by label's rates; 1 where nothing speaks against the term."""
    return (toxic + least) / (toxic + other + least)


def _stems(stems: dict, words: dict) -> dict[str, float]:
    """Stems that say more than one word does: half as many texts again as any single word with it; of nested ones the shortest whose ratio is nearly the best."""
    out: dict[str, float] = {}
    for stem in sorted(stems, key=lambda x: (len(x), x)):
        r = stems[stem]
        single = max((w["a"] for t, w in words.items() if t.startswith(stem)), default=0)
        if r["ratio"] >= 5 and r["a"] >= 1.5 * single and not any(stem.startswith(x) and w >= r["ratio"] - 0.7 for x, w in out.items()):
            out[stem] = r["ratio"]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton steps with a small penalty."""
    a = np.hstack((x, np.ones((len(x), 1))))
    b, ridge = np.zeros(a.shape[1]), np.diag([penalty] * x.shape[1] + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (w * (p - y)) + ridge @ b)
        b -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return b[:-1], float(b[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and n_hits for every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            x = np.array([own.features(t.as_py() or "") for t in batch.column(1)]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(x)), pa.array(np.rint(np.expm1(x[:, 1]) + np.expm1(x[:, 2])).astype(np.int64))], names=["doc_id", "score", "n_hits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, n_hits long")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(fold(4) != 2))
    return score(docs, model).select("doc_id", F.coalesce(fold(4) == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_hits")
