"""Phrase collocations: contiguous phrases of 2 to 5 words, counted in HAT-tries inside tasks, and scored by their weakest cut.

Counting. A word's id is a 64-bit hash of its language and its bytes, so all counts are by language. In a task a `HatTrie` counts
n-grams: a shallow trie over word ids whose leaves are hash containers, each of a range of the next word's id. A container that
outgrows `BURST` entries is split in two, or, when it holds one word only, becomes a node whose containers are ranges of the word after it.
Beyond `MOST_ENTRIES` the largest subtrees are spilled as sorted runs, as is the rest at the end. Runs are dealt by prefix (the first word, and for
common first words a part of the second) and merged: a sum of each n-gram within its prefix's partition.

Passes. A phrase is frequent only if its words and its pairs are, so three passes over the texts suffice:
  * words: those of `LEAST` occurrences or more are frequent, and all words together are n;
  * pairs of two frequent words, only to tell which may be frequent: a run has 32 bits of the second word, so a count may be too large, never too small;
  * all phrases of 2 to 5 words within runs of such pairs, counted by their whole ids.
Frequent words and pairs are told by Bloom filters of at most `MOST_BITS` bits; what one lets through wrongly costs a row and changes nothing.

Scoring. Frequent phrases meet the frequent words' texts, and every cut of a phrase meets the counts of its two parts, in joins; so do the
phrases inside longer ones. Numbers that may pass 64 bits are decimals of 38 digits.

Hashes stand for words (64 bits) and, within one container of one task, for n-grams (64 bits, beside the range of the container).

Defined cases: a null text is empty; a null lang is `und`; an empty table gives no rows; repeated rows count each; a null doc_id counts like
any other; ties of the score are broken by occurrences and then by the phrase's bytes; further columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm import scratch
from gridcast.llm import text as tx

LONGEST, LEAST, TOP, PERCENT = 5, 100, 2000, 100
#: Entries of one container, and of a task's trie (48 bytes each for pairs).
BURST, MOST_ENTRIES = 1 << 15, 1 << 20
#: Words of all texts for each part that runs of pairs are merged by; a word of more than one in SHARES of them is common.
PART_WORDS, SHARES = 4_000_000, 1000
#: Bytes of text handled at once.
CHUNK = 2 << 20
#: Bits of a Bloom filter: some 16 for each entry, 32 MB at most.
MOST_BITS, PROBES, PIECE = 1 << 28, 3, 1 << 19

# pieces end at marks and line ends, words within them at blanks and tabs
_INSIDE = np.ones(256, bool)
_INSIDE[list(b".,;:!?\x0a\x0b\x0c\x0d")] = False
_WORD = _INSIDE.copy()
_WORD[list(b" \t")] = False
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
RUNS = "part long, run binary"


class Container:
    """Counts of n-grams by their hash: compacted columns and what came since. Columns: key, c, then the words' ids (and what else belongs to an entry)."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high  # of the word id that the trie branches on here, both inclusive
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.fresh = 0
        self.whole = False  # can't be split further

    def add(self, rows: tuple[np.ndarray, ...]) -> None:
        self.parts.append(rows)
        self.fresh += len(rows[0])
        if self.fresh > max(4096, self.size):
            self.compact()

    def compact(self) -> tuple[np.ndarray, ...]:
        """One entry for each n-gram."""
        if self.fresh:
            key, c, *rest = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            self.parts = [(key[first], np.add.reduceat(c[order], first), *(r[order[first]] for r in rest))]
            self.size, self.fresh = len(first), 0
        return self.parts[0]

    @property
    def entries(self) -> int:
        return self.size + self.fresh


class Node:
    """A trie node: children in order of the ranges of word ids that they hold; a child is a container or, for a single id, a node."""

    def __init__(self, depth: int):
        self.depth, self.children, self.lows = depth, [Container(0, (1 << 64) - 1)], np.zeros(1, tx.U)

    def _set(self, i: int, new: list) -> None:
        self.children[i : i + 1] = new
        self.lows = np.array([c.low for c in self.children], tx.U)

    def add(self, rows: tuple[np.ndarray, ...], deepest: int) -> None:
        """rows: as a container's, sorted by the word at this node's depth."""
        cut = np.searchsorted(rows[2 + self.depth], self.lows[1:])
        edge = [0, *cut.tolist(), len(rows[0])]
        for i in range(len(self.children) - 1, -1, -1):
            a, b = edge[i], edge[i + 1]
            if a == b:
                continue
            child, part = self.children[i], tuple(r[a:b] for r in rows)
            if isinstance(child, Node):
                order = np.argsort(part[2 + child.depth], kind="stable")
                child.add(tuple(r[order] for r in part), deepest)
            else:
                child.add(part)
                if child.entries > BURST and not child.whole:
                    child.compact()
                    if child.size > BURST:
                        self._burst(i, deepest)

    def _burst(self, i: int, deepest: int) -> None:
        """Two containers of half the range, or a node where the range is one word."""
        child = self.children[i]
        rows = child.compact()
        word = rows[2 + self.depth]
        middle = np.partition(word, len(word) // 2)[len(word) // 2]
        if (word == middle).all():
            if self.depth + 1 >= deepest:
                child.whole = True
                return
            node = Node(self.depth + 1)
            node.low, node.high = child.low, child.high
            order = np.argsort(rows[2 + node.depth], kind="stable")
            node.add(tuple(r[order] for r in rows), deepest)
            # the range may be wider than the word: what else comes later gets containers of its own
            at, new = int(middle), [node]
            node.low = node.high = at
            if child.low < at:
                new.insert(0, Container(child.low, at - 1))
            if at < child.high:
                new.append(Container(at + 1, child.high))
            self._set(i, new)
            return
        if middle == word.min():
            middle = word[word > middle].min()
        lower = word < middle
        halves = [Container(child.low, int(middle) - 1), Container(int(middle), child.high)]
        for half, keep in zip(halves, (lower, ~lower), strict=True):
            half.add(tuple(r[keep] for r in rows))
            half.compact()
        self._set(i, halves)

    @property
    def entries(self) -> int:
        return sum(c.entries for c in self.children)

    def rows(self) -> Iterator[tuple[np.ndarray, ...]]:
        for child in self.children:
            if isinstance(child, Node):
                yield from child.rows()
            elif child.entries:
                yield child.compact()


class HatTrie:
    """Counts n-grams in bounded memory; what is spilled comes as sorted runs. n: word ids of an entry; further columns may follow them."""

    def __init__(self, n: int, most: int | None = None):
        self.n, self.most, self.root = n, most or MOST_ENTRIES, Node(0)

    def add(self, rows: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, ...]]:
        """rows: key, c, word ids, further columns. Gives the runs that had to be spilled."""
        if len(rows[0]):
            order = np.argsort(rows[2], kind="stable")
            self.root.add(tuple(r[order] for r in rows), min(self.n, 2))
        if self.root.entries > self.most:
            # whole subtrees, the largest first, until half of the room is free
            for child in sorted(self.root.children, key=lambda c: -c.entries):
                if self.root.entries <= self.most // 2:
                    break
                yield from self._run(child)
                self.root._set(self.root.children.index(child), [Container(child.low, child.high)])

    def _run(self, child) -> Iterator[tuple[np.ndarray, ...]]:
        """The rows of a subtree, sorted by their words."""
        for rows in child.rows() if isinstance(child, Node) else [child.compact()] if child.entries else []:
            order = np.lexsort(rows[2 + self.n - 1 : 1 : -1])
            yield tuple(r[order] for r in rows)

    def rest(self) -> Iterator[tuple[np.ndarray, ...]]:
        for child in self.root.children:
            yield from self._run(child)
        self.root = Node(0)


class Chunk:
    """Words of a few documents: their ids, and how many words each piece still has from a word on."""

    def __init__(self, w: tx.Words, salts: np.ndarray):
        self.w, self.lang = w, w.doc()
        self.ids = tx.mix(w.hashes() ^ salts[self.lang], 0x13)
        marks = np.concatenate(([0], np.cumsum(~_INSIDE[w.data])))
        new = np.ones(len(self.ids) + 1, bool)
        new[1:-1] = (marks[w.begin[1:]] > marks[w.end[:-1]]) | (self.lang[1:] != self.lang[:-1])
        edge = np.flatnonzero(new)
        self.left = np.repeat(edge[1:], np.diff(edge)) - np.arange(len(self.ids))  # words from here to the end of the piece

    def grams(self, at: np.ndarray, k: int, columns: int) -> tuple[np.ndarray, ...]:
        """Distinct n-grams of k words that begin at `at`: key, c, and the words' ids (0 beyond the k-th)."""
        key, first, c = np.unique(tx.Rolling(self.ids).of(at, k, 2), return_index=True, return_counts=True)
        at = at[first]
        return (key, c, *(self.ids[at + i] if i < k else np.zeros(len(at), tx.U) for i in range(columns)))


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[Chunk, pa.Array]]:
    """batch: text, lang."""
    for i, j, w in tx.words(batch.column(0), _WORD, limit=CHUNK):
        langs = batch.column(1).slice(i, j - i)
        coded = langs.dictionary_encode()
        salts = np.array([_salt(x) for x in coded.dictionary.to_pylist()], tx.U)
        yield Chunk(w, salts[coded.indices.to_numpy()] if j > i else salts), langs


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a task with their counts, languages and bytes."""
    trie, langs = HatTrie(1), {}

    def batch_of(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        _, c, ids, lang, word = rows
        names = list(langs)
        return pa.RecordBatch.from_arrays([pa.array(tx.signed(ids)), pa.array([names[x] for x in lang.tolist()], pa.string()), pa.array(word.tolist(), pa.binary()), pa.array(c)], names=["w", "lang", "word", "c"])

    for batch in batches:
        for chunk, own in _chunks(batch):
            ids, first, c = np.unique(chunk.ids, return_index=True, return_counts=True)
            number = np.array([langs.setdefault(x, len(langs)) for x in own.to_pylist()], np.int64)
            raw, word = chunk.w.data.tobytes(), np.empty(len(ids), object)
            word[:] = [raw[a:b] for a, b in zip(chunk.w.begin[first].tolist(), chunk.w.end[first].tolist(), strict=True)]
            yield from map(batch_of, trie.add((ids, c, ids, number[chunk.lang[first]] if len(first) else first, word)))
    yield from map(batch_of, trie.rest())


def encoded(c: np.ndarray, one: np.ndarray, rest: list[np.ndarray]) -> bytes:
    """A sorted run: each first word once with the number of its rows, then the further columns and a byte of each count (255: it stands apart)."""
    first = np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1]))) if len(one) else np.zeros(0, np.int64)
    large = np.flatnonzero(c >= 255)
    parts = (np.array([len(first), len(c), len(large)]), one[first], np.diff(np.append(first, len(c))), c[large], *rest, np.minimum(c, 255).astype(np.uint8))
    return b"".join(p.tobytes() for p in parts)


def decoded(run: bytes, columns: int, kind: type) -> tuple[np.ndarray, ...]:
    """(c, first word, further columns of that kind) of the rows of a run."""
    groups, n, large = np.frombuffer(run, np.int64, 3).tolist()
    one, size, extra = (np.frombuffer(run, t, k, 24 + 8 * at) for t, k, at in ((tx.U, groups, 0), (np.int64, groups, groups), (np.int64, large, 2 * groups)))
    at, wide = 24 + 8 * (2 * groups + large), np.dtype(kind).itemsize * n
    rest = [np.frombuffer(run, kind, n, at + i * wide) for i in range(columns)]
    c = np.frombuffer(run, np.uint8, n, at + columns * wide).astype(np.int64)
    c[c == 255] = extra
    return c, np.repeat(one, size), *rest


def _cut(common: np.ndarray, parts: int, kind: type):
    """Cuts a sorted run by prefix: by the first word, and for a common one by some of the second. kind: of what is kept of the further words."""

    def cut(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        _, c, one, *rest = rows
        at = np.searchsorted(common, one)
        at[at == len(common)] = 0
        often = common[at] == one if len(common) else np.zeros(len(one), bool)
        part = tx.mix(one ^ np.where(often, (rest[0] & tx.U(63)) + tx.U(1), tx.U(0)), 0x35) % tx.U(parts)
        order = np.argsort(part, kind="stable")
        part, c, one, rest = part[order], c[order], one[order], [r[order].astype(kind) for r in rest]
        edge = [*np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist(), len(part)]
        runs = [encoded(c[a:b], one[a:b], [r[a:b] for r in rest]) for a, b in zip(edge, edge[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]].astype(np.int64)), pa.array(runs, pa.binary())], names=["part", "run"])

    return cut


def _pairs(shipped, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of pairs of frequent words, with 32 bits of the second one."""
        words, common = shipped.value
        trie, cut = HatTrie(2), _cut(common, parts, np.uint32)
        for batch in batches:
            for chunk, _ in _chunks(batch):
                good = holds(words, chunk.ids)
                at = np.flatnonzero(good[:-1] & good[1:] & (chunk.left[:-1] > 1))
                yield from map(cut, trie.add(chunk.grams(at, 2, 2)))
        yield from map(cut, trie.rest())

    return run


def _long(shipped, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of phrases whose pairs all pass the filter."""
        pairs, common = shipped.value
        trie, cut = HatTrie(LONGEST), _cut(common, parts, tx.U)
        for batch in batches:
            for chunk, _ in _chunks(batch):
                at = np.flatnonzero(chunk.left > 1)
                good = np.zeros(len(chunk.ids) + 1, bool)
                good[at] = holds(pairs, pair_key(chunk.ids[at], chunk.ids[at + 1] & tx.U(0xFFFFFFFF)))
                # pairs in a row from each word on
                bad = np.flatnonzero(~good)
                run_ = bad[np.searchsorted(bad, np.arange(len(chunk.ids)))] - np.arange(len(chunk.ids))
                grams = [chunk.grams(np.flatnonzero(run_ >= k - 1), k, LONGEST) for k in range(2, LONGEST + 1)]
                yield from map(cut, trie.add(tuple(np.concatenate(x) for x in zip(*grams, strict=True))))
        yield from map(cut, trie.rest())

    return run


def _often(runs: list[bytes], least: int, columns: int, kind: type) -> Iterator[pa.RecordBatch]:
    """The n-grams of one prefix part whose counts over all runs are large enough."""
    if runs:
        c, *words = (np.concatenate(x) for x in zip(*(decoded(r, columns, kind) for r in runs), strict=True))
        order = np.lexsort(words[::-1])
        c, words = c[order], [w[order].astype(tx.U) for w in words]
        first = np.flatnonzero(np.concatenate(([True], np.any([w[1:] != w[:-1] for w in words], 0))))
        total = np.add.reduceat(c, first)
        keep = first[total >= least]
        ids = [pa.array(tx.signed(w[keep]), mask=w[keep] == 0) for w in words]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(total[total >= least])], names=[*WORDS[: columns + 1], "c"])


def _merged(runs: DataFrame, columns: int, kind: type) -> DataFrame:
    """Merges the runs of each part: its n-grams (w1, w2, ..., c) with enough occurrences."""
    least = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            for part, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now:
                    yield from _often(own, least, columns, kind)
                    now, own = part, []
                own.append(one)
        yield from _often(own, least, columns, kind)

    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(run, ", ".join(f"{w} long" for w in WORDS[: columns + 1]) + ", c long")


# ---- filters ----


def pair_key(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return tx.mix(one * tx.U(0x9E3779B97F4A7C15) + two, 0x29)


def _probes(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [tx.mix(ids, 0x40 + i) & tx.U(bits - 1) for i in range(PROBES)]


def holds(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the filter lets through: all that were put in, and few others."""
    good = np.ones(len(ids), bool)
    for at in _probes(ids, len(words) * 64):
        good &= (words[at >> tx.U(6)] >> (at & tx.U(63))) & tx.U(1) == 1
    return good


def bloom(rows: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the keys of rows of w1, or of w1 and w2, put together in tasks a piece of the bits at a time."""
    bits = min(MOST_BITS, max(1 << 12, 1 << (16 * n).bit_length()))
    piece = min(PIECE, bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [c.to_numpy().view(tx.U) for c in batch.columns]
            at = np.unique(np.concatenate(_probes(ids[0] if len(ids) == 1 else pair_key(*ids), bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // piece).astype(np.int32)), pa.array((at % piece).astype(np.int32))], names=["piece", "at"])

    def filled(group: pa.Table) -> pa.Table:
        own = np.zeros(piece, np.uint8)
        own[group["at"].to_numpy()] = 1
        return pa.table({"piece": group["piece"][:1], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(bits // 64, tx.U)
    found = rows.mapInArrow(places, "piece int, at int").distinct().groupBy("piece").applyInArrow(filled, "piece int, bits binary")
    for r in found.collect():
        out[r["piece"] * piece // 64 :][: piece // 64] = np.frombuffer(r["bits"], tx.U)
    return out


# ---- merging and scoring ----


def _named(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, words (array), a of phrases given by their ids."""
    out = phrases
    for i, w in enumerate(WORDS):
        own = words.select(F.col("w").alias(w), F.col("word").alias(f"t{i}"), *([F.col("lang").alias("of")] if not i else []))
        out = out.join(own, w, "left" if i > 1 else "inner")
    return out.select(F.col("of").alias("lang"), F.array_compact(F.array(*(f"t{i}" for i in range(LONGEST)))).alias("words"), F.col("c").alias("a"))


def count(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all languages, and lang, words, a of all phrases of 1 to `LONGEST` words with a >= `LEAST`."""
    spark = docs.sparkSession
    docs = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    runs = docs.mapInArrow(_words, "w long, lang string, word binary, c long")
    every = runs.repartition("w").groupBy("w").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("c").alias("c"))
    every = scratch.keep(every, "words")
    totals = scratch.keep(every.groupBy("lang").agg(F.sum("c").alias("n")), "totals")
    words = scratch.keep(every.where(F.col("c") >= LEAST).withColumn("word", F.col("word").cast("string")), "frequent")
    whole = totals.agg(F.sum("n")).first()[0] or 0
    common = np.sort(np.array([r["w"] for r in words.where(F.col("c") > whole / SHARES).select("w").collect()], np.int64).view(tx.U))  # fewer than SHARES
    parts = max(1, -(-whole // PART_WORDS))
    shipped = spark.sparkContext.broadcast((bloom(words.select("w"), words.count()), common))
    pairs = scratch.keep(_merged(docs.mapInArrow(_pairs(shipped, parts), RUNS), 1, np.uint32), "pairs")
    shipped.destroy()
    shipped = spark.sparkContext.broadcast((bloom(pairs.select("w1", "w2"), pairs.count()), common))
    phrases = scratch.keep(_merged(docs.mapInArrow(_long(shipped, parts), RUNS), LONGEST - 1, tx.U), "phrases")
    shipped.destroy()
    return totals, scratch.keep(words.select("lang", F.array("word").alias("words"), F.col("c").alias("a")).unionByName(_named(phrases, words)), "named")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    totals, phrases = count(docs)
    size, joined = F.size("words"), lambda x: F.array_join(x, " ")
    counts = phrases.select("lang", joined("words").alias("part"), F.col("a").alias("f"))
    candidates = phrases.where(size > 1).withColumn("phrase", joined("words"))

    # a phrase inside a longer one with as good as all of its occurrences goes
    length, start = F.explode(F.sequence(F.lit(2), size - 1)).alias("length"), F.explode(F.sequence(F.lit(1), size - F.col("length") + 1)).alias("start")
    inner = candidates.where(size > 2).select("lang", "words", "a", length).select("lang", "words", "a", "length", start)
    inner = inner.select("lang", joined(F.slice("words", F.col("start"), F.col("length"))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * PERCENT))

    cuts = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("first", joined(F.slice("words", F.lit(1), F.col("k")))).withColumn("rest", joined(F.slice("words", F.col("k") + 1, size - F.col("k"))))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(totals), "lang") if totals.count() <= 10_000 else cuts.join(totals, "lang")
    big = lambda c, digits=19: F.col(c).cast(f"decimal({digits},0)")
    cuts = cuts.withColumn("up", (F.lit(1000) * F.col("a")).cast("decimal(19,0)") * big("n")).withColumn("down", big("l") * big("r"))
    cuts = cuts.withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(scratch.table(spark, sf_dir, "documents"))


SQL = rf"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
f as (
  select lang, k, array_to_string(g, ' ') as phrase, count(*) as f
  from (select lang, k, w[s:s + k - 1] as g from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as s from w, range(1, {LONGEST + 1}) as r(k) where len(w) >= k))
  group by all having count(*) >= {LEAST}
),
t as (select lang, sum(len(w))::bigint as n from w group by lang),
c as (select lang, k, phrase, string_split(phrase, ' ') as w, f as a from f where k > 1),
i as (
  select lang, array_to_string(w[s:s + m - 1], ' ') as phrase, max(a) as longer
  from (select lang, w, a, m, unnest(range(1, k - m + 2)) as s from (select *, unnest(range(2, k)) as m from c where k > 2))
  group by all
),
kept as (select c.* from c left join i using (lang, phrase) where longer is null or 100 * longer < {PERCENT} * a),
cut as (select *, array_to_string(w[1:j], ' ') as one, array_to_string(w[j + 1:], ' ') as two from (select *, unnest(range(1, k)) as j from kept)),
scored as (
  select cut.lang, cut.phrase, a, x.f as l, y.f as r, n, ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint as score, j
  from cut join f x on x.lang = cut.lang and x.phrase = one join f y on y.lang = cut.lang and y.phrase = two join t on t.lang = cut.lang
),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a, l, r, n, score
from best qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= {TOP}
"""
