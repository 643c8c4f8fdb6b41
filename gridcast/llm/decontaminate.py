"""Benchmark decontamination by a prefix-filtered set join.

A window is ten consecutive words of a benchmark item (a shorter item is one window). Containment of a whole window means
that the document holds all of its words, so the necessary prefix of a window, with words ordered by rarity, is one
word: its rarest by the number of occurrences in all documents (ties: smaller hash). A document word that is some
window's prefix proposes that window where it would have to begin; the positional bound (it must begin in the document)
and the length bound (it must end there) prune, the hash of the words at the place is compared, and what is left is
verified word by word.

The benchmark side is small and is shipped to the tasks only behind a check of its size: at most `BLOCK_BYTES` bytes of text at a
time. A larger benchmark is cut by item into blocks of that size, and the documents go through one map for each block, one after another in
the same pass; each map adds its hits to the row, the last one makes the result. After `CHAIN` blocks the rows are written, so that no
task holds more than that. Documents are read once for the hits (and once for each block's word counts) and never shuffled.

Defined cases: null texts and texts without words have n_words 0, no hits and are clean; an item without words has no
window; equal windows of several items count for each of them; a null item_id counts as an item but has no name in the digest; null
doc_ids and repeated rows of documents give one row each (rows are judged alone); an empty benchmark leaves every document
clean; further columns are left out by `scan`, kept by `clean`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm import scratch
from gridcast.llm import text as tx

WINDOW = 10
#: Bytes of benchmark text shipped to a task at once; its windows take about thirty times that.
BLOCK_BYTES = 2_000_000
#: Blocks that documents meet before they are written.
CHAIN = 4
SCANNED = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
HITS = "doc_id long, text string, begin array<int>, length array<int>, items array<string>"


class Block:
    """Windows of some items: their words, the items that have them, and the index from prefix word to windows."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        self.words, self.begin, self.size, owners = np.zeros(0, tx.U), [], [], []
        parts, base = [], 0
        for i, _, w in tx.words(texts, tx.ALNUM):
            h = w.hashes()
            parts.append(h)
            for d, (a, n) in enumerate(zip(w.first[:-1].tolist(), w.counts.tolist(), strict=True)):
                for s in range(max(1, n - window + 1) if n else 0):
                    self.begin.append(base + a + s)
                    self.size.append(min(n, window))
                    owners.append(ids[i + d])
            base += len(h)
        self.words = np.concatenate(parts) if parts else self.words
        begin, size = np.array(self.begin, np.int64), np.array(self.size, np.int64)
        value = tx.Rolling(self.words).of(begin, size) if len(begin) else np.zeros(0, tx.U)
        self.value, first, which = np.unique(value, return_index=True, return_inverse=True)
        self.begin, self.size = begin[first], size[first]
        self.items: list[list[str]] = [[] for _ in first]
        for k, owner in zip(which.tolist(), owners, strict=True):
            self.items[k].append(owner)
        self.vocabulary = np.unique(self.words)

    def order(self, counts: np.ndarray) -> None:
        """counts: occurrences in all documents of each vocabulary word. Chooses each window's prefix."""
        rank = np.empty(len(self.vocabulary), np.int64)
        rank[np.lexsort((self.vocabulary, counts))] = np.arange(len(rank))
        ranks = rank[np.searchsorted(self.vocabulary, self.words)]
        offset = np.array([int(ranks[b : b + n].argmin()) for b, n in zip(self.begin.tolist(), self.size.tolist(), strict=True)], np.int64)
        prefix = self.words[self.begin + offset] if len(offset) else np.zeros(0, tx.U)
        by = np.argsort(prefix, kind="stable")
        self.prefix, start = np.unique(prefix[by], return_index=True)
        self.bounds = np.append(start, len(by))
        self.window, self.offset = by, offset[by]

    def find(self, w: tx.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence in the documents."""
        none = np.zeros(0, np.int64)
        if not len(self.prefix) or not len(hashes):
            return none, none
        slot = np.searchsorted(self.prefix, hashes)
        slot[slot == len(self.prefix)] = 0
        place = np.flatnonzero(self.prefix[slot] == hashes)
        slot = slot[place]
        n = self.bounds[slot + 1] - self.bounds[slot]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.bounds[slot], n)
        place, window = np.repeat(place, n), self.window[entry]
        begin, size = place - self.offset[entry], self.size[window]
        doc = np.searchsorted(w.first, place, side="right") - 1
        fits = (begin >= w.first[doc]) & (begin + size <= w.first[doc + 1])
        begin, window, size = begin[fits], window[fits], size[fits]
        same = tx.Rolling(hashes).of(begin, size) == self.value[window] if len(begin) else np.zeros(0, bool)
        begin, window, size = begin[same], window[same], size[same]
        verified = np.ones(len(begin), bool)
        for k in range(int(size.max(initial=0))):
            use = size > k
            verified[use] &= hashes[begin[use] + k] == self.words[self.begin[window[use]] + k]
        return begin[verified], window[verified]


def blocks(benchmark: DataFrame, window: int, limit: int) -> Iterator[Block]:
    """Blocks of at most `limit` bytes of item text (a longer item alone), read one block at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        if size and size + len(r["text"] or "") > limit:
            yield Block(ids, pa.array(texts, pa.string()), window)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"] or "")
    yield Block(ids, pa.array(texts, pa.string()), window)


def rarity(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of the vocabulary occurs in all documents: each task returns its counts of these words only."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        counts = np.zeros(len(own), np.int64)
        for batch in batches:
            for _, _, w in tx.words(batch.column(0), tx.ALNUM):
                h = w.hashes()
                slot = np.searchsorted(own, h)
                slot[slot == len(own)] = 0
                counts += np.bincount(slot[own[slot] == h], minlength=len(own))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["slot", "n"])

    total = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        for r in docs.select(F.col("text").cast("string")).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
            total[r["slot"]] = r["n"]
    return total


def covered(begin: np.ndarray, length: np.ndarray) -> int:
    """Words inside any of the windows."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(begin[order] + length[order])
    before = np.concatenate(([0], end[:-1]))
    return int(np.maximum(end - np.maximum(begin, before), 0).sum())


def _row(doc_id, n_words: int, begin: np.ndarray, length: np.ndarray, items: set[str | None]) -> tuple:
    n = covered(begin, length)
    return doc_id, n_words, n, len(items), hashlib.sha256(",".join(sorted(x for x in items if x is not None)).encode()).hexdigest(), n > 0


_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
_LISTS = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
_CLEAN = hashlib.sha256(b"").hexdigest()


def _meet(docs: DataFrame, block: Block, last: bool) -> DataFrame:
    """A block against all documents: adds its hits to those of the blocks before (columns 2 to 4, if there are any), or makes the final rows of all."""
    shipped = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            past = list(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)) if batch.num_columns > 2 else None
            for i, j, w in tx.words(batch.column(1), tx.ALNUM):
                begin, window = own.find(w, w.hashes())
                doc = np.searchsorted(w.first, begin, side="right") - 1
                order = np.argsort(doc, kind="stable")
                edge = np.searchsorted(doc[order], np.arange(j - i + 1))
                for d, n in enumerate(w.counts.tolist()):
                    hit = order[edge[d] : edge[d + 1]]
                    at, size = begin[hit] - w.first[d], own.size[window[hit]]
                    items = {x for k in window[hit].tolist() for x in own.items[k]}
                    if past and past[i + d][0]:
                        at, size = np.concatenate((past[i + d][0], at)).astype(np.int64), np.concatenate((past[i + d][1], size)).astype(np.int64)
                        items |= set(past[i + d][2])
                    if not last:
                        rows.append((at.tolist(), size.tolist(), list(items)))
                    elif len(at):
                        rows.append(_row(ids[i + d], n, at, size, items))
                    else:
                        rows.append((ids[i + d], n, 0, 0, _CLEAN, False))
            kinds = _KINDS if last else _LISTS
            made = [pa.array(list(c), k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(made, names=_NAMES) if last else pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["doc_id", "text", "begin", "length", "items"])

    return docs.mapInArrow(run, SCANNED if last else HITS)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document its words, the words hit, the items found, and whether it is contaminated."""
    docs = rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coming = blocks(benchmark, window, block_bytes)
    block, met = next(coming), 0
    while block is not None:
        block.order(rarity(docs, block.vocabulary))
        following = next(coming, None)
        rows, met = _meet(rows, block, following is None), met + 1
        if following is not None and met % CHAIN == 0:
            rows = scratch.keep(rows, "hits")
        block = following
    return rows


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any benchmark window, all columns as they are; one filter for each block, no shuffle."""
    names, out = docs.columns, docs
    at = names.index("text")
    for met, block in enumerate(blocks(benchmark, window, block_bytes)):
        block.order(rarity(docs, block.vocabulary))
        if met and met % CHAIN == 0:
            out = scratch.keep(out, "clean")
        out = out.mapInArrow(_filter(docs.sparkSession.sparkContext.broadcast(block), at), docs.schema)
    return out


def _filter(shipped, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            for i, _, w in tx.words(batch.column(at), tx.ALNUM):
                begin, _ = shipped.value.find(w, w.hashes())
                good[i + np.searchsorted(w.first, begin, side="right") - 1] = False
            yield batch.filter(pa.array(good))

    return run


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with b as (select item_id, {_WORDS} as w from benchmark),
d as (select doc_id, {_WORDS} as w from documents),
bw as (
  select distinct item_id, least(len(w), {WINDOW}) as size, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') as key
  from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) as s from b where len(w) > 0)
),
sizes as (select distinct size from bw),
dw as (
  select doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') as key
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as s from d, sizes where len(w) >= size)
),
hit as (select doc_id, item_id, s, dw.size from dw join bw using (key, size)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + size)) as p from hit) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct doc_id, item_id from hit) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join it using (doc_id)
"""
