"""Substring deduplication with a log-structured index of window fingerprints.

A window is 20 consecutive words of one document. Every word that lies in a window whose word sequence starts earlier
as well is removed. Earlier means: in an earlier batch, or a smaller doc_id, or an earlier place of the same document.
A doc_id with several texts is a document for each of them (its versions, in the order of the texts' hashes).

Fingerprints. In each window the run of 8 words with the smallest hash is its anchor; neighbouring windows that share an
anchor are a span. Equal windows have equal anchors, so a window repeats only if its span's anchor repeats. A document of
n words has about n / 7 spans, each one row: anchor hash and span hash (128 bits together), doc_id, version, first window, windows.

Index. The distinct spans seen so far are kept in immutable runs, each a table bucketed and sorted by anchor hash. A new
batch is dealt by anchor hash into as many buckets once and then merge-joined with every run; the runs are read as they lie, without
an exchange:
  * a span that occurred before is a repeat with all its windows;
  * of the first occurrences, those whose anchor also occurs in another span are uncertain, in the batch and in the runs:
    their windows are verified one by one on the words of the texts (128 bits a window);
  * all other windows are new.
The batch's first occurrences become a run of level 0. More than `FANOUT` runs of a level are compacted into one of the next level and
dropped, so a span is rewritten once a level. The texts of a batch are a table bucketed by doc_id, so that
verification and removal meet them without an exchange as well. A manifest in the index's folder names all tables; another session
opens the index by its path, and a version of the manifest is there as a whole or not at all.

Scale. Repeats within one Arrow batch of documents are settled before the shuffle, so a passage that a third of all
documents share sends one row for each batch of documents, not one for each document. Texts are shuffled by doc_id once.
What one task still meets as a whole are the distinct spans of one anchor: a common line of eight words in ever other
surroundings gives a row for each document. They are sorted and merged, not held in memory.

Defined cases: null texts have no words; documents of fewer than 20 words keep all of them; equal rows count as one document,
and each is returned; the texts of one doc_id are documents of their own, each judged by its own windows; null doc_ids keep their text and take no part; ties can't occur (a place in a document is
unique); further columns are ignored by `digests` and kept by `clean`.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm import scratch
from gridcast.llm import text as tx

WINDOW, ANCHOR = 20, 8
#: Runs of a level that may stand side by side before they are compacted, and batches of one application.
FANOUT, BATCHES = 2, 4
#: Two batches, and another for each so many bytes of text, up to BATCHES.
BATCH_BYTES = 32 << 20
SPANS = "gram long, span long, doc_id long, version int, start int, n int"


def spans(w: tx.Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, span hash, document, first window, windows) of all spans; places count from the document's first word."""
    h = w.hashes()
    counts = w.counts
    full = np.maximum(counts - window + 1, 0)
    doc = np.repeat(np.arange(len(counts)), full)
    if not len(doc):
        return tuple(np.zeros(0, t) for t in (tx.U, tx.U, np.int64, np.int64, np.int64))
    at = w.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
    rolling = tx.Rolling(h)
    grams = rolling.of(np.arange(len(h) - anchor + 1), anchor, 1)
    least, place = grams[at], np.zeros(len(at), np.int64)
    for k in range(1, window - anchor + 1):
        other = grams[at + k]
        lower = other < least
        least = np.where(lower, other, least)
        place[lower] = k
    place += at
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    return least[first], rolling.of(at[first], n + window - 1, 2), doc[first], at[first] - w.first[doc[first]], n


def joined(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of documents with overlapping and touching ones joined."""
    if not len(doc):
        return doc, start, length
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + length)[order]
    slot = np.unique(doc, return_inverse=True)[1].astype(np.int64)
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(end + slot * wide)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + slot[1:] * wide > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - slot[last] * wide - start[first]


def slots(ids: np.ndarray, versions: np.ndarray) -> np.ndarray:
    """A number for each row, equal for equal (doc_id, version) and in their order."""
    order = np.lexsort((versions, ids))
    new = np.zeros(len(ids), np.int64)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (versions[order][1:] != versions[order][:-1])
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeats(row: np.ndarray, slot: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row, first window, windows) of joined intervals of documents, which equal slots tell."""
    own, first = np.unique(slot, return_index=True)
    at, start, n = joined(slot, start, n)
    return row[first][np.searchsorted(own, at)], start, n


def _spans(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First occurrences within the batch, and what repeats within it as joined intervals of windows (n below 0, random key)."""
        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            parts = []
            for i, _, w in tx.words(batch.column(1), tx.SPACED, lower=False):
                gram, span, doc, start, n = spans(w, window)
                parts.append((gram, span, doc + i, start, n))
            gram, span, row, start, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else spans(tx.split(np.zeros(0, np.uint8), np.zeros(1, np.int64), tx.SPACED, False), window)
            slot = slots(ids, versions)[row]
            order = np.lexsort((start, slot, span, gram))
            gram, span, row, slot, start, n = gram[order], span[order], row[order], slot[order], start[order], n[order]
            equal = np.zeros(len(gram), bool)
            equal[1:] = (gram[1:] == gram[:-1]) & (span[1:] == span[:-1])
            # an equal row is the same document, not a repeat of it
            same = equal.copy()
            same[1:] &= (slot[1:] == slot[:-1]) & (start[1:] == start[:-1])
            again = equal & ~same
            # copies of the first row are first, copies of a later row are repeats: both are left to one row
            keep, (rrow, rstart, rn) = ~equal, repeats(row[again], slot[again], start[again], n[again])
            doc, version, rdoc, rversion = ids[row], versions[row], ids[rrow], versions[rrow]
            columns = (
                np.concatenate((gram[keep], tx.mix(rdoc.astype(tx.U) * tx.U(31) + rstart.astype(tx.U), 7))).view(np.int64),
                np.concatenate((span[keep], np.zeros(len(rdoc), tx.U))).view(np.int64),
                np.concatenate((doc[keep], rdoc)),
                np.concatenate((version[keep], rversion)),
                np.concatenate((start[keep], rstart)).astype(np.int32),
                np.concatenate((n[keep], -rn)).astype(np.int32),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "span", "doc_id", "version", "start", "n"])

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of uncertain spans: first ones within the batch as rows (n = 1), repeats as joined intervals (n below 0)."""
        for batch in batches:
            ids, versions, old = batch.column(0).to_numpy(), batch.column(4).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            lists, begins, ns = batch.column(3), batch.column(3).flatten().field(0).to_numpy(), batch.column(3).flatten().field(1).to_numpy()
            edge = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))
            parts = []
            for i, j, w in tx.words(batch.column(1), tx.SPACED, lower=False):
                rolling = tx.Rolling(w.hashes())
                use = slice(edge[i], edge[j])
                n = ns[use].astype(np.int64)
                row = np.repeat(np.arange(i, j), np.diff(edge[i : j + 1]))
                start = np.repeat(begins[use].astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                at = w.first[row - i] + start
                parts.append((rolling.of(at, window, 3), rolling.of(at, window, 4), row, start))
            one, two, row, start = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, tx.U), np.zeros(0, tx.U), np.zeros(0, np.int64), np.zeros(0, np.int64))
            slot, past = slots(ids, versions)[row], old[row]
            order = np.lexsort((start, slot, ~past, two, one))
            one, two, row, slot, start, past = one[order], two[order], row[order], slot[order], start[order], past[order]
            equal = np.zeros(len(one), bool)
            equal[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            same = equal.copy()
            same[1:] &= (slot[1:] == slot[:-1]) & (start[1:] == start[:-1]) & (past[1:] == past[:-1])
            again = equal & ~same & ~past
            keep, (rrow, rstart, rn) = ~equal, repeats(row[again], slot[again], start[again], np.ones(int(again.sum()), np.int64))
            doc, version, rdoc, rversion = ids[row], versions[row], ids[rrow], versions[rrow]
            none = np.zeros(len(rdoc), np.int64)
            columns = (
                np.concatenate((one[keep], tx.mix(rdoc.astype(tx.U) * tx.U(31) + rstart.astype(tx.U), 9))).view(np.int64),
                np.concatenate((two[keep].view(np.int64), none)),
                np.concatenate((doc[keep], rdoc)),
                np.concatenate((version[keep], rversion)),
                np.concatenate((start[keep], rstart)).astype(np.int32),
                np.concatenate((np.ones(int(keep.sum()), np.int64), -rn)).astype(np.int32),
                np.concatenate((past[keep], none.astype(bool))),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["one", "two", "doc_id", "version", "start", "n", "past"])

    return run


class Run(NamedTuple):
    """One immutable table of the index."""

    kind: str  # spans, or texts of a batch
    table: str
    path: str
    level: int  # of texts: the part of the table that is the batch


class FingerprintIndex:
    """Runs of spans of all batches so far and the texts of these batches, with a manifest that another session can open.

    path: the index's folder, below the shared one; None makes a new one. An existing index there is opened.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, buckets: int | None = None, path: str | None = None):
        self.spark, self.window = spark, window
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path, self.version, self.runs = path or scratch.folder(spark, "index"), 0, []
        if path:
            self._open()

    # ---- manifest ----

    def _open(self) -> None:
        try:
            state = self.spark.read.parquet(f"{self.path}/manifest")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return
        rows = state.where(F.col("version") == state.agg(F.max("version")).first()[0]).collect()  # one row for each run
        self.version, self.buckets, self.window = rows[0]["version"], rows[0]["buckets"], rows[0]["window"]
        for r in rows:
            run = Run(r["kind"], r["table"], r["path"], r["level"])
            if not self.spark.catalog.tableExists(run.table):
                by, part = ("doc_id", "__part") if run.kind == "texts" else ("gram", "kind")
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(run.path).schema)
                self.spark.sql(f"create table {run.table} ({columns}) using parquet partitioned by ({part}) clustered by ({by}) into {self.buckets} buckets location '{run.path}'")
                self.spark.catalog.recoverPartitions(run.table)
            self.runs.append(run)

    def _commit(self) -> None:
        """The state as a new version: there as a whole once its job is committed, and not before."""
        self.version += 1
        rows = [(self.version, self.buckets, self.window, *r) for r in self.runs]
        self.spark.createDataFrame(rows, "version int, buckets int, window int, kind string, table string, path string, level int").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _write(self, rows: DataFrame, kind: str, level: int = 0) -> Run:
        """An immutable table: spans bucketed and sorted by anchor hash with one folder for each kind of row, texts bucketed by doc_id."""
        name = f"{kind}_{uuid.uuid4().hex[:12]}"
        run = Run(kind, name, f"{self.path}/{name}", level)
        scratch.named(name)
        out = rows.write.option("path", run.path)
        if kind == "texts":
            out.bucketBy(self.buckets, "doc_id").partitionBy("__part").saveAsTable(name)
        else:
            out.bucketBy(self.buckets, "gram").sortBy("gram", "span").partitionBy("kind").saveAsTable(name)
        return run

    def _read(self, run: Run, *kinds: str) -> DataFrame:
        return self.spark.table(run.table).where(F.col("kind").isin(*kinds))

    def _spans_of(self, run: Run) -> DataFrame:
        return self._read(run, "first", "uncertain").select("gram", "span", "doc_id", "version", "start", "n")

    def history(self) -> list[DataFrame]:
        return [self._spans_of(r) for r in self.runs if r.kind == "spans"]

    def compact(self, level: int) -> None:
        """Merges a level's runs into one of the next level and drops them; runs share no span, so nothing else changes."""
        old = [r for r in self.runs if r.kind == "spans" and r.level == level]
        whole = reduce(DataFrame.unionByName, map(self._spans_of, old)).repartition(self.buckets, "gram").withColumn("kind", F.lit("first"))
        made = self._write(whole, "spans", level + 1)
        self.runs = [r for r in self.runs if r not in old] + [made]
        self._commit()
        for r in old:
            self._drop(r)

    def _drop(self, run: Run) -> None:
        self.spark.sql(f"drop table {run.table}")
        scratch.remove(self.spark, run.path)

    # ---- a batch ----

    def store(self, docs: DataFrame, part=None) -> list[Run]:
        """Writes documents (all their columns, doc_id as long, and their version) bucketed by doc_id, as one batch or as those that the column `part` numbers."""
        parts = [0] if part is None else list(range(part[1]))
        rows = docs if "__version" in docs.columns else versioned(docs, sizes(docs))
        rows = rows.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("__part", F.lit(0) if part is None else part[0])
        made = self._write(rows.repartition(self.buckets, "doc_id"), "texts")
        return [made._replace(level=i) for i in parts]

    def batch(self, run: Run) -> DataFrame:
        """The stored documents of a batch."""
        return self.spark.table(run.table).where(F.col("__part") == run.level).drop("__part")

    def add(self, batch: DataFrame | Run, remember: bool = True) -> DataFrame:
        """Intervals of windows (doc_id, start, n) of the batch that repeat; then the batch belongs to the index.

        batch: documents, or what `store` made of them. remember=False is for the last batch: its first occurrences aren't written.
        """
        made = batch if isinstance(batch, Run) else self.store(batch)[0]
        text = lambda run: self.batch(run).select("doc_id", F.col("text").cast("string").alias("text"), F.col("__version").alias("version"))
        texts = text(made)
        own = self._settled(texts)
        marked = self._merged(own, remember)
        asked = self.met(texts, self._read(marked, "uncertain"), "inner").withColumn("past", F.lit(False))
        past = self._old(marked)
        for run in self.runs if past is not None else ():
            if run.kind == "texts":
                asked = asked.unionByName(self.met(text(run), past, "inner").withColumn("past", F.lit(True)))
        asked = asked.select("doc_id", "text", "past", "places", "version")
        found = asked.mapInArrow(_windows(self.window), "one long, two long, doc_id long, version int, start int, n int, past boolean")
        order = Window.partitionBy("one", "two").orderBy(F.desc("past"), "doc_id", "version", "start")
        first = F.first(F.struct("past", "doc_id", "version", "start")).over(order)
        later = found.withColumn("f", first).where("n < 0 or (not past and (f.past or f.doc_id <> doc_id or f.version <> version or f.start <> start))")
        place = ["doc_id", "version", "start", F.abs("n").alias("n")]
        repeats = scratch.keep(self._read(marked, "repeat").select(*place).unionByName(later.select(*place)), "repeats")
        self._drop(own)
        if not remember:
            self._drop(marked)
            return repeats
        self.runs += [marked, made]
        self._commit()
        level = 0
        while sum(r.kind == "spans" and r.level == level for r in self.runs) > FANOUT:
            self.compact(level)
            level += 1
        return repeats

    def met(self, texts: DataFrame, places: DataFrame, how: str) -> DataFrame:
        """Stored texts (doc_id, version, ...) with the places of their version. Only doc_id is a join key: the texts are bucketed by it and aren't exchanged."""
        own = places.repartition(self.buckets, "doc_id").groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "n")).alias("places"))
        own = own.select(F.col("doc_id").alias("__doc"), F.col("version").alias("__of"), "places")
        return texts.join(own, (texts["doc_id"] == own["__doc"]) & (texts["version"] - own["__of"] == 0), how).drop("__doc", "__of")

    def forget(self) -> None:
        """Drops all runs of spans; the stored documents stay."""
        for run in self.runs:
            if run.kind == "spans":
                self._drop(run)
        self.runs = []

    def _settled(self, texts: DataFrame) -> Run:
        """The batch's spans, dealt by anchor hash once: first occurrences within the batch, and repeats within it."""
        rows = texts.mapInArrow(_spans(self.window), SPANS).repartition(self.buckets, "gram")
        inside = Window.partitionBy("gram", "span").orderBy("doc_id", "version", "start")
        before = lambda c: F.lag(c).over(inside)
        same = (before("doc_id") == F.col("doc_id")) & (before("version") == F.col("version")) & (before("start") == F.col("start"))
        kind = F.when(F.col("n") < 0, "repeat").when(F.row_number().over(inside) == 1, "first").when(same, "gone").otherwise("repeat")
        return self._write(rows.withColumn("kind", kind).where("kind <> 'gone'").select("gram", "span", "doc_id", "version", "start", "n", "kind"), "spans")

    def _merged(self, batch: Run, remember: bool) -> Run:
        """The batch after a merge with all runs: repeats, uncertain and first spans. All sides are bucketed by anchor hash, so none is exchanged."""
        rows = self.spark.table(batch.table)
        first = rows.where("kind = 'first'").drop("kind")
        bounds = lambda df, i: df.groupBy("gram").agg(F.min("span").alias(f"low{i}"), F.max("span").alias(f"high{i}"))
        runs = self.history()
        out = first.join(bounds(first, 0), "gram")
        for i, run in enumerate(runs, 1):
            out = out.join(bounds(run, i), "gram", "left").join(run.select("gram", "span", F.lit(True).alias(f"met{i}")), ["gram", "span"], "left")
        numbers = range(1, len(runs) + 1)
        met = reduce(lambda a, b: a | b, (F.col(f"met{i}").isNotNull() for i in numbers), F.lit(False))
        least = F.least(F.col("low0"), F.col("low0"), *(F.col(f"low{i}") for i in numbers))
        most = F.greatest(F.col("high0"), F.col("high0"), *(F.col(f"high{i}") for i in numbers))
        out = out.withColumn("kind", F.when(met, "repeat").when(least < most, "uncertain").otherwise("first"))
        columns = ["gram", "span", "doc_id", "version", "start", "n", "kind"]
        wanted = out.select(*columns).unionByName(rows.where("kind = 'repeat'").select(*columns))
        with _cluster_keys(self.spark):
            return self._write(wanted if remember else wanted.where("kind <> 'first'"), "spans")

    def _old(self, marked: Run) -> DataFrame | None:
        """Spans of earlier batches whose anchor is uncertain in this one."""
        grams = self._read(marked, "uncertain").select("gram").distinct()
        found = [run.join(grams, "gram", "left_semi") for run in self.history()]
        return scratch.keep(reduce(DataFrame.unionByName, found), "old") if found else None


@contextlib.contextmanager
def _cluster_keys(spark: SparkSession):
    """Lets tables that are bucketed by one join key meet on two keys as they lie."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _removed(n_words: int, places: list[dict] | None, window: int) -> np.ndarray:
    """Which words lie in a repeated window."""
    mark = np.zeros(n_words + 1, np.int64)
    for p in places or ():
        mark[min(n_words, p["start"])] += 1
        mark[min(n_words, p["start"] + p["n"] + window - 1)] -= 1
    return np.cumsum(mark[:-1]) > 0


def keep(text: str, places: list[dict] | None, window: int = WINDOW) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by one space)."""
    words = text.encode().split()
    if not places:
        return len(words), 0, b" ".join(words)
    gone = _removed(len(words), places, window)
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def sizes(docs: DataFrame) -> DataFrame:
    """For each doc_id the least and greatest hash of its texts (unequal, if it has several), and its bytes of text."""
    text = F.col("text").cast("string")
    per = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return scratch.keep(per.agg(F.min(F.xxhash64(text)).alias("low"), F.max(F.xxhash64(text)).alias("high"), F.sum(F.coalesce(F.octet_length(text), F.lit(0))).alias("bytes")), "sizes")


def versioned(docs: DataFrame, per: DataFrame) -> DataFrame:
    """The documents with the column __version: 0, and for a doc_id with several texts the rank of the text's hash. per: their `sizes`."""
    several = per.where("low < high").select(F.col("doc_id").alias("__id"))
    if not several.limit(1).count():
        return docs.withColumn("__version", F.lit(0))
    docs = docs.withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    own = docs.join(several, F.col("doc_id").cast("long") == F.col("__id")).select("__id", "__hash").distinct()
    ranks = own.select(F.col("__id"), F.col("__hash").alias("__of"), (F.row_number().over(Window.partitionBy("__id").orderBy("__hash")) - 1).alias("__rank"))
    met = docs.join(ranks, (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__hash") == F.col("__of")), "left")
    return met.withColumn("__version", F.coalesce("__rank", F.lit(0))).drop("__id", "__hash", "__of", "__rank")


def numbered(docs: DataFrame, n: int):
    """(number of a document's batch, batches): n batches of ascending doc_id, about equal in number."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)])).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    return sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int"), len(cuts) + 1


def removals(docs: DataFrame, n_batches: int | None = None, window: int = WINDOW) -> list[DataFrame]:
    """The documents of each batch in turn, as stored, with the column places: the intervals to remove. Null doc_ids are in none. n_batches: None for as many as the bytes of text ask for."""
    scratch.small_batches(docs.sparkSession)
    index, out, per = FingerprintIndex(docs.sparkSession, window), [], sizes(docs)
    n = n_batches or min(BATCHES, 2 + (per.agg(F.sum("bytes")).first()[0] or 0) // BATCH_BYTES)
    runs = index.store(versioned(docs, per), numbered(per, n))
    for i, run in enumerate(runs):
        places = index.add(run, remember=i + 1 < len(runs))
        out.append(index.met(index.batch(run).withColumnRenamed("__version", "version"), places, "left").drop("version"))
    index.forget()
    return out


def _digests(window: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = [keep(t or "", p, window) for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def digests(docs: DataFrame, n_batches: int | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.where("doc_id is null").withColumn("places", F.lit(None).cast("array<struct<start:int,n:int>>"))
    for part in removals(docs, n_batches, window):
        out = out.unionByName(part.select("doc_id", "text", "places"))
    return out.mapInArrow(_digests(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, n_batches: int | None = None, window: int = WINDOW) -> DataFrame:
    """The documents with repeated passages taken out of text; a text that loses nothing stays as it is, a changed one has its words joined by one space. An integer column n_chars follows the text."""
    schema = docs.schema
    names = schema.names
    # further columns go under names that can't clash with those of the index
    inner = [n if n in ("doc_id", "text") else f"c{i}" for i, n in enumerate(names)]
    docs = docs.select(*(F.col(f"`{n}`").alias(m) for n, m in zip(names, inner, strict=True)))
    out = docs.where("doc_id is null").withColumn("places", F.lit(None).cast("array<struct<start:int,n:int>>"))
    for part in removals(docs, n_batches, window):
        out = out.unionByName(part.withColumn("doc_id", F.col("doc_id").cast(schema["doc_id"].dataType)).select(*inner, "places"))
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names and isinstance(schema["n_chars"].dataType, T.LongType) else None

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts, places = batch.column(at), batch.column(len(names)).to_pylist()
            columns = list(batch.columns[: len(names)])
            hit = [i for i, p in enumerate(places) if p]
            if hit:
                values = texts.to_pylist()
                for i in hit:
                    values[i] = keep(values[i] or "", places[i], window)[2].decode()
                columns[at] = pa.array(values, texts.type)
                if chars is not None:
                    n = columns[chars].to_pylist()
                    for i in hit:
                        n[i] = len(values[i])
                    columns[chars] = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return out.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(scratch.table(spark, sf_dir, "documents"))


SQL = rf"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
),
win as (
  select doc_id, s, array_to_string(w[s:s + {WINDOW - 1}], ' ') as key
  from (select doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) as s from d where len(w) >= {WINDOW})
),
rep as (select doc_id, s from win qualify row_number() over (partition by key order by doc_id, s) > 1),
gone as (select distinct doc_id, unnest(range(s, s + {WINDOW})) as p from rep),
words as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from d),
kept as (select words.doc_id, string_agg(word, ' ' order by words.p) as txt, count(*) as n from words left join gone using (doc_id, p) where gone.p is null group by words.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.txt, '')) as kept_sha256
from d left join kept using (doc_id)
"""
