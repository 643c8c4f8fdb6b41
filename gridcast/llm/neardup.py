"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct shingles of k words. Register i is the truncated, exponentially spaced minimum
clip(floor(1 - log_b(min h_i)), 0, q + 1), where h_i maps a shingle to an exponential variate of rate a. Registers merge by
maximum and agree with a probability near the Jaccard similarity, so `BANDS` bands of a few registers find candidates. A
candidate pair's similarity is estimated jointly by maximum likelihood from the counts of larger, smaller and equal
registers and the two known set sizes; pairs six standard deviations below the threshold go, and the rest are confirmed
on their full sets, best estimates first, unless they are connected already.

Scale. Documents with equal sets are one class from the start (a hash aggregation), so a thousand copies cost one. A class is
named by a 64-bit digest of its set. Classes that share a band bucket, directly or through others, are a candidate group; it is
found by joining each class to its bucket's smallest class, which costs n for a bucket of n. Only the documents that
stand for a grouped class are read again: a Bloom filter of bounded size goes along with the scan, and what
leaves the scan are shingle digests, not texts. A group is worked on in blocks of at most about `BLOCK` classes and
`BLOCK_SHINGLES` digests, each one task's work, with a few classes of the group (`BRIDGES`) in all of its blocks to connect them. In
groups of several blocks, classes outside the group's largest component then meet all blocks, in chunks, so no link
between components is lost; pairs inside a component are never looked at. Pairs exist only inside a task; rows are
classes and links of a spanning forest. Each document gets its class's result in a join in which the few classes that hold
many of the documents are sent around, so that no task meets all their copies. Tables in between are written to
spark.checkpoint.dir.

The registers of a band are the most for which a pair at the threshold is missed with a probability below one in a
million: eight for 0.85 (2e-7), six for 0.80 (5e-7).

Defined cases: a null or wordless text has an empty set, is linked with nothing and is its own component; with fewer than
k words the whole sequence is the one shingle; repeated rows give repeated rows; a doc_id with several texts counts as a document for
each of them; null doc_ids are left out by `groups` and stay in `deduplicate`; further columns are ignored by `groups` and
kept by `deduplicate`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm import scratch
from gridcast.llm import text as tx
from gridcast.llm.components import components

BANDS, MOST_ROWS = 48, 8
# SetSketch parameters: base, rate and largest register value (two bytes).
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
BLOCK, BRIDGES = 400, 40
#: Digests of a block (8 bytes each), and bits of the Bloom filter: some 16 for a grouped class, 32 MB at most.
BLOCK_SHINGLES, MOST_BITS = 4 << 20, 1 << 28
#: A class that holds more than one in SHARES of the documents is sent around: fewer than SHARES rows.
SHARES = 256

_rng = np.random.default_rng(20)
_FACTOR = _rng.integers(0, 1 << 63, BANDS * MOST_ROWS, np.uint64) * tx.U(2) + tx.U(1)
_SHIFT = _rng.integers(0, 1 << 63, BANDS * MOST_ROWS, np.uint64)

SKETCHED = "doc_id long, mark long, n_shingles long, class long, bands binary"


def band_rows(percent: int) -> int:
    """Registers of a band: the most for which a pair at the threshold is missed less than once in a million."""
    fits = [r for r in range(1, MOST_ROWS + 1) if (1 - (percent / 100) ** r) ** BANDS <= 1e-6]
    return max(fits, default=1)


def floor_of(percent: int, registers: int) -> float:
    t = percent / 100
    return max(0.0, t - 6 * math.sqrt(t * (1 - t) / registers) - 0.01)


def sketch(doc: np.ndarray, h: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Registers (document x register, uint16) of sets given as (document, shingle hash), sorted by document."""
    out = np.zeros((n_docs, registers), np.uint16)
    full, begin = np.unique(doc, return_index=True)
    if not len(full):
        return out
    least = np.empty((registers, len(full)), np.uint64)
    for i in range(registers):
        least[i] = np.minimum.reduceat(h * _FACTOR[i] + _SHIFT[i], begin)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    value = np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE))
    out[full] = np.clip(value, 0, TOP + 1).T
    return out


def estimate(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes, by a golden-section search."""
    larger, smaller = (one > two).sum(1), (one < two).sum(1)
    equal = one.shape[1] - larger - smaller
    u = n_one / (n_one + n_two)
    v = 1 - u
    log_b = np.log(BASE)

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log_b, 1e-12, 1 - 1e-12)

    def likelihood(j):
        a, b = p(u - v * j), p(v - u * j)
        return larger * np.log(a) + smaller * np.log(b) + equal * np.log(np.clip(1 - a - b, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(30):
        x, y = high - g * (high - low), low + g * (high - low)
        left = likelihood(x) > likelihood(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def set_digests(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, digest) of each document's set; 128 bits of sums of mixed hashes, mixed into 64."""
    n = np.bincount(doc, minlength=n_docs)
    full, begin = np.unique(doc, return_index=True)
    one, two = (np.zeros(n_docs, tx.U) for _ in range(2))
    if len(full):
        one[full], two[full] = (np.add.reduceat(tx.mix(h, salt), begin) for salt in (0x51, 0xA7))
    return n, tx.mix(one ^ tx.mix(two + n.astype(tx.U), 0x3C), 0x77)


def _sketches(k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Set size, class (a digest of the set) and the keys of its bands for every document."""
        for batch in batches:
            parts = []
            for i, j, w in tx.words(batch.column(2), tx.SPACED):
                doc, h = tx.shingles(w, k)
                parts.append((*set_digests(doc, h, j - i), band_keys(sketch(doc, h, j - i, BANDS * rows), rows)))
            n, digest, keys = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, tx.U), np.zeros((0, BANDS), tx.U))
            binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1) * BANDS * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(keys))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(tx.signed(digest)), binary], names=["doc_id", "mark", "n_shingles", "class", "bands"])

    return run


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """64 bits for each band, of its registers and its number."""
    part = registers.reshape(len(registers), BANDS, rows).astype(tx.U)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=tx.U), (len(registers), BANDS))
    for r in range(rows):
        key = tx.mix(key ^ part[:, :, r], 0xA24BAED4963EE407)
    return key


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets, data = batch.column(1).buffers()
        first = np.frombuffer(offsets, np.int32)[batch.column(1).offset] if batch.num_rows else 0
        keys = np.frombuffer(data, np.int64, batch.num_rows * BANDS, first) if batch.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "class"])


class Forest:
    """Links found so far among a task's classes."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.parent = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i


def linked(doc: np.ndarray, h: np.ndarray, n: int, labels: list[int], asks: np.ndarray, percent: int, rows: int) -> list[tuple[int, int]]:
    """Links that connect components: pairs of which at least one side asks, by estimate and then on the full sets."""
    registers = sketch(doc, h, n, BANDS * rows)
    floor, size = floor_of(percent, BANDS * rows), np.bincount(doc, minlength=n)
    edge = np.searchsorted(doc, np.arange(n + 1))
    forest, mark = Forest(labels), np.array(labels)
    found: list[tuple[np.ndarray, ...]] = []
    for i in np.flatnonzero(asks):
        # each pair of asking classes once, and sizes that allow the similarity
        other = np.flatnonzero((mark != mark[i]) & (~asks | (np.arange(n) > i)) & (np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * percent))
        equal = (registers[other] == registers[i]).mean(1)
        other = other[equal >= floor - 0.1]
        if len(other):
            e = estimate(registers[other], np.broadcast_to(registers[i], (len(other), registers.shape[1])), size[other].astype(float), np.full(len(other), float(size[i])))
            keep = e >= floor
            found.append((np.full(int(keep.sum()), i), other[keep], e[keep]))
    if not found:
        return []
    one, two, e = (np.concatenate(x) for x in zip(*found, strict=True))
    links = []
    for at in np.argsort(-e, kind="stable").tolist():
        a, b = int(one[at]), int(two[at])
        x, y = forest.root(a), forest.root(b)
        if x != y:
            common = len(np.intersect1d(h[edge[a] : edge[a + 1]], h[edge[b] : edge[b + 1]], assume_unique=True))
            if 100 * common >= percent * (size[a] + size[b] - common):
                forest.parent[y] = x
                links.append((a, b))
    return links


WORK = ["task", "class", "label", "asks", "shingles"]


def _confirm(percent: int, rows: int):
    def solve(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, labels = ([x for batch in part for x in batch.column(c).to_pylist()] for c in (1, 2))
        sets = [np.frombuffer(x.as_buffer(), tx.U) for batch in part for x in batch.column(4)]
        doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        asks = np.concatenate([batch.column(3).to_numpy(zero_copy_only=False) for batch in part])
        links = linked(doc, np.concatenate(sets), len(ids), labels, asks, percent, rows)
        return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in links], pa.int64()), pa.array([ids[b] for _, b in links], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task; a task's rows may begin in one batch and end in another."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
            if waiting and waiting[0].column(0)[0].as_py() != task[0]:
                yield solve(waiting)
                waiting = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                waiting.append(batch.slice(a, b - a))
                if b < len(task):
                    yield solve(waiting)
                    waiting = []
        if waiting:
            yield solve(waiting)

    return run


def confirmed(work: DataFrame, percent: int, rows: int) -> DataFrame:
    """Links (a, b) of all tasks. work: task (hash), class, label (its component so far), asks, shingles (sorted digests)."""
    parts = 2 * int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work of a row is large against its bytes
    ordered = work.select(*WORK).repartition(parts, "task").sortWithinPartitions("task", "class")
    return ordered.mapInArrow(_confirm(percent, rows), "a long, b long")


def _probes(hash_, bits: int) -> list:
    """Three bit numbers of a hash."""
    return [F.shiftrightunsigned(hash_, 18 * i).bitwiseAND(F.lit(bits - 1)) for i in range(3)]


def bloom(ids: DataFrame, n: int, column: str) -> np.ndarray:
    """A Bloom filter of a column of long values as 64-bit words; its size is bounded by `MOST_BITS`, beyond which it only lets more through."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    at = ids.select(F.explode(F.array(*_probes(F.xxhash64(column), bits))).alias("at"))
    one = F.expr("shiftleft(cast(1 as bigint), cast(at & 63 as int))")
    words = at.select(F.shiftright("at", 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _digests(k: int, shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Class and sorted shingle digests of the documents that the filter lets through; a class once for each batch."""
        words = shipped.value
        bits = np.uint64(len(words) * 64 - 1)
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            good = np.ones(len(h), bool)
            for i in range(3):
                at = (h >> np.uint64(18 * i)) & bits
                good &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            some = batch.filter(pa.array(good))
            for i, j, w in tx.words(some.column(2), tx.SPACED):
                doc, own = tx.shingles(w, k)
                n, digest = set_digests(doc, own, j - i)
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                _, first = np.unique(digest, return_index=True)
                keep = [x for x in first.tolist() if n[x]]
                sets = pa.array([own[edge[x] : edge[x + 1]].tobytes() for x in keep], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(1).slice(i, j - i).take(pa.array(keep, pa.int64())), pa.array(tx.signed(digest[keep])), sets], names=["doc_id", "class", "shingles"])

    return run


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id, mark (a hash of the text) for every document. Documents with equal sets have one class_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows, spark = band_rows(percent), docs.sparkSession
    scratch.small_batches(spark)
    every = scratch.keep(docs.select("doc_id", _mark(), "text").mapInArrow(_sketches(k, rows), SKETCHED), "sketches")
    full = every.where("n_shingles > 0")
    # equal sets have equal sizes and bands
    classes = full.groupBy("class").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    classes = scratch.keep(classes, "classes")
    bands = scratch.keep(classes.select("class", "bands").mapInArrow(_bands, "key long, class long"), "bands")
    buckets = bands.groupBy("key").agg(F.min("class").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    stars = bands.join(buckets, "key").where("class <> first").select(F.col("first").alias("a"), F.col("class").alias("b"))
    grouped = components(stars).select(F.col("id").alias("class"), F.col("component").alias("group"))

    placed = grouped.join(classes.select("class", "doc", "size"), "class")
    sizes = placed.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = scratch.keep(placed.join(sizes, "group").select("class", "doc", "group", "blocks"), "placed")
    shipped = spark.sparkContext.broadcast(bloom(placed, placed.count(), "doc"))
    read = docs.select(F.xxhash64("doc_id").alias("h"), "doc_id", "text").mapInArrow(_digests(k, shipped), "doc_id long, class long, shingles binary")
    met = read.join(placed, (read["class"] == placed["class"]) & (read["doc_id"] == placed["doc"]))
    sets = met.groupBy(placed["class"], "group", "blocks").agg(F.first("shingles").alias("shingles"))
    sets = scratch.keep(sets.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")), "sets")
    # a group's bridges: about BRIDGES classes by hash, in all of its blocks
    bridge = F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks") * F.lit(BLOCK)) < BRIDGES
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    spread = sets.withColumn("at", F.explode(F.when(bridge, everywhere).otherwise(F.array("block"))))
    work = spread.select(F.xxhash64("group", "at").alias("task"), "class", F.col("class").alias("label"), F.lit(True).alias("asks"), "shingles")
    links = scratch.keep(confirmed(work, percent, rows), "links")
    label = scratch.keep(components(links), "label")

    large = sets.where("blocks > 1").join(label.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("label", F.coalesce("component", "class")).drop("component")
    weight = large.groupBy("group", "label").agg(F.count("*").alias("n"))
    home = weight.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("home"), F.sum("n").alias("all"), F.max("n").alias("most")).where("most < all")
    strays = F.greatest(F.ceil((F.col("all") - F.col("most")) / BLOCK), F.ceil(F.col("blocks") * (F.col("all") - F.col("most")) / F.col("all")))
    open_ = scratch.keep(large.join(home, "group").withColumn("stray", F.col("label") != F.col("home")).withColumn("chunks", strays.cast("int")), "open")
    chunk = F.pmod(F.xxhash64("class", F.lit(2)), F.col("chunks")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    task = F.xxhash64("group", "at", "chunk", F.lit(3)).alias("task")
    # strays of a chunk meet the classes of a block: those that don't ask are the block's, those that ask the chunk's
    asking = open_.where("stray").withColumn("chunk", chunk).withColumn("at", each("blocks")).select(task, "class", "label", F.lit(True).alias("asks"), "shingles")
    asked = open_.withColumn("at", F.col("block")).withColumn("chunk", each("chunks")).select(task, "class", "label", F.lit(False).alias("asks"), "shingles")
    more = scratch.keep(confirmed(asking.unionByName(asked), percent, rows), "links")
    if more.limit(1).count():
        label = scratch.keep(components(links.unionByName(more)), "label")

    # a component's smallest document; a class without links is its own component
    names = classes.select("class", "doc", "copies").join(label.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    names = scratch.keep(names, "names")
    least = names.groupBy("component").agg(F.min("doc").alias("component_id"), F.count("*").alias("copies"))
    found = _met(names, least, "component", "class", ["component_id"]).select("class", "copies", F.col("doc").alias("class_id"), "component_id")
    full = _met(every.where("n_shingles > 0").drop("bands"), found, "class", "doc_id", ["class_id", "component_id"]).drop("class")
    empty = every.where("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "class_id", "mark")


def _mark():
    return F.xxhash64("text").alias("mark")


def _met(rows: DataFrame, found: DataFrame, key: str, deal: str, values: list[str]) -> DataFrame:
    """The rows with the values of their key. found: one row for each key, with `copies`, its number of rows. Keys of many rows are broadcast (fewer than `SHARES`), and their rows are dealt by `deal`."""
    found = scratch.keep(found, "found")
    most = found.agg(F.sum("copies")).first()[0] or 0
    hot = found.where(F.col("copies") > F.lit(most / SHARES)).select(key, F.struct(*values).alias("__hot"))
    x = rows.join(F.broadcast(hot), key, "left").withColumn("__key", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.xxhash64(deal, F.lit(5))))
    met = x.join(found.select(F.col(key).alias("__key"), F.struct(*values).alias("__rest")), "__key", "left").withColumn("__v", F.coalesce("__hot", "__rest"))
    return met.select(*rows.columns, *(F.col("__v")[v].alias(v) for v in values))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which one of each group stays: the one with the smallest doc_id (one row of equal rows). Columns stay as they are; rows without a doc_id stay.

    A doc_id with several texts counts as a document for each of them.
    """
    told = groups(docs, k, percent).groupBy("doc_id", "mark").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    told = scratch.keep(told.select("doc_id", "mark", "kept"), "told")
    text, row = (scratch.fresh(docs, n) for n in ("text_hash", "row"))
    rows = docs.where("doc_id is not null").withColumn(text, F.xxhash64(F.col("text").cast("string")))
    met = lambda t: (rows["doc_id"].cast("long") == t["doc_id"]) & (rows[text] == t["mark"])
    alone = rows.join(told, met(told), "left_anti").drop(text)
    repeated = told.where("kept")
    order = Window.partitionBy("doc_id", text).orderBy("text")
    once = rows.join(repeated, met(repeated), "left_semi").withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).drop(row, text)
    return alone.unionByName(once).unionByName(docs.where("doc_id is null"))


def query(spark, sf_dir: str) -> DataFrame:
    return groups(scratch.table(spark, sf_dir, "documents"), 3, 85).drop("mark")


SQL = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
),
s as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') as shingle
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)
),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.shingle = y.shingle and x.doc_id < y.doc_id group by all),
link as (select a, b from common join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
edge as (select a, b from link union all select b, a from link),
reach(id, other) as (select a, b from edge union select r.id, e.b from reach r join edge e on e.a = r.other),
low as (select id, least(id, min(other)) as component from reach group by id),
sets as (select d.doc_id, coalesce(md5(string_agg(shingle, chr(10) order by shingle)), d.doc_id::varchar) as key from d left join s using (doc_id) group by d.doc_id),
cls as (select doc_id, min(doc_id) over (partition by key) as class_id from sets)
select cls.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(component, cls.doc_id) as component_id, coalesce(component, cls.doc_id) = cls.doc_id as kept, class_id
from cls left join n using (doc_id) left join low on low.id = cls.doc_id
"""
