"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list, decoding by concatenation.

The vocabulary file is a parameter and is read on the workers. A special token's string in a text is that token, as in
the tokenizers library; the rest is cut by the published pattern and each piece is merged on its own. Pieces repeat,
so a worker keeps the ids of the latest ones, at most `CACHE_PIECES`.

Defined cases: a null text is empty and gives no tokens and an empty decoded text; repeated rows give repeated rows; a
piece of any length is encoded whole (the queue makes that n log n); further columns are kept by `encode` under their
own names except `ids` and `n_tokens`, which are replaced, and by `decode` except `decoded`.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_PIECES = 200_000
CACHE_CHARS = 48
VOCABULARY = "byte_bpe_50k.json"
#: White space as Unicode has it; the pattern's \s in the library doesn't hold the four separators U+001C to U+001F.
WHITE = r"\p{White_Space}"
CHANGES = ((r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]"), (r"\s+(?!\S)|\s+", rf"{WHITE}+(?!{WHITE.replace('p', 'P', 1)})|{WHITE}+"))


def pieces(pattern: str) -> str:
    """The published pattern with the library's white space."""
    for old, new in CHANGES:
        if pattern.count(old) != 1:
            raise ValueError(f"the pattern has changed: {old} isn't in {pattern}")
        pattern = pattern.replace(old, new)
    return pattern


PIECES = pieces(public_tokenizers.PATTERN)


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell a byte as itself if it is printable in Latin-1, else as the next letter from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.strings[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. The queue holds (rank, position, pair); an entry whose pair is no longer there is stale."""
        symbols = [self.byte_id[b] for b in piece]
        n, merges = len(symbols), self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if found := merges.get((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = made, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if found := merges.get((made, symbols[k])):
                    heapq.heappush(queue, (found[0], i, made, symbols[k], found[1]))
            h = left[i]
            if h >= 0 and (found := merges.get((symbols[h], made))):
                heapq.heappush(queue, (found[0], h, symbols[h], made, found[1]))
        return [s for s in symbols if s >= 0]

    def piece(self, piece: str) -> bytes:
        ids = np.asarray(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            self._plain(text[at : m.start()], out)
            out.append(np.asarray([self.special[m[0]]], "<u4").tobytes())
            at = m.end()
        self._plain(text[at:] if at else text, out)
        return b"".join(out)

    def _plain(self, text: str, out: list[bytes]) -> None:
        known = self.cache.get
        for p in self.pieces.findall(text):
            out.append(known(p) or self.piece(p))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker."""
    return Codec(path)


def _path(path: str | None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Adds ids (array of int) and n_tokens to every document, the text included."""
    path = _path(path)
    docs = docs.drop("ids", "n_tokens")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            raw = [c.encode(x.as_py() or "") for x in batch.column(text)]
            n = np.array([len(x) // 4 for x in raw], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(n)], names=[*batch.schema.names, "ids", "n_tokens"])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """Adds decoded, the text of the ids, special tokens included; null ids give an empty text."""
    path = _path(path)
    tokens = tokens.drop("decoded")
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(x.as_py() or []) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, schema)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text in one pass; ids (unless asked for) and texts leave the worker as digests only."""
    path = _path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            raws, ids, texts = [], [], []
            for x in batch.column(1):
                raw = c.encode(x.as_py() or "")
                raws.append(raw)
                ids.append(hashlib.sha256(raw).hexdigest())
                texts.append(hashlib.sha256(c.decode(np.frombuffer(raw, "<u4").tolist()).encode()).hexdigest())
            n = np.array([len(x) // 4 for x in raws], np.int64)
            columns = [batch.column(0), pa.array(n), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.frombuffer(b"".join(raws), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGESTS + ", ids array<int>" * with_ids)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
