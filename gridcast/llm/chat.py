"""Chat formatting by columnar byte assembly.

A turn becomes `### role: text</turn>` and a line feed. Inside roles and texts a backslash becomes `\\\\`, `###` becomes `\\h`
and `</turn>` becomes `\\t`, so control strings of the template never come from a text and the output can be read back.
Every batch of turns is laid out at once: segment lengths, their cumulative offsets and gather indices are numpy
arrays, and headers and contents are copied into one preallocated buffer that Arrow then holds as strings.

Defined cases: a null role or text counts as empty; turns with equal numbers are ordered by role, then text; a null
turn comes first; rows with a null conv_id form one conversation of their own; an empty table gives no rows; further
columns are ignored. One conversation is one output string (below 2 GB) and is held by one task at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm import text as tx

HEAD, MIDDLE, END = b"### ", b": ", b"</turn>\n"
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
UNESCAPE = {"\\": "\\", "h": "###", "t": "</turn>", "c": ":"}
#: Bytes copied by one gather; a longer segment is copied as a slice.
GATHER_BYTES = 1 << 20

FORMATTED = "conv_id long, n_turns long, formatted string, loss_begin array<long>, loss_length array<long>"


def escape(values: pa.Array, table=ESCAPES) -> pa.Array:
    values = values.fill_null("") if values.null_count else values
    for old, new in table:
        values = pc.replace_substring(values, pattern=old, replacement=new)
    return values


def unescape(value: str) -> str:
    return re.sub(r"\\(.)", lambda m: UNESCAPE[m[1]], value) if "\\" in value else value


def assemble(source: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Copies the segments of `source`, in order, into one new buffer; returns it and where each segment lies in it."""
    at = np.concatenate(([0], np.cumsum(length)))
    out = np.empty(at[-1], np.uint8)
    for i, j in tx.ranges(at, GATHER_BYTES):
        if j == i + 1:
            out[at[i] : at[j]] = source[begin[i] : begin[i] + length[i]]
        else:
            index = np.arange(at[i], at[j]) + np.repeat(begin[i:j] - at[i:j], length[i:j])
            out[at[i] : at[j]] = source[index]
    return out, at


def layout(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All turns as one buffer, and the five segments of each turn in it."""
    role, role_at = tx.buffer(escape(roles, ROLE_ESCAPES))
    body, body_at = tx.buffer(escape(texts))
    fixed = np.frombuffer(HEAD + MIDDLE + END, np.uint8)
    source, n = np.concatenate((role, body, fixed)), len(roles)
    begin, length = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    base = len(role) + len(body)
    for k, (first, size) in enumerate(((base, len(HEAD)), (0, 0), (base + len(HEAD), len(MIDDLE)), (0, 0), (base + len(HEAD) + len(MIDDLE), len(END)))):
        begin[:, k], length[:, k] = first, size
    begin[:, 1], length[:, 1] = role_at[:-1], np.diff(role_at)
    begin[:, 3], length[:, 3] = body_at[:-1] + len(role), np.diff(body_at)
    return assemble(source, begin.ravel(), length.ravel())


def conversations(rows: pa.Table) -> pa.RecordBatch:
    """Whole conversations, whose turns stand together and in order, as one row each."""
    rows = rows.combine_chunks()
    column = lambda name: rows[name].combine_chunks()
    ids, roles, texts = column("conv_id"), column("role"), column("text")
    out, at = layout(roles, texts)
    key, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])))
    first = np.flatnonzero(new)
    turns = np.diff(np.concatenate((first, [len(ids)])))
    offsets = at[np.concatenate((first, [len(ids)])) * 5]
    chars = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    learn = pc.equal(roles, "assistant").fill_null(False).to_numpy(zero_copy_only=False)
    turn = np.flatnonzero(learn)
    conv = np.cumsum(new)[turn] - 1
    begin, end = chars[at[turn * 5 + 3]] - chars[offsets[conv]], chars[at[turn * 5 + 4]] - chars[offsets[conv]]
    spans = np.concatenate(([0], np.cumsum(np.bincount(conv, minlength=len(first))))).astype(np.int32)
    strings = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    lists = [pa.ListArray.from_arrays(pa.array(spans), pa.array(x.astype(np.int64))) for x in (begin, end - begin)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(turns.astype(np.int64)), strings, *lists], names=["conv_id", "n_turns", "formatted", "loss_begin", "loss_length"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted; the last conversation of a batch may go on in the next, so it waits."""
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        ids = batch.column(0)
        last = ids[len(ids) - 1]
        cut = len(ids)
        same = pc.is_null(ids) if not last.is_valid else pc.equal(ids, last).fill_null(False)
        cut = int(np.flatnonzero(~same.to_numpy(zero_copy_only=False))[-1]) + 1 if not pc.all(same).as_py() else 0
        if waiting and cut == 0 and waiting[0]["conv_id"][0] == last:
            waiting.append(rows)
            continue
        done = pa.concat_tables([*waiting, rows.slice(0, cut)])
        waiting = [rows.slice(cut)]
        if done.num_rows:
            yield conversations(done)
    if waiting:
        yield conversations(pa.concat_tables(waiting))


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: the formatted string and, in code points, the spans of assistant texts (the loss mask)."""
    turns = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Reads (role, text) of each turn back from a formatted conversation."""
    turns = []
    for piece in formatted.split("</turn>\n")[:-1]:
        role, _, body = piece[len(HEAD) :].partition(": ")
        turns.append((unescape(role), unescape(body)))
    return turns


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for conv, formatted, begins, lengths in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
            turns, seen = parse(formatted), hashlib.sha256()
            for role, body in turns:
                seen.update(f"{role}\n{body}\n".encode())
            loss = "".join(unescape(formatted[b : b + n]) for b, n in zip(begins, lengths, strict=True))
            for column, value in zip(out, (conv, len(turns), seen.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings hold, read back from them."""
    return formatted.mapInArrow(_digests, DIGESTS)


PROBE = "\\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    """All conversations and one more whose texts hold control strings and a backslash."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(probe)))


_ESC = r"replace(replace(replace({}, '\', '\\'), '###', '\h'), '</turn>', '\t')"
SQL = rf"""
with all_rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length('### ' || replace({_ESC.format("role")}, ':', '\c') || ': ' || {_ESC.format("text")} || '</turn>' || chr(10)))::bigint as formatted_chars
from all_rows group by conv_id
"""
