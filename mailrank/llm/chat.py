"""Chat formatting: whole conversations as one string with its loss mask, by columnar byte assembly.

Each turn is ``### role:text</turn>`` and a line end. Backslash, ``#``, ``<`` and ``/`` in texts,
and also ``:`` in roles, get a backslash in front, so neither mark is found in any text, and a
reader gets back exactly what was written. A batch is assembled at once: lengths of all segments, their
offsets, and the places every byte goes to, into one buffer.

Rows are ranged by conversation and turn, so one very long conversation is formatted by many
tasks; it comes out in several parts, ordered by ``(first_turn, part)``. The loss mask lists
byte ranges (``loss_starts``, ``loss_ends``) of what assistants say.

Nulls and ties: null texts and roles are empty; rows without ``conv_id`` are one conversation
with a null id; null turns come first; equal turns are ordered by role and text. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrank.llm.common import in_arrow, parts, ranges, slices, strings, table, utf8

OPEN, MIDDLE, CLOSE = b"### ", b":", b"</turn>\n"
ASSISTANT = b"assistant"
_BACKSLASH, _HASH, _LESS, _SLASH, _COLON = b"\\#</:"


def escaped(data: np.ndarray, off: np.ndarray, marks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Strings with a backslash in front of each of ``marks``."""
    marked = np.isin(data, np.array(marks, np.uint8))
    upto = np.concatenate([[0], np.cumsum(marked)])
    out = np.full(len(data) + int(upto[-1]), _BACKSLASH, np.uint8)
    out[np.arange(len(data)) + upto[1:]] = data
    return out, off + upto[off]


def assemble(segments: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row the segments one after the other; also where each segment of each row starts."""
    sizes = np.stack([np.diff(off) for _, off in segments], axis=1)
    ends = np.cumsum(sizes.ravel())
    starts = (ends - sizes.ravel()).reshape(n, len(segments))
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for k, (data, off) in enumerate(segments):
        out[ranges(starts[:, k], sizes[:, k])] = data[ranges(off[:-1], sizes[:, k])]
    return out, starts


def _fixed(mark: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(mark * n, np.uint8), np.arange(n + 1, dtype=np.int64) * len(mark)


def format_batch(batch: pa.RecordBatch, first_part: int) -> pa.RecordBatch:
    """Sorted turns ``conv_id, turn, role, text`` to one row for each conversation in the batch."""
    n = batch.num_rows
    role_data, role_off = utf8(batch.column(2))
    role = escaped(role_data, role_off, [_BACKSLASH, _HASH, _LESS, _SLASH, _COLON])
    text = escaped(*utf8(batch.column(3)), [_BACKSLASH, _HASH, _LESS, _SLASH])
    data, starts = assemble([_fixed(OPEN, n), role, _fixed(MIDDLE, n), text, _fixed(CLOSE, n)], n)

    conv = batch.column(0)
    ids, known = conv.fill_null(0).to_numpy(), conv.is_valid().to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.flatnonzero((np.diff(ids) != 0) | (np.diff(known.astype(np.int8)) != 0)) + 1])
    turns = np.diff(np.append(first, n))
    row_start = np.append(starts[:, 0], len(data))
    off = row_start[np.append(first, n)]

    says = np.flatnonzero(np.diff(role_off) == len(ASSISTANT))
    wanted = np.frombuffer(ASSISTANT, np.uint8)
    says = says[(role_data[role_off[says][:, None] + np.arange(len(ASSISTANT))] == wanted).all(axis=1)]
    base = np.repeat(off[:-1], turns)
    each = np.searchsorted(says, np.append(first, n)).astype(np.int32)
    masks = [pa.ListArray.from_arrays(pa.array(each), pa.array(starts[says, k] - base[says])) for k in (3, 4)]
    return pa.record_batch(
        [
            conv.take(pa.array(first)), batch.column(1).take(pa.array(first)), pa.array(first_part + first),
            pa.array(turns), strings(data, off, pa.string()), *masks,
        ],
        names=["conv_id", "first_turn", "part", "n_turns", "formatted", "loss_starts", "loss_ends"],
    )


FORMATTED = (
    "conv_id bigint, first_turn bigint, part bigint, n_turns bigint, formatted string, "
    "loss_starts array<bigint>, loss_ends array<bigint>"
)


def format_chats(turns: DataFrame) -> DataFrame:
    """``FORMATTED`` rows of ``conv_id, turn, role, text``."""
    rows = turns.select("conv_id", "turn", "role", "text")
    rows = rows.repartitionByRange(parts(turns.sparkSession), "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for whole in batches:
            for batch in slices(whole, 3):
                yield format_batch(batch, part)
                part += batch.num_rows

    return in_arrow(rows, run, FORMATTED)


def parse_batch(data: np.ndarray, off: np.ndarray):
    """Turns of formatted strings: the unescaped bytes, where roles and texts lie in them, turns of each
    string, and the place in the unescaped bytes for each byte of the formatted ones."""
    slash = data == _BACKSLASH
    # Escapes are the first, third, ... of a run of backslashes.
    at = np.arange(len(data))
    run_start = np.maximum.accumulate(np.where(slash & ~np.concatenate([[False], slash[:-1]]), at, 0)) if len(data) else at
    escape = slash & ((at - run_start) % 2 == 0)
    plain = np.concatenate([[True], ~escape[:-1]]) if len(data) else np.zeros(0, bool)
    place = np.concatenate([[0], np.cumsum(~escape)])
    close = np.flatnonzero((data == _LESS) & plain)
    count = np.diff(np.searchsorted(close, off))
    start = np.empty(len(close), np.int64)
    if len(close):
        start[1:] = close[:-1] + len(CLOSE)
        begin = np.cumsum(count) - count
        start[begin[count > 0]] = off[:-1][count > 0]
    colons = np.flatnonzero((data == _COLON) & plain)
    colon = colons[np.searchsorted(colons, start)] if len(close) else start
    return data[~escape], place[start + len(OPEN)], place[colon], place[colon + 1], place[close], count, place


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, from its parts in order: digests of turns and of the loss mask."""
    order = ["conv_id", "first_turn", "part"]
    rows = formatted.select(*order, "formatted", "loss_starts", "loss_ends")
    rows = rows.repartition(parts(formatted.sparkSession), "conv_id").sortWithinPartitions(*order)
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def chars(data) -> int:
        return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def row():
            turns, sha, said, loss, size = state
            return (now[0], turns, sha.hexdigest(), said, loss.hexdigest(), size)

        def flush():
            columns = zip(*out)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = [x.split()[0] for x in schema.split(", ")]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for whole in batches:
            for batch in slices(whole, 3):
                data, off = utf8(batch.column(3))
                text, role_a, role_b, text_a, text_b, count, place = parse_batch(data, off)
                held = memoryview(np.ascontiguousarray(text))
                starts, ends = batch.column(4), batch.column(5)
                mask_at = starts.offsets.to_numpy().tolist()
                a = starts.values.to_numpy(zero_copy_only=False)
                b = ends.values.to_numpy(zero_copy_only=False)
                bounds = zip(role_a.tolist(), role_b.tolist(), text_a.tolist(), text_b.tolist())
                for i, conv in enumerate(batch.column(0).to_pylist()):
                    if now != (conv,):
                        if now is not None:
                            out.append(row())
                        now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for w, x, y, z in itertools.islice(bounds, int(count[i])):
                        state[1].update(held[w:x])
                        state[1].update(b"\n")
                        state[1].update(held[y:z])
                        state[1].update(b"\n")
                    for x, y in zip(a[mask_at[i] : mask_at[i + 1]].tolist(), b[mask_at[i] : mask_at[i + 1]].tolist()):
                        said = held[place[off[i] + x] : place[off[i] + y]]
                        state[3].update(said)
                        state[2] += chars(said)
                    state[0] += int(count[i])
                    state[4] += chars(data[off[i] : off[i + 1]])
                if len(out) > 5000:
                    yield flush()
                    out = []
        if now is not None:
            out.append(row())
        if out:
            yield flush()

    return in_arrow(rows, run, schema)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    return read_back(format_chats(turns.unionByName(more)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(regexp_replace(role, '([\\#</:])', '\\\1', 'g')) + 1
           + length(regexp_replace(text, '([\\#</])', '\\\1', 'g')) + 8)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
