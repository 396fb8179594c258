"""Byte-level BPE over rank files: encode and decode.

Texts are cut into distinct words first, the pattern runs over those, and each distinct
pre-token is looked up in two tiers. A minimal perfect hash over the vocabulary (one slot for
each entry, built once on the driver; a vocabulary is a file of bounded size) resolves
pre-tokens that are entries themselves; the bytes are compared, so no foreign pre-token is
taken for an entry. All others are merged by a heap of (rank, place) over a linked list of
their bytes, which stays near-linear for one very long pre-token.

Nulls and ties: a null text is an empty one and has no ids; repeated rows give repeated rows;
an empty table gives none. Bytes that are not UTF-8 do not occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from mailrank.llm.common import by_arrow, chunks, in_arrow, ranges, received, sent, slices, table, utf8

CACHED_MERGES = 200_000  # merged pre-tokens one task keeps
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries by rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def hashes(data: np.ndarray, off: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit hash for each byte string: the sum of its bytes times a mix of their places."""
    n = np.diff(off)
    place = (np.arange(len(data)) - np.repeat(off[:-1], n)).astype(np.uint64)
    each = (data.astype(np.uint64) + np.uint64(1)) * _scramble((place + np.uint64(seed)) * _MULTIPLY | np.uint64(1))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
    return _scramble(upto[off[1:]] - upto[off[:-1]] + n.astype(np.uint64))


class PerfectHash:
    """Minimal perfect hash by displacement: keys share buckets of about four, and each bucket,
    fullest first, gets the first number that sends all its keys to free slots."""

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.buckets = max(1, self.size // 4)
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
        data = np.frombuffer(b"".join(keys), np.uint8)
        for self.seed in range(100):
            h = hashes(data, ends, self.seed)
            if len(np.unique(h)) == self.size:
                break
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.uint64)
        slot_of = np.full(self.size, -1, np.int64)
        taken = np.zeros(self.size, bool)
        for b in np.argsort(-np.diff(first), kind="stable").tolist():
            own = order[first[b] : first[b + 1]]
            if not len(own):
                break
            for d in itertools.count(0, 64):
                tries = np.arange(d, d + 64, dtype=np.uint64)
                slots = (_scramble(h[own][None, :] + tries[:, None] * _MULTIPLY) % np.uint64(self.size)).astype(np.int64)
                free = ~taken[slots].any(axis=1)
                if len(own) > 1:
                    free &= (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                good = np.flatnonzero(free)
                if len(good):
                    self.shift[b] = tries[good[0]]
                    taken[slots[good[0]]] = True
                    slot_of[slots[good[0]]] = own
                    break
        self.key = slot_of
        self.keys = pa.array([keys[i] for i in slot_of], pa.binary())

    def find(self, asked: pa.Array) -> np.ndarray:
        """Number of the key equal to each byte string, or -1."""
        if not len(asked) or not self.size:
            return np.full(len(asked), -1, np.int64)
        data, off = utf8(asked)
        h = hashes(data, off, self.seed)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = (_scramble(h + shift * _MULTIPLY) % np.uint64(self.size)).astype(np.int64)
        held, at = utf8(self.keys)
        n = np.diff(off)
        same = np.diff(at)[slot] == n
        pick = np.flatnonzero(same & (n > 0))
        differ = data[ranges(off[pick], n[pick])] != held[ranges(at[slot[pick]], n[pick])]
        upto = np.concatenate([[0], np.cumsum(differ)])
        ends = np.cumsum(n[pick])
        same[pick] = upto[ends] == upto[ends - n[pick]]
        return np.where(same, self.key[slot], -1)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always merge the adjacent pair of lowest rank, leftmost first."""
    n = len(piece)
    part = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        left = part[i]
        j = after[i]
        if not left or j >= n or ranks.get(left + part[j]) != rank:
            continue
        part[i] = both = left + part[j]
        part[j] = b""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(both + part[k])) is not None:
                heapq.heappush(heap, (r, i))
        p = before[i]
        if p >= 0 and (r := ranks.get(part[p] + both)) is not None:
            heapq.heappush(heap, (r, p))
    return [ranks[x] for x in part if x]


class Bpe:
    """The vocabulary with both tiers; sent to the tasks."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.hash = PerfectHash(self.tokens)
        self.pattern = pattern

    def encoder(self) -> _Encoder:
        return _Encoder(self)


class _Encoder:
    """What one task needs to encode."""

    def __init__(self, bpe: Bpe):
        self.find = bpe.hash.find
        self.ranks = {t: i for i, t in enumerate(bpe.tokens)}
        self.pattern = regex.compile(bpe.pattern)
        self.merged: dict[bytes, bytes] = {}

    def pre_tokens(self, distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pre-tokens of distinct pieces of text, and how many each piece has.

        Pieces that start with a space and end visibly run through the pattern as one text.
        """
        data, off = utf8(distinct)
        n = len(distinct)
        ends = data[off[1:] - 1]
        safe = (data[off[:-1]] == 32) & (ends > 32) & (ends < 127)
        runs = [b"".join(distinct.filter(pa.array(safe)).to_pylist())] + distinct.filter(pa.array(~safe)).to_pylist()
        found = [self.pattern.findall(x.decode()) for x in runs]
        flat = pa.array([t for x in found for t in x], pa.string()).cast(pa.binary())
        count = np.zeros(n, np.int64)
        own = utf8(flat[: len(found[0])])[1]
        cuts = np.searchsorted(own, np.concatenate([[0], np.cumsum(np.diff(off)[safe])]))
        count[safe] = np.diff(cuts)
        count[~safe] = list(map(len, found[1:]))
        # Back into the order of the pieces.
        start = np.zeros(n, np.int64)
        start[safe] = cuts[:-1]
        start[~safe] = len(found[0]) + np.cumsum(count[~safe]) - count[~safe]
        return flat.take(pa.array(ranges(start, count))), count

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts and how many each text has."""
        distinct, codes, per_text = chunks(column)
        if not len(distinct):
            return np.zeros(0, np.int32), np.zeros(len(column), np.int64)
        tokens, count = self.pre_tokens(distinct)
        tokens = tokens.dictionary_encode()
        asked = tokens.dictionary
        rank = self.find(asked)
        held = rank.astype(np.int32)
        sizes = np.ones(len(asked), np.int64)
        missed = np.flatnonzero(rank < 0)
        more = [self.slow(x) for x in asked.take(pa.array(missed)).to_pylist()]
        sizes[missed] = np.fromiter(map(len, more), np.int64, len(more)) // 4
        flat = np.empty(int(sizes.sum()), np.int32)
        at = np.cumsum(sizes) - sizes
        flat[at[rank >= 0]] = held[rank >= 0]
        flat[ranges(at[missed], sizes[missed])] = np.frombuffer(b"".join(more), np.int32)
        # Ids of each distinct piece, then of each text.
        order = tokens.indices.to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(sizes[order])])
        piece_ids = flat[ranges(at[order], sizes[order])]
        ends = np.cumsum(count)
        piece_at, piece_n = upto[ends - count], upto[ends] - upto[ends - count]
        each = piece_n[codes]
        last = np.cumsum(per_text)
        total = np.concatenate([[0], np.cumsum(each)])
        return piece_ids[ranges(piece_at[codes], each)], total[last] - total[last - per_text]

    def slow(self, piece: bytes) -> bytes:
        got = self.merged.get(piece)
        if got is None:
            got = np.array(merge(piece, self.ranks), np.int32).tobytes()
            if len(self.merged) < CACHED_MERGES:
                self.merged[piece] = got
        return got


def encode(docs: DataFrame, bpe: Bpe, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the text's token ids (a column of that name is replaced)."""
    model = sent(docs.sparkSession, bpe)
    kept = docs.drop("ids")
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = received(model).encoder()
        for whole in batches:
            for batch in slices(whole, at):
                ids, n = encoder.ids(batch.column(at))
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.record_batch([*batch.columns, lists], names=[*batch.schema.names, "ids"])

    return in_arrow(kept, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", ids array<int>")


def decode(ids: np.ndarray, n: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and their offsets."""
    data, at = utf8(vocabulary.take(pa.array(ids)))
    return data, at[np.concatenate([[0], np.cumsum(n)])]


def digests(encoded: DataFrame, bpe: Bpe) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded rows; the bytes come from the ids."""
    tokens = encoded.sparkSession.sparkContext.broadcast(bpe.tokens)

    def make():
        vocabulary = pa.array(tokens.value, pa.binary())
        decimal = pa.array([b"%d," % i for i in range(len(vocabulary))], pa.binary())

        def sha(data: np.ndarray, off: np.ndarray, cut: int) -> list[str]:
            held = memoryview(np.ascontiguousarray(data))
            return [hashlib.sha256(held[a : max(a, b - cut)]).hexdigest() for a, b in itertools.pairwise(off.tolist())]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            n = np.diff(ends).astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            written, shown = sha(*decode(ids, n, decimal), 1), sha(*decode(ids, n, vocabulary), 0)
            return pa.record_batch(
                [batch.column(0), pa.array(n), pa.array(written, pa.string()), pa.array(shown, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return step

    rows = encoded.select("doc_id", "ids")
    return by_arrow(rows, make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    bpe = Bpe(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, bpe), bpe)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``ids``, ``n_tokens`` and whether the ids decode to the text (``round_trip``)."""
    import public_tokenizers as tokenizers

    bpe = Bpe(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    encoded = encode(docs, bpe)
    tokens = spark.sparkContext.broadcast(bpe.tokens)
    kept = [c for c in encoded.columns if c not in ("n_tokens", "round_trip")]
    rows = encoded.select(*kept)
    at, ids_at = kept.index("text"), kept.index("ids")

    def make():
        vocabulary = pa.array(tokens.value, pa.binary())

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(ids_at)
            ends = lists.offsets.to_numpy()
            n = np.diff(ends).astype(np.int64)
            data, off = decode(lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], n, vocabulary)
            text, text_off = utf8(batch.column(at))
            same = np.diff(off) == np.diff(text_off)
            if len(data) == len(text) and same.all():
                upto = np.concatenate([[0], np.cumsum(data != text)])
                same = upto[off[1:]] == upto[off[:-1]]
            return pa.record_batch([*batch.columns, pa.array(n), pa.array(same)], names=[*kept, "n_tokens", "round_trip"])

        return step

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return by_arrow(rows, make, f"{fields}, n_tokens bigint, round_trip boolean")
