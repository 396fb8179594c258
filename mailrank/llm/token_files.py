"""Token ids as Parquet list columns: encode, write in document order, read selectively.

Rows are ranged by document id and written in that order, one file per range, with small row
groups and pages so that the column and page indexes of Parquet (smallest and largest
``doc_id`` and ``n_tokens`` of each page) let a reader take a few documents or the metadata
alone. Ids are dictionary encoded: a vocabulary of some ten thousand entries makes 2-byte
codes. ``encoding="delta"`` writes DELTA_BINARY_PACKED instead, for vocabularies beyond that.

Nulls and ties: a null text is an empty one; null ids come first; rows of one id are ordered
by text hash and text. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailrank.llm.common import by_arrow, chunks, in_arrow, parts, ranges, slices, strings, utf8
from mailrank.session import fresh_path

ROW_GROUP_BYTES = 8 * 1024 * 1024
PAGE_ROWS = 2_000
CACHED_PIECES = 300_000  # encodings one task keeps
PIECES_AT_ONCE = 2_000

# Kinds of characters in the vocabulary file's own splitting rule: 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+
SPACE, LETTER, DIGIT, OTHER = range(4)
_RULES = [(SPACE, regex.compile(r"\s")), (LETTER, regex.compile(r"\p{L}")), (DIGIT, regex.compile(r"\p{N}")), (OTHER, regex.compile(r"."))]
KINDS = np.array([next(k for k, rule in _RULES if rule.fullmatch(chr(c))) for c in range(0x300)], np.uint8)


def split(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of plain words, lower-cased, and how many each word has.

    Words hold characters below U+0200, whose lower case has as many bytes. A piece starts
    where the kind of character changes, at each digit, and around the endings of the rule.
    """
    low = np.frombuffer(data.tobytes().decode().lower().encode(), np.uint8)
    at = np.flatnonzero((low & 0xC0) != 0x80)
    code = low[at].astype(np.int32)
    wide = code >= 0xC0
    code[wide] = ((code[wide] & 31) << 6) | (low[at[wide] + 1] & 63)
    kind = KINDS[code]
    word = np.searchsorted(at, off[:-1])

    first = np.ones(len(at) + 3, bool)
    first[: len(at)] = False
    first[word] = True
    start = first.copy()
    start[1 : len(at)] |= kind[1:] != kind[:-1]
    start[: len(at)] |= kind == DIGIT
    quote = np.flatnonzero((code == 39) & start[: len(at)])
    ahead = np.concatenate([code, [0, 0]])
    x, y = ahead[quote + 1], ahead[quote + 2]
    one = np.isin(x, [ord(c) for c in "stmd"]) & ~first[quote + 1]
    two = (((x == ord("r")) | (x == ord("v"))) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
    two &= ~first[quote + 1] & ~first[quote + 2]
    start[quote[one] + 1] = start[quote[two] + 1] = False
    start[quote[one] + 2] = start[quote[two] + 3] = True

    seen = kind != SPACE
    width = 1 + wide.astype(np.int64)
    held = np.concatenate([[0], np.cumsum(width * seen)])
    begin = np.flatnonzero(start[: len(at)] & seen)
    pieces = strings(low[np.repeat(seen, width)], np.append(held[begin], held[-1]), pa.binary())
    return pieces, np.diff(np.append(np.searchsorted(begin, word), len(begin)))


class WordEncoder:
    """Encoder for a BPE with word ends that lower-cases and drops white space; one per task.

    Distinct plain words (characters below U+0200, which composing leaves alone) are split
    here by the vocabulary file's rule; the distinct pieces go through the library joined by
    spaces, and come apart again at the ids that end a word. All other words go through the
    library one by one. A bounded number of pieces is remembered.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # For pieces, which are composed, lower-case and split already.
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = None
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
        self.end_id = end_id
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for token, i in self.whole.get_vocab().items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def pieces(self, found: list[bytes]) -> list[bytes]:
        """Ids of each distinct piece, as bytes of int32."""
        out = [self.known.get(p) for p in found]
        new = [i for i, x in enumerate(out) if x is None]
        for a in range(0, len(new), PIECES_AT_ONCE):
            part = new[a : a + PIECES_AT_ONCE]
            joined = b" ".join([found[i] for i in part]).decode()
            ids = np.array(self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("the vocabulary does not end each piece with one id")
            held, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
            for i, x, y in zip(part, at, at[1:]):
                out[i] = held[x:y]
            if len(self.known) < CACHED_PIECES:
                self.known.update((found[i], out[i]) for i in part)
        return out

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has."""
        data, off = utf8(words)
        n = len(words)
        after = np.append(data[1:], 0)
        odd = ((data < 32) & ~((data >= 9) & (data <= 13))) | (data >= 0xC8) | ((data == 60) & (after == 124))
        odd |= ((data == 0xC2) & ((after == 0x85) | (after == 0xA0))) | ((data == 0xC4) & (after == 0xB0))
        odd_upto = np.concatenate([[0], np.cumsum(odd)])
        plain = odd_upto[off[1:]] == odd_upto[off[:-1]]

        found, many = split(*utf8(words.filter(pa.array(plain))))
        pieces = found.dictionary_encode()
        ids = self.pieces(pieces.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        codes = pieces.indices.to_numpy(zero_copy_only=False)
        each = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(each)])
        cut = np.concatenate([[0], np.cumsum(many)])
        count = np.zeros(n, np.int64)
        count[plain] = np.diff(upto[cut])
        own = flat[ranges((np.cumsum(sizes) - sizes)[codes], each)]
        rest = [x.decode("utf-8", "replace") for x in words.filter(pa.array(~plain)).to_pylist()]
        if not rest:
            return own, count
        more = [e.ids for e in self.whole.encode_batch_fast(rest, add_special_tokens=False)]
        count[~plain] = list(map(len, more))
        mine = np.repeat(plain, count)
        out = np.empty(len(mine), np.int32)
        out[mine] = own
        out[~mine] = [i for x in more for i in x]
        return out, count

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts, each text followed by the end id, and how many each text has."""
        words, codes, per_text = chunks(texts)
        flat, sizes = self.distinct(words)
        each = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(each)])
        last = np.cumsum(per_text)
        n = upto[last] - upto[last - per_text]
        out = np.full(int(n.sum()) + len(n), self.end_id, np.int32)
        held = np.ones(len(out), bool)
        held[np.cumsum(n + 1) - 1] = False
        out[held] = flat[ranges((np.cumsum(sizes) - sizes)[codes], each)]
        return out, n + 1


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES
) -> None:
    """Encode ``doc_id, text`` and write ``doc_id, shard, start_in_shard, n_tokens, ids`` in ascending id order."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, encoder = TaskContext.get().partitionId(), 0, WordEncoder(vocabulary, end_id)
        for whole in batches:
            for batch in slices(whole, 1):
                ids, n = encoder.column(batch.column(1))
                ends = np.concatenate([[0], np.cumsum(n)])
                yield pa.record_batch(
                    [
                        batch.column(0),
                        pa.array(np.full(len(n), shard, np.int32)),
                        pa.array(start + ends[:-1]),
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                    ],
                    names=["doc_id", "shard", "start_in_shard", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(parts(spark), *order).sortWithinPartitions(*order, "text")
    rows = in_arrow(ranged, run, "doc_id bigint, shard int, start_in_shard bigint, n_tokens bigint, ids array<int>")
    (
        rows.write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``start``, the number of ids of all documents before.

    A shard is one written file; the offsets of shards come from ``n_tokens`` alone, and there
    are as many as tasks that wrote, so neither the window over them nor their broadcast holds more rows than that.
    """
    rows = spark.read.schema(
        "doc_id bigint, shard int, start_in_shard bigint, n_tokens bigint, ids array<int>"
    ).parquet(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("start_in_shard")).drop("base", "start_in_shard")


def with_crc32(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the checksum over ids as little-endian 32-bit numbers."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            held = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(held[a * 4 : b * 4]) for a, b in itertools.pairwise(ends.tolist())]
            sizes = pa.array(np.diff(ends).astype(np.int64))
            return pa.record_batch(
                [batch.column(0), batch.column(1), sizes, pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

        return step

    rows = rows.select("doc_id", "start", "n_tokens", "ids")
    return by_arrow(rows, make, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = fresh_path(spark, "token-files")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return with_crc32(read_tokens(spark, path))
