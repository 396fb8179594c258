"""What the operators of this subpackage share: reading tables, written steps, words of a batch."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrank.session import fresh_path

# ASCII white space: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
SLICE_BYTES = 2 * 1024 * 1024  # of text that a task works on at once; one longer text is worked on whole
ARROW_BATCH = "8m"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; a lone file is spread over the cores, many files are left where they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` as a table written to the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    # Shuffle files of the step go once the driver's JVM has collected what held them.
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that :func:`written` made and nothing reads any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sent(spark: SparkSession, value):
    """Broadcast an object with the code of its class, so that tasks need no copy of the package; see :func:`received`."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast):
    return pickle.loads(broadcast.value)


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def carrying(stage: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage on documents with further columns: they ride along as one, so no name can clash with the stage's own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        more = [c for c in names if c not in DOCUMENT]
        if not more:
            return stage(spark, docs, sf_dir)
        packed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(more)])
        out = stage(spark, docs.select(*[c for c in names if c in DOCUMENT], packed.alias("_carried")), sf_dir)
        return out.select(*[F.col("_carried")[f"c{more.index(c)}"].alias(c) if c in more else c for c in names])

    return run


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most ``ARROW_BATCH`` (or one longer row).

    The default of 64 MB would be held several times over in each worker; the setting is one
    of the session, and only makes batches of later Python functions smaller too.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return df.mapInArrow(run, schema)


def by_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Apply to every Arrow batch the function that ``make`` builds once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None:
                    yield out

    return in_arrow(df, run, schema)


def slices(batch: pa.RecordBatch, column: int, at_most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of rows with some megabytes of one text column, or one longer row."""
    _, off = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + at_most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, off - off[0]


def strings(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A string or binary array over ready bytes and offsets."""
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    ends = np.ascontiguousarray(offsets, np.int64 if wide else np.int32)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` of ``lengths[i]`` numbers each, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def _wide_blank_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the byte before each place may end a white-space character of two or three bytes."""
    a, b, c = (np.where(at >= k, data[np.maximum(at - k, 0)], 0) for k in (1, 2, 3))
    two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    three = ((c == 0xE1) | (c == 0xE2) | (c == 0xE3)) & ((b == 0x80) | (b == 0x81) | (b == 0x9A))
    return two | three


def chunks(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut in front of each space that follows a visible character.

    Returns the distinct pieces (binary), the piece numbers of all texts one after the other,
    and how many pieces each text has. White space stays with the word after it, so no token
    pattern that never goes from a visible character to white space crosses a cut.
    """
    data, off = utf8(column)
    blank = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        at = np.flatnonzero((data[1:] == 32) & ~blank[:-1]) + 1
        cut[at[~_wide_blank_before(data, at)]] = True
    cut[off] = True
    cut[-1] = True
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    ends = np.flatnonzero(cut)
    pieces = strings(data, ends, pa.binary()).dictionary_encode()
    codes = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return pieces.dictionary, codes, np.diff(np.searchsorted(ends, off))


def words(text: Column) -> Column:
    """The words of a text as an array: runs of anything but ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
