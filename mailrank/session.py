"""Session helpers: the shared folder, and size checks in front of a broadcast."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a side may hold before it is no longer pulled or broadcast.
SMALL_ROWS = 50_000
SMALL_BYTES = 64 * 1024 * 1024
PUSHED_VALUES = 1_000  # as many literal values go into a scan filter,
SEPARATE_VALUES = 60  # and as many go there one by one
FILTER_WORDS = 1 << 21  # 64-bit words in a filter of keys, at most; some 64 MB once hashed for a join
BITS_PER_KEY = 16
VALUES_PER_LIST = 10  # longer IN lists reach a Parquet scan only as their smallest and largest value


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    A temporary folder is taken only for an unset value on a local master.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="mailrank-")
    return _own_dirs[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Settled:
    """A DataFrame that was checked for size. ``rows`` holds its rows when it is small."""

    df: DataFrame
    rows: pa.Table | None

    @property
    def small(self) -> bool:
        return self.rows is not None

    def values(self, column: str, at_most: int = PUSHED_VALUES) -> list | None:
        """The distinct values of a column, sorted, unless they are not known or too many."""
        if self.rows is None:
            return None
        found = pc.unique(self.rows[column]).to_pylist()
        return sorted(found) if len(found) <= at_most else None


def settle(df: DataFrame, max_rows: int | None = None, once: bool = False) -> Settled:
    """Replace ``df`` by a local, broadcast-hinted copy if it has at most ``max_rows`` rows.

    Above that bound it is written to the shared folder, so that what made it does not run
    again with each reader, and its joins are shuffled joins. For rows of numbers and words;
    rows with texts go through :func:`settle_texts`. With ``once`` they are written before they
    are looked at, so that rows that cost much are made once however many there are.
    """
    max_rows = SMALL_ROWS if max_rows is None else max_rows

    def written() -> DataFrame:
        path = fresh_path(df.sparkSession, "asked")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    made = written() if once else df
    head = made.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return Settled(made if once else written(), None)
    return Settled(F.broadcast(df.sparkSession.createDataFrame(head, schema=df.schema)), head)


def settle_texts(
    df: DataFrame, texts: list[str], max_rows: int | None = None, max_bytes: int = SMALL_BYTES
) -> Settled:
    """:func:`settle` for rows with texts, whose bytes are added up before any is pulled."""
    max_rows = SMALL_ROWS if max_rows is None else max_rows
    size = F.lit(0).cast("bigint")
    for c in texts:
        size = size + F.octet_length(c)
    n, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return settle(df, max_rows) if n <= max_rows and held <= max_bytes else Settled(df, None)


def one_of(c: Column, values: list) -> Column:
    """``c`` is one of ``values``, as a filter that a Parquet scan can use to skip row groups.

    A few values are pushed down one by one, as short lists joined by OR. With many, most
    row groups hold some of them, and one hashed list costs less per row.
    """
    if not values or len(values) > SEPARATE_VALUES:
        return c.isin(values)
    lists = [values[i : i + VALUES_PER_LIST] for i in range(0, len(values), VALUES_PER_LIST)]
    return reduce(or_, [c.isin(part) for part in lists])


def sift(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without most of those whose keys nobody asks for, dropped where they are read.

    A Bloom filter of one hash, kept as 64-bit words by their number, so probing it is an
    equi-join with a broadcast side of at most ``FILTER_WORDS`` rows however many ask. At
    ``BITS_PER_KEY`` one row in sixteen that nobody asks for passes; a join has to follow.
    """
    kinds = dict(rows.dtypes)
    words = max(1, min(FILTER_WORDS, asked.count() * BITS_PER_KEY // 64))

    def place(cast: bool) -> Column:
        values = [F.col(k).cast(kinds[k]) if cast else F.col(k) for k in keys]
        return F.pmod(F.xxhash64(*values), F.lit(words * 64))

    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_place") % 64).cast("int"))
    filled = asked.select(place(True).alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word"))
    held = filled.agg(F.bit_or(bit).alias("_bits"))
    placed = rows.withColumn("_place", place(False)).withColumn("_word", F.shiftright("_place", 6))
    found = placed.join(F.broadcast(held), "_word").where(F.getbit("_bits", (F.col("_place") % 64).cast("int")) == 1)
    return found.drop("_place", "_word", "_bits")


def fetch(rows: DataFrame, asked: Settled, key: str = "doc_id") -> DataFrame:
    """``rows`` joined to the asking rows by ``key``, of which a bounded number is filtered in the scan.

    Of a large table sorted by ``key`` only the pages with those keys are read. Beyond the
    bound of :func:`settle` the table is sifted before it is shuffled.
    """
    if not asked.small:
        return sift(rows, asked.df, [key]).join(asked.df, key)
    keys = asked.values(key)
    if keys is not None:
        rows = rows.where(one_of(F.col(key), keys))
    return rows.join(asked.df, key)
