"""Inputs the registered queries derive, on Spark, from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrank.functions.text import word_tokens
from mailrank.operators.dictionary import Dictionary, build_dictionary
from mailrank.operators.embed import hash_embedder
from mailrank.operators.parse import parse_messages
from mailrank.operators.sharded import ShardedPostings, build_sharded
from mailrank.plans.build import SearchTables, build_search_tables
from mailrank.plans.vector_index import VectorIndex, build_vector_index
from mailrank.session import fresh_path

FIRST_MAIL = "2001-05-14 16:39:00"
MINUTES = 5_000_000  # dates start over after that many documents

CELLS = 8

_built: dict[tuple[str, str], SearchTables] = {}
_indexes: dict[tuple[str, str], VectorIndex] = {}
_dictionaries: dict[tuple[str, str], Dictionary] = {}
_sharded: dict[tuple[str, str], ShardedPostings] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table. A lone file of one row group is a single task, so it is spread over
    the cores; a table of many files is left where it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, file, message)``: every document as the body of a mail."""
    n = F.col("doc_id")
    start = F.lit(FIRST_MAIL).cast("timestamp_ntz")
    sent = F.timestamp_add("MINUTE", F.pmod(n, F.lit(MINUTES)).cast("int"), start)

    def number(m):
        return F.pmod(n, F.lit(m)).cast("string")

    def when(m, line):
        return F.when(F.pmod(n, F.lit(m)) == 0, line).otherwise(F.lit(""))

    capital = F.when(F.pmod(n, F.lit(7)) == 0, F.lit("From: User")).otherwise(F.lit("From: user"))
    to = F.concat(F.lit("To: a"), number(5), F.lit("@example.com\n"))
    parts = [
        F.lit("Message-ID: <"), n.cast("string"), F.lit("@"), F.col("source"), F.lit(".example.com>\n"),
        F.lit("Date: "), F.date_format(sent, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000 (UTC)\n"),
        capital, number(50), F.lit("@example.com\n"),
        F.when(F.pmod(n, F.lit(11)) == 0, F.lit("")).otherwise(to),
        when(3, F.concat(F.lit("Cc: c"), number(4), F.lit("@example.com\n"))),
        when(9, F.lit("Bcc: b@example.com\n")),
        F.lit("Subject: Note "), n.cast("string"), when(4, F.lit("\n part two")), F.lit("\n"),
        F.lit("X-From: Name "), number(50), F.lit(" <u>\n"),
        F.when(F.pmod(n, F.lit(10)) == 0, F.lit("Content-Type: Multipart/mixed\n")).otherwise(F.lit("Content-Type: text/plain\n")),
        F.lit("\n"), F.col("text"),
    ]
    file = F.concat("source", F.lit("/"), n.cast("string"), F.lit("."))
    return documents(spark, sf_dir).select("doc_id", file.alias("file"), F.concat(*parts).alias("message"))


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_messages(raw_messages(spark, sf_dir), keep=("doc_id",))


def folded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file, message)``: one message per conversation turn, its text as a folded header."""
    folded = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\t "))
    message = F.concat(
        F.lit("Conv: "), F.col("conv_id").cast("string"),
        F.lit("\nnot a header\nText:  "), folded,
        F.lit("\nRole: first\nROLE : "), F.col("role"), F.lit("\n\nbody"),
    )
    file = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select(file.alias("file"), message.alias("message"))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a search; targets are an address, the text, nothing, a number."""
    n = F.col("item_id")
    kind = F.pmod(n, F.lit(4))
    address = F.concat(F.lit(" User"), F.pmod(n, F.lit(50)).cast("string"), F.lit("@Example.com "))
    phone = F.concat(F.lit("call 713-853-"), F.lpad(n.cast("string"), 4, "0"))
    target = F.when(kind == 0, address).when(kind == 1, F.col("text")).when(kind == 2, F.lit("-")).otherwise(phone)
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        n.alias("qid"),
        F.when(F.pmod(n, F.lit(7)) == 3, F.lit("-")).otherwise(F.col("text")).alias("query_text"),
        target.alias("target"),
        F.when(F.pmod(n, F.lit(5)) == 0, F.lit(0)).otherwise(F.lit(20)).alias("max_results"),
    )


def text_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as the target of a keyword search."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("qid"), F.lit("-").alias("query_text"), F.col("text").alias("target"), F.lit(20).alias("max_results")
    )


def search_tables(spark: SparkSession, sf_dir: str) -> SearchTables:
    """The search tables of all mails, written once per application and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = build_search_tables(mails(spark, sf_dir), hash_embedder(), fresh_path(spark, "tables"))
    return _built[key]


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The compact vector index of all mails, written once per application and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        vectors = search_tables(spark, sf_dir).vectors.select("doc_id", "vec")
        _indexes[key] = build_vector_index(vectors, fresh_path(spark, "vectors"), CELLS)
    return _indexes[key]


def dictionary(spark: SparkSession, sf_dir: str) -> Dictionary:
    """The words of all mails, written once per application and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _dictionaries:
        stats = search_tables(spark, sf_dir).term_stats
        _dictionaries[key] = build_dictionary(stats, fresh_path(spark, "dictionary"))
    return _dictionaries[key]


def sharded_postings(spark: SparkSession, sf_dir: str) -> ShardedPostings:
    """The postings of all mails in shards, written once per application and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _sharded:
        tables = search_tables(spark, sf_dir)
        _sharded[key] = build_sharded(tables.postings, tables.corpus_stats, fresh_path(spark, "sharded"))
    return _sharded[key]


def asked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(qid, word)``: of every benchmark text one word of five or more plain letters."""
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("qid"), F.explode(word_tokens(F.col("text"))).alias("word")
    )
    mixed = F.md5(F.concat(F.col("qid").cast("string"), "word"))
    return words.where(F.col("word").rlike("^[a-z]{5,}$")).groupBy("qid").agg(F.min_by("word", mixed).alias("word"))


def asked_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(qid, kind, pattern)``: a prefix, a wildcard or a regex made of each asked word."""
    word, kind = F.col("word"), F.pmod(F.col("qid"), F.lit(3))
    wildcard = F.concat(word.substr(1, 1), F.lit("?"), word.substr(3, 1), F.lit("*"), F.right(word, F.lit(1)))
    return asked_words(spark, sf_dir).select(
        "qid",
        F.when(kind == 0, "prefix").when(kind == 1, "wildcard").otherwise("regex").alias("kind"),
        F.when(kind == 0, word.substr(1, 3)).when(kind == 1, wildcard)
        .otherwise(F.concat(word.substr(1, 2), F.lit("[a-m]{2,}"))).alias("pattern"),
    )


def misspelt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(qid, word, distance)``: each asked word, its third and fourth letter swapped."""
    word = F.col("word")
    swapped = F.concat(word.substr(1, 2), word.substr(4, 1), word.substr(3, 1), F.substring(word, 5, 1000))
    return asked_words(spark, sf_dir).select(
        "qid", swapped.alias("word"), (F.pmod(F.col("qid"), F.lit(2)) + 1).cast("int").alias("distance")
    )


def asked_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(qid, lo, hi, lo_closed, hi_closed)``: the words from each asked word on; every tenth has an open end."""
    tenth, even = F.pmod(F.col("qid"), F.lit(10)) == 0, F.pmod(F.col("qid"), F.lit(2)) == 0
    return asked_words(spark, sf_dir).select(
        "qid",
        F.when(tenth, "zo").otherwise(F.col("word")).alias("lo"),
        F.when(~tenth, F.concat(F.substring("word", 1, 4), F.lit("z"))).alias("hi"),
        even.alias("lo_closed"),
        F.lit(True).alias("hi_closed"),
    )
