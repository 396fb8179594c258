"""Build the search tables of an emails table, and open them again."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrank.functions.text import EMBED_CHARS
from mailrank.operators import index
from mailrank.operators.embed import Embedder
from mailrank.operators.keyword import term_directory
from mailrank.session import Settled, settle


@dataclass(frozen=True)
class SearchTables:
    """The tables a search reads. ``directory`` is set where they are written: the span of terms of each file."""

    docs: DataFrame
    vectors: DataFrame
    exact_terms: DataFrame
    exact_stats: DataFrame
    field_stats: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    directory: Settled | None = None


TEXT_PER_FILE = 8 * 1024 * 1024  # bytes of text whose postings make a file, about: a task sorts them

TABLES = ("docs", "vectors", "exact_terms", "exact_stats", "field_stats", "postings", "term_stats", "corpus_stats")


def derive_search_tables(emails: DataFrame, embedder: Embedder, normalise: bool = False) -> SearchTables:
    """The search tables as plans over ``emails`` (with ``doc_id``), nothing written."""
    docs = index.stored_fields(emails)
    exact = index.exact_terms(emails, normalise)
    posted = index.postings(docs)
    return SearchTables(
        docs=docs,
        vectors=index.vector_table(emails, embedder),
        exact_terms=exact,
        exact_stats=index.term_stats(exact),
        field_stats=index.field_stats(exact),
        postings=posted,
        term_stats=index.text_term_stats(docs),
        corpus_stats=index.corpus_stats(index.posted_lengths(posted)),
    )


def _posting_files(docs: DataFrame) -> int:
    held = docs.agg(F.sum(F.octet_length("body_content"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-held // TEXT_PER_FILE))


def build_search_tables(
    emails: DataFrame,
    embedder: Embedder,
    path: str,
    files: int | None = None,
    normalise: bool = False,
    embed_chars: int = EMBED_CHARS,
) -> SearchTables:
    """Write the search tables below ``path``, replacing what was there, and open them.

    The stored fields are written first, sorted by ``doc_id`` within their files, and
    everything else is read from them, so the messages are parsed once. Tables that are
    looked up by term are sorted by term over all their files, and the postings of one term
    by document: a frequent term fills files of its own, a rare one shares a file, however
    many there are. A directory of the first and last term of each file tells a search which
    files to open, and inside them row groups are skipped by the term. ``files`` is how many
    each such table has at most; if not given, postings have one for each ``TEXT_PER_FILE`` bytes
    of text, one a core at least, so that what a task sorts does not grow with the mails, and the
    smaller tables the session's shuffle partitions, merged where they are small. Ranges are found by sampling, a pass of its own, so postings are
    written as the texts come first (``analysed``, needed by nothing later): reading them twice costs far
    less than analysing the texts twice. ``embed_chars`` is how much of subject and
    body the vector is made of.
    """
    spark = emails.sparkSession

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    def by_term(df: DataFrame, n: int | None = files) -> DataFrame:
        order = [c for c in ("field", "term", "doc_id") if c in df.columns]
        ranged = df.repartitionByRange(n, *order) if n else df.repartitionByRange(*order)
        return ranged.sortWithinPartitions(*order)

    docs = save(index.stored_fields(emails).sortWithinPartitions("doc_id"), "docs")
    exact = save(by_term(index.exact_terms(docs, normalise)), "exact_terms")
    analysed = save(index.postings(docs), "analysed")
    posted = save(by_term(analysed, files or _posting_files(docs)), "postings")
    looked_up = {
        "exact_terms": exact,
        "postings": posted,
        "exact_stats": save(by_term(index.term_stats(exact)), "exact_stats"),
        "term_stats": save(by_term(index.term_stats(posted)), "term_stats"),
    }
    # File names are unique, so one directory serves all tables.
    spans = reduce(DataFrame.unionByName, map(term_directory, looked_up.values()))
    return SearchTables(
        docs=docs,
        vectors=save(index.vector_table(docs, embedder, embed_chars), "vectors"),
        field_stats=save(index.field_stats(exact), "field_stats"),
        corpus_stats=save(index.corpus_stats(index.posted_lengths(posted)), "corpus_stats"),
        directory=settle(save(spans.sort("first_term", "file"), "directory")),
        **looked_up,
    )


def open_search_tables(spark: SparkSession, path: str) -> SearchTables:
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    return SearchTables(**tables, directory=settle(spark.read.parquet(f"{path}/directory")))
