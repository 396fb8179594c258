"""Keyword retrieval: exact fields, BM25 over body words, and their sum."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrank.operators.queries import target_terms
from mailrank.session import PUSHED_VALUES, SEPARATE_VALUES, SMALL_ROWS, Settled, one_of, settle, sift

# The usual BM25 parameters.
K1, B = 1.2, 0.75
PARTS_AT_ONCE = 1_000_000  # parts of scores a task sums at a time, about
CELLS_PER_PART = 8  # sums may take a matrix of queries and documents that is as many times as large


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def length_norm(dl: Column, lossy: bool) -> Column:
    """Document length as scoring sees it.

    ``lossy`` keeps four significant bits of the length above 24, which is what an index
    that stores lengths in one byte scores with.
    """
    if not lossy:
        return dl.cast("double")
    over = dl - 24
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(over)) - 4, F.lit(0)))
    return F.when(dl < 24, dl.cast("double")).otherwise(24 + F.floor(over / step) * step)


@dataclass(frozen=True)
class Asked:
    """Rows that ask for terms, settled. ``files`` are those of ranged tables that can hold
    one of the terms, or None where that is not known or they are too many."""

    settled: Settled
    files: list[str] | None

    @property
    def df(self) -> DataFrame:
        return self.settled.df


def term_directory(rows: DataFrame) -> DataFrame:
    """``(file, first_term, last_term, n_rows)`` of a table written in ranges of terms."""
    # The smallest of strings is found by sorting them, so each word of a file is counted first.
    words = rows.groupBy(F.col("_metadata.file_name").alias("file"), "term").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy("file").agg(
        F.min("term").alias("first_term"), F.max("term").alias("last_term"), F.sum("n").alias("n_rows")
    )


def files_holding(directory: Settled, terms: list[str]) -> list[str] | None:
    """The files whose span of terms has one of ``terms`` (sorted), if they are few."""
    if directory.small:
        spans = zip(*(directory.rows[c].to_pylist() for c in ("file", "first_term", "last_term")))
        files = [file for file, first, last in spans if bisect_left(terms, first) < bisect_right(terms, last)]
    else:
        spans = F.exists(F.lit(terms), lambda t: t.between(F.col("first_term"), F.col("last_term")))
        files = directory.df.where(spans).select("file").limit(PUSHED_VALUES + 1).toArrow()["file"].to_pylist()
    return sorted(files) if len(files) <= PUSHED_VALUES else None


def ask(terms: DataFrame, directory: Settled | None = None, once: bool = False) -> Asked:
    """Settle the rows that ask for terms, and look up which files can hold those."""
    settled = settle(terms, once=once)
    if directory is None:
        return Asked(settled, None)
    # A directory held here is looked up for any settled ask; else the terms go into a filter.
    wanted = settled.values("term", SMALL_ROWS if directory.small else PUSHED_VALUES)
    if wanted is None:
        return Asked(settled, None)
    return Asked(settled, files_holding(directory, [t for t in wanted if t is not None]))


def with_terms(rows: DataFrame, asked: Asked, joined: DataFrame | None = None) -> DataFrame:
    """Rows of an index table whose term is asked for, joined to the asking rows.

    ``asked`` comes from :func:`ask`; it has ``term``, and ``field`` where the index table
    has one. A small ask is broadcast, so the index never moves; the files that can hold its
    terms are picked from their names before any is opened, and the terms are filtered in the
    scan. For a large ask the index is sifted where it is read, then shuffled. ``joined`` is
    joined in place of ``asked``; it has at most its rows.
    """
    joined = asked.df if joined is None else joined
    keys = [c for c in ("field", "term") if c in rows.columns and c in joined.columns]
    if not asked.settled.small:
        return sift(rows, asked.df, keys).join(joined, keys)
    if asked.files is not None:
        rows = rows.where(F.col("_metadata.file_name").isin(asked.files))
    # More words than these are in most row groups anyway, and the join drops the rest.
    terms = asked.settled.values("term", SEPARATE_VALUES)
    if terms is not None:
        rows = rows.where(one_of(F.col("term"), terms))
    return rows.join(F.broadcast(joined), keys)


def match_exact(
    exact: DataFrame, query_terms: DataFrame, field: str | None = None, directory: Settled | None = None
) -> DataFrame:
    """``(qid, doc_id, field, term)`` of documents whose exact field equals a query's key."""
    asked = query_terms.select("qid", "field", "term").where("field != 'body_text'")
    if field:
        asked, exact = (d.where(F.col("field") == field) for d in (asked, exact))
    return with_terms(exact, ask(asked, directory)).select("qid", "doc_id", "field", "term")


@dataclass(frozen=True)
class Clause:
    """What sums are made of: ``rows`` of an index table, those who ask for their terms, and the
    ``weights`` ``(qid, [field], term, weight)`` of these. A row counts ``weight * pull``."""

    rows: DataFrame
    asked: Asked
    weights: DataFrame
    pull: Column


def _sums(parts: DataFrame, asking: pa.Table, qid_kind: str) -> DataFrame:
    """``(qid, doc_id, score)`` of ``(doc_id, number, pull)``: what each row counts for every query that asks for it.

    ``asking`` is ``(number, qid, weight)``. Rows meet by document, each once however many ask; what
    they count is made and summed behind that shuffle, a bounded number of parts at a time.
    """
    order = np.argsort(asking["number"].to_numpy(), kind="stable")
    numbers, weights = asking["number"].to_numpy()[order], asking["weight"].to_numpy()[order]
    coded = asking["qid"].combine_chunks().dictionary_encode(null_encoding="encode")
    qids, places = coded.dictionary, coded.indices.to_numpy()[order]
    starts = np.searchsorted(numbers, np.arange(len(np.unique(numbers)) + 1))
    sent = parts.sparkSession.sparkContext.broadcast((starts, places.astype(np.int64), weights, qids))

    def add(ids, doc, number, pull):
        starts, places, weights, qids = sent.value
        times = starts[number + 1] - starts[number]
        row = np.repeat(np.arange(len(number)), times)
        at = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + starts[number][row]
        key, part = (doc[row] - doc[0]) * len(qids) + places[at], weights[at] * pull[row]
        cells = int(doc[-1] - doc[0] + 1) * len(qids)
        if cells <= CELLS_PER_PART * len(key):
            found = np.flatnonzero(np.bincount(key, minlength=cells))
            score = np.bincount(key, part, cells)[found]
        else:
            found, key = np.unique(key, return_inverse=True)
            score = np.bincount(key, part, len(found))
        docs, asked = np.divmod(found, len(qids))
        columns = [qids.take(pa.array(asked)), ids.take(pa.array(docs + doc[0])), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, names=["qid", "doc_id", "score"])

    def whole(block: pa.Table) -> tuple[pa.Array, np.ndarray]:
        """The documents of sorted rows, and the place among them of each row's."""
        runs = pc.run_end_encode(block["doc_id"].combine_chunks())
        return runs.values, np.repeat(np.arange(len(runs.values)), np.diff(runs.run_ends.to_numpy(), prepend=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = sent.value[0]
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                batch = pa.Table.from_batches([batch])
                held = batch if held is None else pa.concat_tables([held, batch])
            if held is None:
                break
            ids, doc = whole(held)
            # The last document may go on in the next batch.
            ready = len(doc) if batch is None else int(np.searchsorted(doc, doc[-1]))
            number, pull = (held[c].to_numpy()[:ready] for c in ("number", "pull"))
            made = np.cumsum(starts[number + 1] - starts[number])
            a = 0
            while a < ready:
                most = (made[a - 1] if a else 0) + PARTS_AT_ONCE
                # Up to the end of the document in which the bound is met.
                b = int(np.searchsorted(doc[:ready], doc[min(np.searchsorted(made, most), ready - 1)], side="right"))
                yield add(ids, doc[a:b], number[a:b], pull[a:b])
                a = b
            held = held.slice(ready)

    near = parts.select("doc_id", "number", "pull").repartition("doc_id").sortWithinPartitions("doc_id")
    return near.mapInArrow(run, f"qid {qid_kind}, doc_id {dict(near.dtypes)['doc_id']}, score double")


def clause_scores(clauses: list[Clause]) -> DataFrame:
    """``(qid, doc_id, score)``: a document scores the sum of what its rows count in all clauses."""
    if not all(c.asked.settled.small for c in clauses):
        return sum_clauses([
            with_terms(c.rows, c.asked, c.weights).select("qid", "doc_id", (F.col("weight") * c.pull).alias("score"))
            for c in clauses
        ])
    parts, asking, n = [], [], 0
    for c in clauses:
        spark, keys = c.rows.sparkSession, [k for k in ("field", "term") if k in c.weights.columns]
        # At most as many rows as were settled.
        held = c.weights.select(*keys, "qid", "weight").toArrow()
        terms = list(zip(*(held[k].to_pylist() for k in keys)))
        number = {term: n + i for i, term in enumerate(dict.fromkeys(terms))}
        n += len(number)
        asking.append(held.select(["qid", "weight"]).append_column("number", pa.array([number[t] for t in terms], pa.int64())))
        numbered = spark.createDataFrame([(*t, i) for t, i in number.items()], ", ".join(f"{k} STRING" for k in keys) + ", number INT")
        found = with_terms(c.rows, c.asked, numbered)
        parts.append(found.select("doc_id", "number", c.pull.alias("pull")))
    return _sums(reduce(DataFrame.unionByName, parts), pa.concat_tables(asking), dict(clauses[0].weights.dtypes)["qid"])


def exact_clause(
    exact: DataFrame,
    stats: DataFrame,
    fields: DataFrame,
    query_terms: DataFrame,
    k1: float = K1,
    directory: Settled | None = None,
) -> Clause:
    """Exact matches count ``idf / (1 + k1)`` per matching field.

    ``stats`` is ``(field, term, df)``, ``fields`` one row per field with its documents.
    """
    asked = ask(query_terms.where("field != 'body_text'").select("qid", "field", "term"), directory)
    weighted = (
        with_terms(stats, asked)
        .join(F.broadcast(fields), "field")  # as many rows as there are exact fields
        .select("qid", "field", "term", (idf(F.col("n_docs"), F.col("df")) / (1 + k1)).alias("weight"))
    )
    return Clause(exact, asked, weighted, F.lit(1.0))


def exact_scores(exact: DataFrame, stats: DataFrame, fields: DataFrame, query_terms: DataFrame, **options) -> DataFrame:
    """``(qid, doc_id, score)`` of exact matches, a row per matching field; see :func:`exact_clause`."""
    c = exact_clause(exact, stats, fields, query_terms, **options)
    return with_terms(c.rows, c.asked, c.weights).select("qid", "doc_id", F.col("weight").alias("score"))


def bm25_clause(
    postings: DataFrame,
    stats: DataFrame,
    corpus: DataFrame,
    query_terms: DataFrame,
    k1: float = K1,
    b: float = B,
    lossy_length: bool = False,
    directory: Settled | None = None,
) -> Clause:
    """Words count by BM25.

    ``query_terms`` is ``(qid, term, n)``; a word asked ``n`` times counts ``n`` times.
    """
    asked = ask(query_terms.select("qid", "term", "n"), directory)
    n_docs, avgdl = (corpus.select(c).scalar() for c in ("n_docs", "avgdl"))
    weight = F.col("n") * idf(n_docs, F.col("df"))
    weights = with_terms(stats, asked).select("qid", "term", weight.alias("weight"))
    dl = length_norm(F.col("dl"), lossy_length)
    pull = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * dl / avgdl))
    return Clause(postings, asked, weights, pull)


def bm25(postings: DataFrame, stats: DataFrame, corpus: DataFrame, query_terms: DataFrame, **options) -> DataFrame:
    """``(qid, doc_id, score)`` of documents with any of a query's words; see :func:`bm25_clause`.

    The large side is one filtered scan of the postings; those that are asked for are shuffled
    once by document and weighed behind that, so what moves does not grow with the queries.
    """
    return clause_scores([bm25_clause(postings, stats, corpus, query_terms, **options)])


def match_raw_term(
    postings: DataFrame, stats: DataFrame, corpus: DataFrame, queries: DataFrame, **options
) -> DataFrame:
    """BM25 of the whole lower-cased target as one word; a target with a space finds nothing."""
    terms = target_terms(queries, mode="raw").where("field = 'body_text'")
    return bm25(postings, stats, corpus, terms, **options)


def sum_clauses(clauses: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """``(qid, doc_id, score)``: a document scores the sum of the clauses it matches.

    ``weights`` boosts clauses.
    """
    weights = weights or [1.0] * len(clauses)
    parts = [
        c.select("qid", "doc_id", (F.col("score") * w).alias("score") if w != 1.0 else "score")
        for c, w in zip(clauses, weights)
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("qid", "doc_id").agg(F.sum("score").alias("score"))


def keyword_scores(tables, queries: DataFrame, mode: str = "words", weights=None, **options) -> DataFrame:
    """Scores of every document that matches a query's target in any field."""
    terms = settle(target_terms(queries, mode)).df
    words = terms.where("field = 'body_text'")
    exact = exact_clause(
        tables.exact_terms, tables.exact_stats, tables.field_stats, terms, directory=tables.directory
    )
    body = bm25_clause(
        tables.postings, tables.term_stats, tables.corpus_stats, words, directory=tables.directory, **options
    )
    boosts = weights or [1.0, 1.0]
    return clause_scores(
        [replace(c, weights=c.weights.withColumn("weight", F.col("weight") * w)) for c, w in zip((exact, body), boosts)]
    )
