"""Structured keyword operators over postings: all, none, phrase, pattern, fuzzy, range.

Each takes and returns DataFrames, so they combine with joins and with
:func:`mailrank.operators.keyword.sum_clauses`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrank.functions.binding import let
from mailrank.operators.dictionary import swap_distance
from mailrank.operators.keyword import Asked, ask, with_terms
from mailrank.session import Settled, settle


def query_words(spark, terms: dict[int, list[str]]) -> DataFrame:
    """``(qid, term, place)`` of literal word lists."""
    rows = [(q, t, i) for q, words in terms.items() for i, t in enumerate(words)]
    return spark.createDataFrame(rows, "qid BIGINT, term STRING, place INT")


def _sizes(asked: Asked) -> DataFrame:
    """``(qid, n_terms)``, at most one row per asked term."""
    sizes = asked.df.groupBy("qid").agg(F.count(F.lit(1)).alias("n_terms"))
    return F.broadcast(sizes) if asked.settled.small else sizes


def match_all(postings: DataFrame, query_terms: DataFrame, directory: Settled | None = None) -> DataFrame:
    """``(qid, doc_id)`` of documents that hold every word of a query."""
    asked = ask(query_terms.select("qid", "term").distinct(), directory)
    sizes = _sizes(asked)
    found = with_terms(postings, asked)
    matched = found.groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("n_found"))
    return matched.join(sizes, "qid").where("n_found = n_terms").select("qid", "doc_id")


def match_any(postings: DataFrame, query_terms: DataFrame, directory: Settled | None = None) -> DataFrame:
    """``(qid, doc_id)`` of documents that hold at least one word of a query."""
    asked = ask(query_terms.select("qid", "term").distinct(), directory)
    return with_terms(postings, asked).select("qid", "doc_id").distinct()


def match_none(ranked: DataFrame, postings: DataFrame, query_terms: DataFrame, directory: Settled | None = None) -> DataFrame:
    """Rows of ``ranked`` whose document holds none of the query's words."""
    asked = ask(query_terms.select("qid", "term").distinct(), directory)
    held = with_terms(postings, asked).select("qid", "doc_id")
    return ranked.join(held, ["qid", "doc_id"], "left_anti")


def _may_hold(postings: DataFrame, stats: DataFrame, asked: Asked, directory: Settled | None) -> DataFrame:
    """``(qid, doc_id)`` of documents with a query's rarest word: no others can hold them all."""
    rarest = with_terms(stats, asked).groupBy("qid").agg(F.min_by("term", "df").alias("term"))
    found = with_terms(postings, ask(rarest, directory)).select("qid", "doc_id")
    return settle(found).df


def match_phrase(
    postings: DataFrame,
    query_terms: DataFrame,
    slop: int = 0,
    directory: Settled | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """``(qid, doc_id, n_places)`` of documents that hold a query's words one after another.

    ``query_terms`` is ``(qid, term, place)``, ``place`` counting the phrase's words from 0. A
    document brings one row per phrase word, with its positions moved back by ``place``; the
    phrase starts where all of them agree. With ``slop`` they may differ by that much, and
    ``n_places`` counts the starts of any word from which each word of the phrase has a
    position of its own: a word the phrase holds twice must be there twice.
    With the term ``stats`` given, only documents with a phrase's rarest word are looked at.
    """
    asked = ask(query_terms.select("qid", "term", "place"), directory)
    rows = with_terms(postings, asked).select("qid", "doc_id", "term", "place", "positions")
    if stats is not None:
        rows = rows.join(_may_hold(postings, stats, asked, directory), ["qid", "doc_id"], "left_semi")
    starts = F.transform("positions", lambda p: p - F.col("place"))
    word = F.struct("term", "place", starts.alias("starts"))
    per_doc = (
        rows.select("qid", "doc_id", word.alias("word"))
        .groupBy("qid", "doc_id")
        .agg(F.count(F.lit(1)).alias("n_found"), F.sort_array(F.collect_list("word")).alias("words"))
        .join(_sizes(asked), "qid")
        .where("n_found = n_terms")
    )
    if slop == 0:
        places = F.aggregate("words.starts", F.get("words.starts", F.lit(0)), lambda acc, s: F.array_intersect(acc, s))
    else:
        # All starts of a document in order: those from x to x + slop stand together, at most
        # slop + 1 of each word, so every start looks at a bounded slice of them.
        def ordered(word, j):
            return F.transform(word["starts"], lambda s: F.struct(s.alias("start"), j.alias("word")))

        merged = F.sort_array(F.flatten(F.transform("words", ordered)))
        shape = F.transform("words", lambda w, j: F.struct(j.alias("word"), w["term"].alias("term"), w["place"].alias("place")))

        # Places of one word are taken from left to right, each the first that is free: their
        # windows move to the right with the place, so this finds a way whenever there is one.
        none = F.struct(F.lit("").alias("term"), F.lit(-1).alias("last"), F.lit(True).alias("found"))

        def fill(x, near, shape):
            def step(acc, word):
                low = F.when(acc["term"] == word["term"], acc["last"] - word["place"]).otherwise(x - 1)
                free = F.filter(near, lambda e: (e["word"] == word["word"]) & (e["start"] > low))
                at = F.get(free, F.lit(0))["start"]
                found = acc["found"] & at.isNotNull()
                return F.struct(
                    word["term"].alias("term"), F.coalesce(at + word["place"], F.lit(-1)).alias("last"), found.alias("found")
                )

            return F.when(F.size(near) < F.size(shape), F.lit(False)).otherwise(
                F.aggregate(shape, none, step, lambda acc: acc["found"])
            )

        def starting(starts, shape):
            def holds(e, i):
                x = e["start"]
                # By place, as a slice of an array looks at the whole array.
                last = F.least(i + F.size(shape) * (slop + 1), F.size(starts)) - 1
                window = F.transform(F.sequence(i, last), lambda at: F.get(starts, at))
                near = F.filter(window, lambda o: o["start"] <= x + slop)
                first = (i == 0) | (F.get(starts, i - 1)["start"] != x)
                return F.when(first, let(near, lambda n: fill(x, n, shape))).otherwise(F.lit(False))

            return F.filter(starts, holds)

        # Bound once: within a function over elements an expression is made anew for each of them.
        places = let(merged, lambda m: let(shape, lambda s: starting(m, s)))
    return per_doc.select("qid", "doc_id", F.size(places).alias("n_places")).where("n_places > 0")


def _holding(postings: DataFrame, stats: DataFrame | None, test: Column, directory: Settled | None) -> DataFrame:
    """``(doc_id)`` of documents with a word that passes ``test``.

    With the term ``stats`` given, words are tested there, once each, and only postings of
    those that pass are read.
    """
    if stats is None:
        return postings.where(test).select("doc_id").distinct()
    return with_terms(postings, ask(stats.where(test).select("term"), directory)).select("doc_id").distinct()


def match_prefix(
    postings: DataFrame, prefix: str, stats: DataFrame | None = None, directory: Settled | None = None
) -> DataFrame:
    """``(doc_id)`` of documents with a word that starts with ``prefix``; the scan filters."""
    return _holding(postings, stats, F.col("term").startswith(prefix), directory)


def wildcard_to_regex(pattern: str) -> tuple[str, str]:
    """``*`` and ``?`` pattern to an anchored regex, and the literal text it begins with."""
    special = set(".^$|()[]{}+\\")
    regex = "".join(
        ".*" if ch == "*" else "." if ch == "?" else "\\" + ch if ch in special else ch for ch in pattern
    )
    literal = pattern[: min([i for i, ch in enumerate(pattern) if ch in "*?"] or [len(pattern)])]
    return f"^{regex}$", literal


def match_wildcard(
    postings: DataFrame, pattern: str, stats: DataFrame | None = None, directory: Settled | None = None
) -> DataFrame:
    """``(doc_id)`` of documents with a word of that ``*``/``?`` shape."""
    regex, literal = wildcard_to_regex(pattern)
    test = F.col("term").rlike(regex)
    return _holding(postings, stats, F.col("term").startswith(literal) & test if literal else test, directory)


def match_regex(
    postings: DataFrame, pattern: str, stats: DataFrame | None = None, directory: Settled | None = None
) -> DataFrame:
    """``(doc_id)`` of documents with a word the whole pattern matches."""
    return _holding(postings, stats, F.col("term").rlike(f"^(?:{pattern})$"), directory)


def match_range(
    postings: DataFrame,
    lo: str | None,
    hi: str | None,
    inclusive: bool = True,
    stats: DataFrame | None = None,
    directory: Settled | None = None,
) -> DataFrame:
    """``(doc_id)`` of documents with a word between ``lo`` and ``hi``; None leaves an end open."""
    term, test = F.col("term"), F.lit(True)
    if lo is not None:
        test = test & (term >= lo if inclusive else term > lo)
    if hi is not None:
        test = test & (term <= hi if inclusive else term < hi)
    return _holding(postings, stats, test, directory)


def fuzzy_terms(stats: DataFrame, term: str, distance: int = 2, swaps: bool = False) -> DataFrame:
    """``(term, edits)`` of index words at most ``distance`` edits away.

    With ``swaps`` two neighbouring letters changing places are one edit. A swap costs
    two plain edits, so the built-in distance at twice the bound picks the few words
    that are looked at again.
    """
    wanted = F.lit(term)
    close = stats.where(F.length("term").between(len(term) - distance, len(term) + distance))
    reach = distance * 2 if swaps else distance
    plain = F.levenshtein(F.col("term"), wanted, reach)
    near = close.select("term", plain.alias("edits")).where("edits >= 0")
    if swaps:
        near = near.select("term", swap_distance(F.col("term"), wanted).alias("edits"))
        near = near.where(F.col("edits") <= distance)
    return near


def match_fuzzy(
    postings: DataFrame, stats: DataFrame, term: str, distance: int = 2, swaps: bool = False,
    directory: Settled | None = None,
) -> DataFrame:
    """``(doc_id, edits)``: documents with a word close to ``term`` and the fewest edits it takes."""
    near = ask(fuzzy_terms(stats, term, distance, swaps), directory)
    return with_terms(postings, near).groupBy("doc_id").agg(F.min("edits").alias("edits"))
