"""Search tables: stored fields, vectors, exact terms, postings and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrank.functions.binding import let
from mailrank.functions.text import (
    EMBED_CHARS,
    fill_blank,
    flag_to_int,
    phone_digits,
    strip_ws,
    text_to_embed,
    with_role,
    word_tokens,
)
from mailrank.operators.embed import Embedder, embed_column


def stored_fields(emails: DataFrame) -> DataFrame:
    """The fields a hit is shown with: strings never null, the flag as 0/1."""
    texts = ("message_id", "from_email", "from_name", "all_recipients", "subject", "body_content")
    return emails.select(
        "doc_id",
        *[fill_blank(F.col(c)).alias(c) for c in texts],
        "timestamp_ms",
        flag_to_int(F.col("has_attachments")).alias("has_attachments"),
        fill_blank(F.col("labels")).alias("labels"),
    )


def vector_table(emails: DataFrame, embedder: Embedder, embed_chars: int = EMBED_CHARS) -> DataFrame:
    """``(doc_id, vec, embed_error)`` of the first ``embed_chars`` characters of subject and body."""
    text = with_role(text_to_embed(F.col("subject"), F.col("body_content"), embed_chars), "document")
    return embed_column(emails.select("doc_id", text.alias("_text")), "_text", embedder).drop("_text")


def exact_terms(emails: DataFrame, normalise: bool = False) -> DataFrame:
    """``(field, term, doc_id)`` of senders and phone numbers, from one scan.

    Senders are kept as written while look-ups are lower-cased, so a sender with
    capitals is not found unless ``normalise`` lower-cases this side too.
    """
    sender = fill_blank(F.col("from_email"))
    sender = strip_ws(F.lower(sender)) if normalise else sender
    entries = F.array(
        F.struct(F.lit("sender_email").alias("field"), sender.alias("term")),
        F.struct(F.lit("phone_num").alias("field"), fill_blank(phone_digits(F.col("body_content"))).alias("term")),
    )
    # The outer generators of this module spare Spark a filter that repeats their input.
    return (
        emails.select("doc_id", F.inline_outer(F.filter(entries, lambda e: e["term"] != "")))
        .where(F.col("term").isNotNull())
        .select("field", "term", "doc_id")
    )


def body_tokens(docs: DataFrame, text_col: str = "body_content") -> DataFrame:
    """``(doc_id, pos, term)``: every word of every text."""
    words = F.posexplode_outer(word_tokens(F.col(text_col))).alias("pos", "term")
    return docs.select("doc_id", words).where(F.col("term").isNotNull())


def _term_runs(tokens: Column) -> Column:
    """``array<struct<term, tf, positions>>`` of one text's tokens.

    Tokens are sorted with their positions, then cut where the term changes. All of it
    happens inside the row, so building postings needs no shuffle and no grouping.
    """
    pairs = F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))

    def cut(p):
        def term_at(i):
            return F.get(p, i)["term"]

        starts = F.filter(
            F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (term_at(i) != term_at(i - 1))
        )

        def run(s):
            def entry(start, j):
                length = F.coalesce(F.get(s, j + 1), F.size(p)) - start
                return F.struct(
                    term_at(start).alias("term"),
                    length.alias("tf"),
                    F.slice(p, start + 1, length)["pos"].alias("positions"),
                )

            return F.transform(s, entry)

        return let(starts, run)

    return let(pairs, cut)


def doc_terms(docs: DataFrame, text_col: str = "body_content") -> DataFrame:
    """``(doc_id, dl, runs)``; ``runs`` is null for a text without words."""
    return docs.select("doc_id", word_tokens(F.col(text_col)).alias("_tokens")).select(
        "doc_id",
        F.size("_tokens").alias("dl"),
        F.when(F.size("_tokens") > 0, _term_runs(F.col("_tokens"))).alias("runs"),
    )


def postings(docs: DataFrame, text_col: str = "body_content") -> DataFrame:
    """``(term, doc_id, tf, dl, positions)``; the document length rides along for scoring."""
    return (
        doc_terms(docs, text_col)
        .select("doc_id", "dl", F.inline_outer("runs"))
        .where(F.col("term").isNotNull())
        .select("term", "doc_id", "tf", "dl", "positions")
    )


def doc_lengths(docs: DataFrame, text_col: str = "body_content") -> DataFrame:
    """``(doc_id, dl)``: words per text."""
    return docs.select("doc_id", F.size(word_tokens(F.col(text_col))).alias("dl"))


def posted_lengths(postings: DataFrame) -> DataFrame:
    """``(doc_id, dl)`` of texts with words, read off their postings.

    One word of each text stands at position 0, so no grouping is needed.
    """
    return postings.where(F.get("positions", F.lit(0)) == 0).select("doc_id", "dl")


def term_stats(rows: DataFrame) -> DataFrame:
    """``(term, df)`` of postings, ``(field, term, df)`` of exact terms: documents per term."""
    keys = [c for c in ("field", "term") if c in rows.columns]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("df"))


def text_term_stats(docs: DataFrame, text_col: str = "body_content") -> DataFrame:
    """``(term, df)`` straight from texts: each word once per text, no positions."""
    words = F.explode_outer(F.array_distinct(word_tokens(F.col(text_col)))).alias("term")
    return term_stats(docs.select(words).where(F.col("term").isNotNull()))


def field_stats(exact: DataFrame) -> DataFrame:
    """``(field, n_docs)``: documents that have an exact field."""
    return exact.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"))


def corpus_stats(doc_len: DataFrame) -> DataFrame:
    """One row ``(n_docs, avgdl)`` over the texts that have words."""
    n_docs = F.count_if(F.col("dl") > 0)
    return doc_len.agg(n_docs.alias("n_docs"), F.try_divide(F.sum("dl").cast("double"), n_docs).alias("avgdl"))
