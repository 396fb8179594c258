"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks import recipes as r
from mailrank.functions import mail, text, vectors as vec
from mailrank.operators import (
    cells, dictionary, embed, fusion, hits, index, ivf, keyword, knn, match, parse, quantise, sharded,
)
from mailrank.operators.queries import normalise_queries, target_terms
from mailrank.plans.build import build_search_tables
from mailrank.plans.search import hybrid_search, keyword_search
from mailrank.plans.vector_index import build_vector_index
from mailrank.session import fresh_path
from mailrank.sources import emails as em
from mailrank.sources.mail_csv import MAIL_CSV_WRITE_OPTIONS, read_mail_csv, write_mail_csv

QUERIES = {}
IVF_CELLS = 8
WORDS = {1: ["the", "of", "and"], 2: ["de", "la"], 3: ["und", "der"]}
DOUBLE_WORDS = {1: ["the", "the"], 2: ["de", "la", "de"], 3: ["und", "die", "und"]}
CAP = 100


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# Sources and sinks


@query
def mail_csv_read(spark, sf_dir):
    path = fresh_path(spark, "csv")
    write_mail_csv(r.raw_messages(spark, sf_dir), path)
    return read_mail_csv(spark, path).select("file", F.md5("message").alias("message_md5"), F.length("message").alias("n_chars"))


@query
def mail_csv_two_headers(spark, sf_dir):
    """Half of the messages under one order of columns, half under the other and one column more."""
    raw, paths = r.raw_messages(spark, sf_dir), [fresh_path(spark, "csv"), fresh_path(spark, "csv")]
    write_mail_csv(raw.where("doc_id % 2 = 0"), paths[0])
    other = raw.where("doc_id % 2 = 1").select("message", F.col("doc_id").cast("string").alias("extra"), "file")
    other.write.options(**MAIL_CSV_WRITE_OPTIONS).csv(paths[1])
    return read_mail_csv(spark, paths).select("file", F.md5("message").alias("message_md5"))


@query
def row_cap(spark, sf_dir):
    return em.cap_rows(r.mails(spark, sf_dir).select("doc_id", "message_id"), CAP, ["doc_id"])


@query
def emails_append(spark, sf_dir):
    path = fresh_path(spark, "emails")
    mails = r.mails(spark, sf_dir)
    em.write_emails(mails, path)
    em.write_emails(mails, path)
    return em.read_emails(spark, path).groupBy("message_id", "labels").agg(F.count(F.lit(1)).alias("n_copies"))


@query
def emails_row_id(spark, sf_dir):
    rows = r.mails(spark, sf_dir).select("doc_id", "message_id")
    return em.with_row_id(rows, ["doc_id"]).select("id", "message_id")


@query
def emails_scan(spark, sf_dir):
    path = fresh_path(spark, "emails")
    em.write_emails(r.mails(spark, sf_dir), path)
    return em.read_emails(spark, path)


@query
def emails_count(spark, sf_dir):
    return em.count_rows(r.mails(spark, sf_dir))


@query
def emails_sample(spark, sf_dir):
    return em.sample_rows(r.mails(spark, sf_dir), 3, "doc_id")


@query
def search_tables_build(spark, sf_dir):
    path = fresh_path(spark, "tables")
    tables = build_search_tables(r.mails(spark, sf_dir), embed.hash_embedder(), path)
    counts = [
        getattr(tables, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        for name in ("docs", "vectors", "exact_terms", "postings", "term_stats", "corpus_stats")
    ]
    union = counts[0]
    for one in counts[1:]:
        union = union.unionByName(one)
    return union


@query
def hit_report(spark, sf_dir):
    searches = r.searches(spark, sf_dir)
    found = hybrid_search(r.search_tables(spark, sf_dir), searches, embed.hash_embedder())
    return hits.format_hits(found, searches)


@query
def hit_dates(spark, sf_dir):
    """Dates of the years 1, 1899, 2044 and 9999, a few odd seconds apart."""
    n = F.col("doc_id")
    year = F.pmod(n, F.lit(4))
    start = F.when(year == 0, -62_135_596_800_000).when(year == 1, -2_240_524_800_000).when(year == 2, 2_335_219_200_000)
    millis = start.otherwise(253_370_764_800_000) + F.pmod(n, F.lit(300_000)) * 100_003
    return r.documents(spark, sf_dir).select("doc_id", hits.hit_date(millis).alias("date"))


# Message parsing


@query
def parse_empty_message(spark, sf_dir):
    kind = F.pmod("doc_id", F.lit(5))
    message = F.when(kind == 0, F.lit("")).when(kind > 1, F.col("message"))
    return parse.parse_messages(r.raw_messages(spark, sf_dir).withColumn("message", message), on_bad_date=7)


@query
def mail_line_count(spark, sf_dir):
    crlf = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    return r.documents(spark, sf_dir).select("doc_id", F.size(mail.message_lines(crlf)).alias("n_lines"))


@query
def parse_header_body(spark, sf_dir):
    return parse.split_headers_body(r.raw_messages(spark, sf_dir))


@query
def parse_headers_long(spark, sf_dir):
    return parse.headers_long(r.raw_messages(spark, sf_dir))


@query
def parse_folded_headers(spark, sf_dir):
    return parse.headers_long(r.folded_turns(spark, sf_dir))


@query
def header_last_wins(spark, sf_dir):
    heads = parse.parse_headers(r.folded_turns(spark, sf_dir))
    return heads.select(
        "file",
        mail.header_value(F.col("headers"), "role").alias("role"),
        mail.header_value(F.col("headers"), "none").alias("none"),
    )


@query
def parse_messages_core(spark, sf_dir):
    return r.mails(spark, sf_dir)


@query
def sender_name(spark, sf_dir):
    # Page texts hold many "<", the first of them near the start or further in.
    pages = r.table(spark, sf_dir, "pages")
    value = F.concat(F.lit("\t "), F.col("url"), F.lit(" "), F.col("html"))
    return pages.select(
        "page_id", mail.sender_name(value).alias("from_name"), mail.sender_name(F.col("url")).alias("bare_name")
    )


@query
def all_recipients(spark, sf_dir):
    parts = r.raw_messages(spark, sf_dir)
    return parse.parse_messages(parts, keep=("doc_id",)).select("doc_id", "all_recipients")


@query
def mail_date_parse(spark, sf_dir):
    """Dates in the mail form from every order date, some of them malformed."""
    day = F.col("o_orderdate").cast("timestamp_ntz")
    n = F.pmod("o_orderkey", F.lit(5))
    good = F.concat(F.date_format(day, "EEE, d MMM yyyy"), F.lit(" 10:20:30 -0730 (PDT)"))
    written = (
        F.when(n == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(n == 2, F.concat(F.date_format(day, "EEE, d MMM yyyy"), F.lit(" 10:20:30 -0730")))
        .when(n == 3, F.concat(F.lit("Mon"), F.substring(good, 4, 100)))
        .otherwise(good)
    )
    return r.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        mail.parse_mail_date(written, on_bad=-1).alias("timestamp_ms"),
        mail.parse_mail_date(written, on_bad=-1, strict_weekday=False).alias("any_weekday_ms"),
    )


@query
def attachment_flag(spark, sf_dir):
    return r.mails(spark, sf_dir).groupBy("has_attachments").agg(F.count(F.lit(1)).alias("n_mails"))


@query
def body_normalise(spark, sf_dir):
    raw = r.raw_messages(spark, sf_dir)
    crlf = raw.withColumn("message", F.replace(F.concat("message", F.lit("\n \n\n")), F.lit("\n"), F.lit("\r\n")))
    return parse.parse_messages(crlf, keep=("doc_id",)).select("doc_id", "body_content")


@query
def clean_snippet(spark, sf_dir):
    return r.documents(spark, sf_dir).select("doc_id", text.clean_snippet(F.col("text")).alias("snippet"))


# Scalar text


@query
def phone_digits(spark, sf_dir):
    return r.documents(spark, sf_dir).select("doc_id", text.phone_digits(F.col("text")).alias("phone"))


@query
def text_to_embed(spark, sf_dir):
    made = text.text_to_embed(F.col("subject"), F.col("body_content"))
    return r.mails(spark, sf_dir).select("doc_id", made.alias("embed_text"))


@query
def role_prefix(spark, sf_dir):
    c = F.col("text")
    return r.table(spark, sf_dir, "benchmark").select(
        "item_id", text.with_role(c, "document").alias("as_document"), text.with_role(c, "query").alias("as_query")
    )


@query
def stored_fields(spark, sf_dir):
    gone = F.when(F.pmod("doc_id", F.lit(6)) > 0, F.col("subject"))
    return index.stored_fields(r.mails(spark, sf_dir).withColumn("subject", gone))


@query
def exact_term_key(spark, sf_dir):
    key = text.exact_key(F.concat(F.lit("\t "), "from_email", F.lit(" \n")))
    return r.mails(spark, sf_dir).select("doc_id", "from_email", key.alias("lookup_key"))


@query
def flag_roundtrip(spark, sf_dir):
    kept = em.flags_as_int(r.mails(spark, sf_dir))
    return kept.select(
        "doc_id",
        F.col("has_attachments").alias("stored"),
        text.flag_from_text(F.col("has_attachments").cast("string")).alias("read_back"),
    )


@query
def safe_millis(spark, sf_dir):
    kind = F.pmod("doc_id", F.lit(4))
    stored = (
        F.when(kind == 1, F.lit("")).when(kind == 2, F.col("message_id")).when(kind == 3, F.col("timestamp_ms").cast("string"))
    )
    return r.mails(spark, sf_dir).select("doc_id", text.safe_millis(stored, -5).alias("millis"))


@query
def query_normalise(spark, sf_dir):
    return normalise_queries(r.searches(spark, sf_dir))


@query
def hit_snippet(spark, sf_dir):
    return r.documents(spark, sf_dir).select("doc_id", text.hit_snippet(F.col("text")).alias("snippet"))


# Embedding


def _long(df, key, column, digits=None):
    """One row per vector element."""
    value = F.col("value").cast("double")
    return df.select(key, F.posexplode_outer(column).alias("pos", "value")).select(
        key, "pos", (F.round(value, digits) if digits else F.col("value")).alias("value")
    )


@query
def hash_embedding(spark, sf_dir):
    docs = r.documents(spark, sf_dir)
    return _long(docs.select("doc_id", vec.hash_embedding(F.col("text")).alias("v")), "doc_id", "v", 5)


@query
def l2_normalise(spark, sf_dir):
    scaled = F.transform("vec", lambda x: x.cast("double") * (F.col("doc_id") % 5))
    rows = r.vectors(spark, sf_dir).select("doc_id", vec.l2_normalise(scaled).alias("v"))
    return _long(rows, "doc_id", "v", 5)


@query
def blank_zero_vector(spark, sf_dir):
    blanked = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit(" \n\t ")).otherwise(F.col("text"))
    v = r.documents(spark, sf_dir).select("doc_id", vec.hash_embedding(blanked).alias("v"))
    return v.select("doc_id", F.size("v").alias("dim"), F.forall("v", lambda x: x == 0).alias("all_zero"))


@query
def vocab_load(spark, sf_dir):
    """A tokenizer file of the characters of all documents, read back as a table."""
    docs = r.documents(spark, sf_dir).select(F.explode(F.array_distinct(F.split("text", ""))).alias("token"))
    chars = docs.where("token != ''").distinct().select("token", F.ascii("token").cast("bigint").alias("id"))
    added = F.array(*[F.struct(F.lit(t).alias("content"), F.lit(i).cast("bigint").alias("id")) for t, i in (("<bos>", 2), ("<eos>", 3), ("e", 99))])
    # The characters of any text are a bounded set, so one row can hold them.
    whole = chars.agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("vocab"))
    path = fresh_path(spark, "tokenizer")
    whole.select(F.to_json(F.struct(F.struct("vocab").alias("model"), added.alias("added_tokens"))).alias("value")).write.text(path)
    return embed.load_vocab(spark, path)


def _word_vocab(spark, sf_dir):
    """Words of at least two documents; an id is made of the word's first place."""
    words = r.documents(spark, sf_dir).select(
        "doc_id", F.posexplode(F.split(text.strip_ws(F.lower("text")), r"[ \t\n\x0b\f\r]+")).alias("pos", "token")
    )
    known = words.groupBy("token").agg(
        F.min(F.col("doc_id") * 1_000_000 + F.col("pos")).alias("first"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")
    )
    marks = spark.createDataFrame([("<bos>", 2), ("<eos>", 3)], "token STRING, id BIGINT")
    return known.where("lo < hi AND token != ''").select("token", (F.col("first") + 10).alias("id")).unionByName(marks)


@query
def token_ids(spark, sf_dir):
    coded = embed.encode_tokens(r.documents(spark, sf_dir), "text", _word_vocab(spark, sf_dir))
    return coded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id"))


@query
def token_ids_equal_keys(spark, sf_dir):
    """Many rows of one ``doc_id`` and a vocabulary that is joined: rows keep their own words."""
    docs = r.documents(spark, sf_dir).select(F.pmod("doc_id", F.lit(3)).alias("doc_id"), "text")
    coded = embed.encode_tokens(docs, "text", _word_vocab(spark, sf_dir), vocab_rows=1)
    return coded.select("doc_id", F.md5(F.array_join("ids", " ")).alias("ids_md5"))


def _remainder_model():
    return lambda ids, mask: np.stack([ids % 7, ids % 11, mask], axis=-1).astype(np.float32)


@query
def model_embed_batch(spark, sf_dir):
    coded = embed.encode_tokens(r.documents(spark, sf_dir), "text", _word_vocab(spark, sf_dir))
    run = embed.model_embed(coded.select("doc_id", "ids"), "ids", _remainder_model, pool=False)
    return run.select("doc_id", F.posexplode_outer("vec").alias("pos", "v")).select(
        "doc_id", "pos", *[F.get("v", F.lit(i)).cast("double").alias(f"v{i}") for i in range(3)]
    )


@query
def mean_pool(spark, sf_dir):
    return _long(embed.mean_pool(r.vectors(spark, sf_dir), ["label"]), "label", "vec", 8)


@query
def vector_dim_report(spark, sf_dir):
    cut = F.when(F.pmod("doc_id", F.lit(10)) == 0, F.slice("vec", 1, 32)).otherwise(F.col("vec"))
    return embed.dim_report(r.vectors(spark, sf_dir).withColumn("vec", cut), 64)


def _picky_model():
    def run(texts):
        if any(ch.isascii() and ch.isdigit() for t in texts for ch in t):
            raise ValueError("digits")
        return [np.array([len(t), 1.0]) for t in texts]

    return run


@query
def embed_fallback(spark, sf_dir):
    done = embed.embed_column(r.documents(spark, sf_dir), "text", embed.BatchEmbedder(_picky_model, 2))
    return done.select(
        "doc_id", F.get("vec", F.lit(0)).cast("double").alias("v0"), F.get("vec", F.lit(1)).cast("double").alias("v1"), "embed_error"
    )


@query
def cosine_pairs(spark, sf_dir):
    """Every vector against the mean of its label."""
    rows = r.vectors(spark, sf_dir)
    means = F.broadcast(embed.mean_pool(rows, ["label"], out="center"))  # one row per label
    return rows.join(means, "label").select("doc_id", F.round(vec.cosine(F.col("vec"), F.col("center")), 8).alias("cosine"))


# Search tables


@query
def vector_table(spark, sf_dir):
    made = index.vector_table(r.mails(spark, sf_dir), embed.hash_embedder())
    return _long(made, "doc_id", "vec", 5)


@query
def exact_terms(spark, sf_dir):
    return index.exact_terms(r.mails(spark, sf_dir))


@query
def body_tokens(spark, sf_dir):
    return index.body_tokens(r.mails(spark, sf_dir))


@query
def postings(spark, sf_dir):
    return index.postings(r.mails(spark, sf_dir)).withColumn("positions", F.array_join("positions", " "))


@query
def doc_lengths(spark, sf_dir):
    return index.doc_lengths(r.mails(spark, sf_dir))


@query
def term_stats(spark, sf_dir):
    return index.text_term_stats(r.mails(spark, sf_dir))


@query
def corpus_stats(spark, sf_dir):
    done = index.corpus_stats(index.doc_lengths(r.mails(spark, sf_dir)))
    return done.withColumn("avgdl", F.round("avgdl", 6))


@query
def quantise_int8(spark, sf_dir):
    rows = r.vectors(spark, sf_dir)
    codes = quantise.quantise_int8(rows, quantise.value_bounds(rows))
    return codes.select("doc_id", F.posexplode_outer("codes").alias("pos", "code"))


@query
def quantise_error(spark, sf_dir):
    rows = r.vectors(spark, sf_dir)
    bounds = quantise.value_bounds(rows)
    report = quantise.quantisation_error(rows, quantise.quantise_int8(rows, bounds), bounds)
    return report.withColumns({c: F.round(c, 8) for c in ("max_error", "mean_error")})


@query
def ivf_assign(spark, sf_dir):
    """Each vector's cell, and whether another centre would have been nearer."""
    centroids, cells = ivf.build_ivf(r.vectors(spark, sf_dir), IVF_CELLS)
    nearest = knn.probe_cells(centroids, cells.select(F.col("doc_id").alias("qid"), "vec"), 1)
    both = cells.join(nearest.select(F.col("qid").alias("doc_id"), F.col("cell").alias("near")), "doc_id", "left")
    return both.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(~F.col("cell").eqNullSafe(F.col("near"))).alias("n_wrong")
    )


# Retrieval


def _label_queries(spark, sf_dir):
    return embed.mean_pool(r.vectors(spark, sf_dir), ["label"]).select(F.col("label").cast("bigint").alias("qid"), "vec")


@query
def knn_exact(spark, sf_dir):
    return knn.knn(r.vectors(spark, sf_dir), _label_queries(spark, sf_dir), 20)


@query
def knn_ragged(spark, sf_dir):
    """Every fifth vector is null, every fifth lacks its last numbers."""
    kind = F.pmod("doc_id", F.lit(5))
    vec = F.when(kind == 1, F.slice("vec", 1, 10)).when(kind > 1, F.col("vec"))
    rows = r.vectors(spark, sf_dir).withColumn("vec", vec)
    return knn.knn(rows, _label_queries(spark, sf_dir), 20, drop_odd=True)


@query
def knn_ivf(spark, sf_dir):
    """All cells probed, so the result is the exact one."""
    centroids, cells = ivf.build_ivf(r.vectors(spark, sf_dir), IVF_CELLS)
    return knn.knn_ivf(cells, centroids, _label_queries(spark, sf_dir), 20, IVF_CELLS)


FEW_RECALL = 0.95


@query
def knn_ivf_few_cells(spark, sf_dir):
    """Two levels of cells, as many of them looked into as hold 95 % of the exact neighbours, then all that may hold the rest."""
    asked = _label_queries(spark, sf_dir)
    made = cells.build_cells(r.vectors(spark, sf_dir), cell_rows=50).write(fresh_path(spark, "cells"))
    nprobe, coarse_probes, _ = cells.choose_probes(made, asked, 20, FEW_RECALL)
    return cells.knn_cells(made, asked, 20, nprobe, coarse_probes, whole=True)


@query
def knn_cells_fixed(spark, sf_dir):
    """Two levels of cells with given centres: vectors 0 to 3, and 0 to 35 below them."""
    rows = r.vectors(spark, sf_dir)
    coarse = rows.where("doc_id < 4").select(F.col("doc_id").cast("int").alias("cell"), F.col("vec").cast("array<double>").alias("center"))
    below = rows.where("doc_id < 36").select("doc_id", "vec")
    homes = cells.assign(below, coarse, coarse.select(F.col("cell").alias("doc_id"), F.col("center").alias("vec"), "cell")).vectors
    fine = homes.select(F.col("doc_id").cast("int").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec"), F.col("coarse").alias("cell"))
    made = cells.assign(rows, coarse, fine).write(fresh_path(spark, "cells"))
    return cells.knn_cells(made, _label_queries(spark, sf_dir), 20, 9, 2)


@query
def knn_cells_int8(spark, sf_dir):
    """Codes laid out by cell, all cells probed, the best ranked again by full vectors."""
    rows = r.vectors(spark, sf_dir)
    made = build_vector_index(rows, fresh_path(spark, "vectors"), IVF_CELLS)
    return made.leg(IVF_CELLS, rows)(_label_queries(spark, sf_dir), 20, None)


@query
def knn_int8(spark, sf_dir):
    rows = r.vectors(spark, sf_dir)
    bounds = quantise.value_bounds(rows)
    return knn.knn_int8(quantise.quantise_int8(rows, bounds), bounds, _label_queries(spark, sf_dir), 20)


@query
def knn_int8_rescored(spark, sf_dir):
    rows = r.vectors(spark, sf_dir)
    bounds = quantise.value_bounds(rows)
    codes = quantise.quantise_int8(rows, bounds)
    return knn.knn_int8(codes, bounds, _label_queries(spark, sf_dir), 20, vectors=rows)


@query
def match_sender(spark, sf_dir):
    tables = r.search_tables(spark, sf_dir)
    terms = target_terms(normalise_queries(r.searches(spark, sf_dir)))
    return keyword.match_exact(tables.exact_terms, terms, "sender_email", tables.directory).select("qid", "doc_id")


@query
def match_phone(spark, sf_dir):
    """Every number found in a body asks for the documents it occurs in."""
    tables = r.search_tables(spark, sf_dir)
    numbers = r.documents(spark, sf_dir).select("doc_id", text.phone_digits(F.col("text")).alias("phone"))
    asked = numbers.where("phone != ''").groupBy("phone").agg(F.min("doc_id").alias("qid")).select(
        "qid", F.lit("").alias("query_text"), F.regexp_replace("phone", "^(...)", "($1) ").alias("target"),
        F.lit(20).alias("max_results"),
    )
    found = keyword.match_exact(tables.exact_terms, target_terms(asked), "phone_num", tables.directory)
    return found.select("qid", "doc_id")


def _bm25(spark, sf_dir, **options):
    tables = r.search_tables(spark, sf_dir)
    terms = target_terms(normalise_queries(r.text_searches(spark, sf_dir))).where("field = 'body_text'")
    return keyword.bm25(
        tables.postings, tables.term_stats, tables.corpus_stats, terms, directory=tables.directory, **options
    )


@query
def bm25_any(spark, sf_dir):
    return _bm25(spark, sf_dir).withColumn("score", F.round("score", 8))


@query
def bm25_top(spark, sf_dir):
    """The 20 best of every benchmark text, shards that cannot hold any of them left out."""
    tables = r.search_tables(spark, sf_dir)
    terms = target_terms(normalise_queries(r.text_searches(spark, sf_dir))).where("field = 'body_text'")
    shards = r.sharded_postings(spark, sf_dir)
    return _ranked(sharded.bm25_top(shards, tables.term_stats, terms, 20, directory=tables.directory))


@query
def bm25_byte_length(spark, sf_dir):
    return _bm25(spark, sf_dir, lossy_length=True).withColumn("score", F.round("score", 8))


@query
def match_raw_term(spark, sf_dir):
    """The first word of every benchmark text, asked for as one untouched term."""
    tables = r.search_tables(spark, sf_dir)
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("qid"), F.lit("").alias("query_text"), F.substring_index("text", " ", 1).alias("target"), F.lit(20).alias("max_results")
    )
    found = keyword.match_raw_term(
        tables.postings, tables.term_stats, tables.corpus_stats, asked, directory=tables.directory
    )
    return found.withColumn("score", F.round("score", 8))


def _ranked(df):
    return df.select("qid", "doc_id", "rank", F.round("score", 8).alias("score"))


def _keyword_search(spark, sf_dir):
    asked = normalise_queries(r.searches(spark, sf_dir))
    return _ranked(keyword_search(r.search_tables(spark, sf_dir), asked, 100))


QUERIES["keyword_search"] = _keyword_search


@query
def rrf_contrib(spark, sf_dir):
    ranked = knn.knn(r.vectors(spark, sf_dir), _label_queries(spark, sf_dir), 20)
    return fusion.rrf_scores(ranked).select("qid", "doc_id", "rank", F.round("rrf", 9).alias("rrf"))


def _fused(spark, sf_dir):
    rows = r.vectors(spark, sf_dir)
    asked = _label_queries(spark, sf_dir)
    near = knn.knn(rows, asked, 20)
    longest = F.array_max(F.transform("vec", lambda x: x.cast("double")))
    # A second ranking of the same documents: by each vector's largest value, per label.
    spikes = rows.select(F.col("label").cast("bigint").alias("qid"), "doc_id", longest.alias("score"))
    return fusion.rrf_fuse({"semantic": near, "keyword": knn.top_k(spikes, 20)})


@query
def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir).withColumn("rrf_score", F.round("rrf_score", 9))


@query
def hybrid_topk(spark, sf_dir):
    ranked = knn.top_k(_fused(spark, sf_dir), 20, score="rrf_score", digits=None)
    return ranked.withColumn("rrf_score", F.round("rrf_score", 9))


@query
def hydrate_hits(spark, sf_dir):
    """Fused documents with their stored fields; vectors beyond the documents are skipped."""
    ranked = knn.top_k(_fused(spark, sf_dir), 20, score="rrf_score", digits=None)
    return hits.project_hits(hits.hydrate(ranked, r.search_tables(spark, sf_dir).docs))


def _hybrid(spark, sf_dir, searches, **options):
    return hybrid_search(r.search_tables(spark, sf_dir), searches, embed.hash_embedder(), **options)


def _hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir, r.searches(spark, sf_dir))


QUERIES["hybrid_search"] = _hybrid_search


@query
def hybrid_search_cells(spark, sf_dir):
    """The vector leg over the compact index: every cell's codes, the best ranked again by full vectors."""
    leg = r.vector_index(spark, sf_dir).leg(r.CELLS, r.search_tables(spark, sf_dir).vectors)
    return _hybrid(spark, sf_dir, r.searches(spark, sf_dir), leg=leg)


@query
def semantic_only(spark, sf_dir):
    asked = r.searches(spark, sf_dir).withColumn("target", F.lit("-"))
    return _hybrid(spark, sf_dir, asked).select("qid", "rank", "doc_id", "rrf_score", "semantic_rank")


@query
def search_neither(spark, sf_dir):
    """Searches with neither a text nor a target have no hits."""
    asked = r.searches(spark, sf_dir).withColumns({"query_text": F.lit("-"), "target": F.lit(" ")})
    return _hybrid(spark, sf_dir, asked).select("qid", "rank", "doc_id", "rrf_score")


@query
def search_mixed_legs(spark, sf_dir):
    """One batch in which every third search has neither a text nor a target."""
    none = F.pmod("qid", F.lit(3)) == 0
    asked = r.searches(spark, sf_dir)
    asked = asked.withColumns({c: F.when(none, F.lit("-")).otherwise(F.col(c)) for c in ("query_text", "target")})
    return _hybrid(spark, sf_dir, asked)


@query
def keyword_only(spark, sf_dir):
    asked = r.searches(spark, sf_dir).withColumn("query_text", F.lit("-"))
    return _hybrid(spark, sf_dir, asked).select("qid", "rank", "doc_id", "rrf_score", "keyword_rank")


# Structured keyword operators


def _benchmark_words(spark, sf_dir):
    """Every benchmark text as a list of words with their places."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("qid"), F.posexplode(text.word_tokens(F.col("text"))).alias("place", "term")
    )


@query
def match_all(spark, sf_dir):
    t = r.search_tables(spark, sf_dir)
    return match.match_all(t.postings, match.query_words(spark, WORDS), t.directory)


@query
def match_none(spark, sf_dir):
    t = r.search_tables(spark, sf_dir)
    every = match.match_any(t.postings, match.query_words(spark, WORDS), t.directory)
    unwanted = match.query_words(spark, {1: ["en"], 2: ["les", "un"], 3: ["die"]})
    return match.match_none(every, t.postings, unwanted, t.directory)


@query
def match_phrase(spark, sf_dir):
    t = r.search_tables(spark, sf_dir)
    return match.match_phrase(t.postings, _benchmark_words(spark, sf_dir), directory=t.directory, stats=t.term_stats)


@query
def match_phrase_slop(spark, sf_dir):
    t = r.search_tables(spark, sf_dir)
    return match.match_phrase(t.postings, match.query_words(spark, WORDS), 3, t.directory, t.term_stats)


@query
def match_phrase_slop_repeats(spark, sf_dir):
    """Phrases that hold a word twice."""
    t = r.search_tables(spark, sf_dir)
    return match.match_phrase(t.postings, match.query_words(spark, DOUBLE_WORDS), 3, t.directory, t.term_stats)


@query
def match_prefix(spark, sf_dir):
    t = r.search_tables(spark, sf_dir)
    return match.match_prefix(t.postings, "aich", t.term_stats, t.directory)


@query
def match_wildcard(spark, sf_dir):
    t = r.search_tables(spark, sf_dir)
    return match.match_wildcard(t.postings, "a?ch*en", t.term_stats, t.directory)


@query
def match_regex(spark, sf_dir):
    t = r.search_tables(spark, sf_dir)
    return match.match_regex(t.postings, "(un|die)[a-m]{2,4}", t.term_stats, t.directory)


@query
def match_fuzzy(spark, sf_dir):
    t = r.search_tables(spark, sf_dir)
    return match.match_fuzzy(t.postings, t.term_stats, "another", 2, directory=t.directory)


@query
def match_fuzzy_swaps(spark, sf_dir):
    t = r.search_tables(spark, sf_dir)
    return match.match_fuzzy(t.postings, t.term_stats, "aihc", 1, swaps=True, directory=t.directory)


@query
def match_range(spark, sf_dir):
    t = r.search_tables(spark, sf_dir)
    return match.match_range(t.postings, "zed", "zz", stats=t.term_stats, directory=t.directory)


@query
def match_patterns(spark, sf_dir):
    """A pattern for every benchmark text, by the grams of the index's words."""
    t = r.search_tables(spark, sf_dir)
    terms = dictionary.pattern_terms(r.dictionary(spark, sf_dir), r.asked_patterns(spark, sf_dir))
    return dictionary.matching_docs(t.postings, terms, t.directory)


def _fuzzy_batch(spark, sf_dir, asked, swaps):
    t = r.search_tables(spark, sf_dir)
    terms = dictionary.fuzzy_words(r.dictionary(spark, sf_dir), asked, swaps)
    found = dictionary.matching_docs(t.postings, terms, t.directory)
    return found.withColumn("score", F.round("score", 8))


@query
def match_fuzzy_words(spark, sf_dir):
    """A misspelt word for every benchmark text, one or two edits allowed."""
    return _fuzzy_batch(spark, sf_dir, r.misspelt_words(spark, sf_dir), False)


@query
def match_fuzzy_swapped(spark, sf_dir):
    """The same with one edit, two neighbouring letters changing places being one."""
    return _fuzzy_batch(spark, sf_dir, r.misspelt_words(spark, sf_dir).withColumn("distance", F.lit(1)), True)


@query
def match_ranges(spark, sf_dir):
    """A word range for every benchmark text."""
    t = r.search_tables(spark, sf_dir)
    terms = dictionary.range_terms(r.dictionary(spark, sf_dir), r.asked_ranges(spark, sf_dir))
    return dictionary.matching_docs(t.postings, terms, t.directory)


@query
def match_clause_sum(spark, sf_dir):
    """Words, a pattern and a misspelt word of every benchmark text in one score."""
    words = _bm25(spark, sf_dir)
    clauses = [words, match_patterns(spark, sf_dir), match_fuzzy_words(spark, sf_dir)]
    return _ranked(knn.top_k(keyword.sum_clauses(clauses, [1.0, 2.0, 0.5]), 20))


@query
def match_boost(spark, sf_dir):
    """Exact fields count three times as much as body words."""
    asked = normalise_queries(r.searches(spark, sf_dir))
    return _ranked(keyword_search(r.search_tables(spark, sf_dir), asked, 100, weights=[3.0, 1.0]))

