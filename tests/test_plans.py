"""What the plans must look like to hold at scale."""

import pytest
from pyspark.sql import functions as F

from checks import recipes
from mailrank.operators import embed, hits, index, keyword, knn, match
from mailrank.operators.parse import headers_long, parse_messages
from mailrank.streaming.ingest import ingest_mail_csv
from mailrank.sources.emails import EMAIL_COLUMNS, read_emails
from mailrank.sources.mail_csv import write_mail_csv


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.col("source").alias("file"), F.col("text").alias("message"))


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return recipes.search_tables(spark, sf_dir)


def test_parsing_and_index_rows_need_no_shuffle(raw):
    mails = parse_messages(raw, keep=("doc_id",))
    made = [
        mails,
        headers_long(raw),
        index.stored_fields(mails),
        index.exact_terms(mails),
        index.body_tokens(mails),
        index.postings(mails),
        index.doc_lengths(mails),
        index.vector_table(mails, embed.hash_embedder()),
    ]
    for df in made:
        assert "Exchange" not in plan(df)


def test_no_python_in_parsing_and_index(raw):
    mails = parse_messages(raw, keep=("doc_id",))
    for df in (index.postings(mails), index.vector_table(mails, embed.hash_embedder())):
        assert "Python" not in plan(df) and "Arrow" not in plan(df)


def test_only_used_columns_are_read(tables):
    asked = match.query_words(tables.docs.sparkSession, {1: ["the"]})
    found = plan(match.match_all(tables.postings, asked, tables.directory))
    assert "ReadSchema: struct<term:string,doc_id:bigint>" in found


def test_terms_prune_files_and_row_groups(spark, tables):
    asked = spark.createDataFrame([(1, t, 1) for t in ("the", "aich")], "qid BIGINT, term STRING, n BIGINT")
    found = plan(
        keyword.bm25(
            tables.postings, tables.term_stats, tables.corpus_stats, asked, directory=tables.directory
        )
    )
    assert "DataFilters: [file_name" in found
    assert "In(term, [aich,the])" in found
    assert "BroadcastHashJoin" in found and "SortMergeJoin" not in found


def test_many_separate_values_reach_the_scan(tables):
    spark = tables.docs.sparkSession
    ranked = spark.createDataFrame([(1, i * 3, 1) for i in range(25)], "qid BIGINT, doc_id BIGINT, rank INT")
    found = plan(hits.hydrate(ranked, tables.docs))
    assert "PushedFilters: [Or(" in found and "In(doc_id" in found


def test_rank_window_keeps_the_best_before_the_shuffle(spark):
    scored = spark.range(1000).select((F.col("id") % 3).alias("qid"), F.col("id").alias("doc_id"), F.rand().alias("score"))
    found = plan(knn.top_k(scored, 5))
    assert found.count("WindowGroupLimit") == 2


def test_large_asks_are_not_broadcast(spark, tables, monkeypatch):
    from mailrank import session

    monkeypatch.setattr(session, "SMALL_ROWS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    asked = match.query_words(spark, {1: ["the", "of"]})
    found = plan(match.match_any(tables.postings, asked, tables.directory))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in found
    # What is shuffled of the postings has passed the filter of asked words, which is broadcast.
    scan = found.index("FileScan parquet", found.index("getbit"))
    assert "Exchange hashpartitioning" not in found[found.index("getbit"):scan].split("BroadcastExchange")[0]


def files_read(df):
    """How many files the one scan of a plan opens."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.size() == 1
    return leaves.apply(0).metrics().apply("numFiles").value()


def test_a_term_meets_few_files(spark, tables):
    files = tables.directory.rows.to_pylist()
    at = {f["file"]: f for f in files}
    posted = tables.postings.groupBy("term", F.col("_metadata.file_name").alias("file")).count().collect()
    homes = {}
    for r in posted:
        homes.setdefault(r.term, []).append(r.file)
        assert at[r.file]["first_term"] <= r.term <= at[r.file]["last_term"]
    # Ranges: a term that is in a third file fills the one between.
    for term, held in homes.items():
        filled = [f for f in held if at[f]["first_term"] == term == at[f]["last_term"]]
        assert len(held) - len(filled) <= 2
    rare = min((t for t, held in homes.items() if len(held) == 1), key=len)
    asked = keyword.ask(match.query_words(spark, {1: [rare]}), tables.directory)
    assert files_read(tables.postings.where(F.col("_metadata.file_name").isin(asked.files))) == 1


def test_a_frequent_term_is_split_by_document(spark, tmp_path):
    from mailrank.plans.build import build_search_tables

    columns = "message_id STRING, from_email STRING, from_name STRING, all_recipients STRING, subject STRING, body_content STRING, labels STRING"
    mails = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        *[F.lit("").alias(c.split()[0]) for c in columns.split(", ") if "body" not in c],
        F.concat(F.lit("often word"), (F.col("id") % 7).cast("string")).alias("body_content"),
        F.lit(0).cast("bigint").alias("timestamp_ms"), F.lit(False).alias("has_attachments"),
    )
    made = build_search_tables(mails, embed.hash_embedder(), str(tmp_path), 8)
    spans = made.postings.where("term = 'often'").groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")
    ).orderBy("lo").collect()
    assert len(spans) >= 3 and max(s.n for s in spans) < 2000
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]))


def test_posting_files_grow_with_the_text(spark, tmp_path, monkeypatch):
    from mailrank.plans import build

    texts = ("message_id", "from_email", "from_name", "all_recipients", "subject", "labels")
    mails = spark.range(600).select(
        F.col("id").alias("doc_id"), *[F.lit("").alias(c) for c in texts],
        F.concat(F.lit("often word"), F.col("id").cast("string")).alias("body_content"),
        F.lit(0).cast("bigint").alias("timestamp_ms"), F.lit(False).alias("has_attachments"),
    )
    monkeypatch.setattr(build, "TEXT_PER_FILE", 300)
    made = build.build_search_tables(mails, embed.hash_embedder(), str(tmp_path))
    sizes = made.postings.groupBy(F.col("_metadata.file_name").alias("file")).count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) < 200
    assert sum(r["count"] for r in sizes) == 1200 and made.corpus_stats.first().n_docs == 600


def test_the_directory_sorts_words_not_postings(tables):
    found = keyword.term_directory(tables.postings)
    whole = plan(found)
    assert whole.count("HashAggregate(key") >= 2 and whole.rindex("HashAggregate") > whole.rindex("SortAggregate")
    want = tables.postings.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min("term").alias("first_term"), F.max("term").alias("last_term"), F.count("*").alias("n_rows")
    )
    assert sorted(found.collect()) == sorted(want.collect())


def test_directory_too_large_to_hold_gives_the_same_files(spark, tables):
    from mailrank.session import Settled

    spread = Settled(tables.directory.df, None)
    for terms in (["the"], ["aich", "the", "zz"], [], ["0", "~"]):
        assert keyword.files_holding(spread, terms) == keyword.files_holding(tables.directory, terms)


def test_many_terms_still_pick_files(spark, tables):
    words = [r.term for r in tables.term_stats.where("term < 'c'").select("term").collect()]
    many = words + [f"a{i}" for i in range(1500)]
    asked = keyword.ask(match.query_words(spark, {1: many}).select("qid", "term").distinct(), tables.directory)
    spans = {f["file"]: f for f in tables.directory.rows.to_pylist()}
    assert asked.files and all(spans[f]["first_term"] < "c" for f in asked.files) and len(asked.files) < len(spans)
    assert match.match_any(tables.postings, match.query_words(spark, {1: many}), tables.directory).count() == (
        tables.postings.where("term < 'c'").select("doc_id").distinct().count()
    )


def test_sifting_keeps_all_that_is_asked(spark):
    from mailrank.session import sift

    rows = spark.range(20_000).select((F.col("id") % 5000).cast("int").alias("doc_id"), F.col("id").alias("n"))
    asked = spark.range(0, 5000, 50).select(F.col("id").alias("doc_id"))
    left = sift(rows, asked, ["doc_id"])
    assert left.columns == rows.columns
    assert left.join(asked, "doc_id").count() == 400
    assert left.count() < 4000
    assert sift(rows, asked.where("doc_id < 0"), ["doc_id"]).count() == 0
    assert sift(rows.where("n < 0"), asked, ["doc_id"]).count() == 0


def test_stream_equals_batch(spark, raw, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    mails = raw.withColumn("message", F.concat(F.lit("Subject: s\n\n"), "message"))
    write_mail_csv(mails.where("doc_id % 2 = 0"), folder)
    ingest_mail_csv(spark, folder, out, state, on_bad_date=0).awaitTermination()
    mails.where("doc_id % 2 = 1").select("file", "message").write.mode("append").options(
        header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(folder)
    # The second run takes only the files that are new.
    ingest_mail_csv(spark, folder, out, state, on_bad_date=0).awaitTermination()
    want = parse_messages(mails, 0).select(*EMAIL_COLUMNS)
    assert sorted(read_emails(spark, out).collect()) == sorted(want.collect())
