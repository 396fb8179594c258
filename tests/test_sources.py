import pytest
from pyspark.sql import functions as F

from mailrank import session
from mailrank.functions.text import phone_digits
from mailrank.operators.parse import parse_messages
from mailrank.sources import emails as em
from mailrank.sources.mail_csv import read_mail_csv, split_mail_csv, write_mail_csv

RAW = [("a/1.", 'From: x\n\n"quoted" body, with comma\n\n tail '), ("a/2.", ""), ("", "Subject: s\n\n\tb")]


def test_csv_round_trip(spark, tmp_path):
    raw = spark.createDataFrame(RAW, "file STRING, message STRING")
    write_mail_csv(raw, str(tmp_path / "csv"))
    assert sorted(map(tuple, read_mail_csv(spark, str(tmp_path / "csv"), 3).collect())) == sorted(RAW)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "m.csv").write_text('extra,message,file\n1,"Subject: a ""b""\r\n\r\nbody",f1\n2,,f2\n')
    rows = {r.file: r.message for r in read_mail_csv(spark, str(tmp_path / "m.csv")).collect()}
    assert set(rows) == {"f1", "f2"} and rows["f2"] == ""
    assert rows["f1"].replace("\r\n", "\n") == 'Subject: a "b"\n\nbody'


def test_csv_headers_of_two_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("file,message\nf1,Subject: a\n")
    (tmp_path / "b.csv").write_text("message,file\nSubject: b,f2\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv")]
    rows = {r.file: r.message for r in read_mail_csv(spark, paths).collect()}
    assert rows == {"f1": "Subject: a", "f2": "Subject: b"}
    with pytest.raises(Exception, match="header"):
        read_mail_csv(spark, str(tmp_path)).collect()


def odd_mails():
    bodies = ['plain', 'a "quoted" word', 'two\nlines', '"', '""\n"', ',\n,', '\n\n\n', "é" * 30 + "\n", "x" * 700 + '"\n' + "y" * 700]
    return [(f"f{i}", f"Subject: {i}\n\n" + bodies[i % len(bodies)] * (1 + i % 3)) for i in range(120)]


def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path):
    rows = odd_mails()
    write_mail_csv(spark.createDataFrame(rows, "file STRING, message STRING").coalesce(1), str(tmp_path / "csv"))
    whole = sorted(map(tuple, read_mail_csv(spark, str(tmp_path / "csv"), split=False).collect()))
    assert whole == sorted(rows)
    size = "spark.sql.files.maxPartitionBytes"
    before, opened = spark.conf.get(size), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for share in ("1500", "211", "64"):
            spark.conf.set(size, share)
            assert spark.read.text(str(tmp_path / "csv")).rdd.getNumPartitions() >= 8
            # Chosen by itself, as the file is larger than a task's share.
            assert sorted(map(tuple, read_mail_csv(spark, str(tmp_path / "csv")).collect())) == whole
        late = split_mail_csv(spark, str(tmp_path / "csv"))
        spark.conf.set(size, "333")
        with pytest.raises(Exception, match="other blocks"):
            late.collect()
    finally:
        spark.conf.set(size, before)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)


def test_split_csv_headers_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('\ufeffextra,message,file\r\n1,"Subject: a ""b""\r\n\r\nbody",f1\r\n2,,f2\r\n\r\n3\r\n'.encode() + b'4,\xff,f4')
    got = {r.file: r.message for r in split_mail_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {"f1": 'Subject: a "b"\r\n\r\nbody', "f2": "", "": "", "f4": "\ufffd"}
    (tmp_path / "b.csv").write_text("message,file\nSubject: b,f2\n")
    with pytest.raises(ValueError, match="header"):
        split_mail_csv(spark, str(tmp_path))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "c.csv").write_text("")
    assert split_mail_csv(spark, str(tmp_path / "none")).count() == 0
    assert {r.file for r in read_mail_csv(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")], split=True).collect()} == {"f1", "f2", "", "f4"}


def test_emails_table_appends(spark, tmp_path):
    emails = parse_messages(spark.createDataFrame(RAW, "file STRING, message STRING"), 0)
    for times in (1, 2):
        em.write_emails(emails, str(tmp_path / "emails"))
        table = em.read_emails(spark, str(tmp_path / "emails"))
        assert em.count_rows(table).first().n_rows == times * len(RAW)
    assert tuple(table.columns) == em.EMAIL_COLUMNS


def test_row_ids_are_dense_with_equal_keys_and_copies(spark):
    # Two thirds of the rows are copies of one row.
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v"))
    # Small partitions would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    numbered = em.with_row_id(rows, ["k"], start=5)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = [(r.id, r.k) for r in numbered.orderBy("id").collect()]
    assert [i for i, _ in got] == list(range(5, 3005))
    assert [k for _, k in got] == sorted(k for _, k in got)
    parts = numbered.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 1000


def test_cap_and_sample(spark):
    df = spark.range(50).select(
        F.col("id"), F.lit("m").alias("message_id"), F.lit("f").alias("from_email"), F.lit("s").alias("subject"),
        F.repeat(F.lit("é"), F.col("id").cast("int")).alias("body_content"),
    )
    assert [r.id for r in em.cap_rows(df, 4, ["id"]).collect()] == [0, 1, 2, 3]
    assert [(r.id, r.body_length) for r in em.sample_rows(df).collect()] == [(0, 0), (1, 1), (2, 2)]


def test_settle_bounds(spark):
    df = spark.range(10).select("id", F.repeat(F.lit("x"), 100).alias("t"))
    assert session.settle(df, 10).small and not session.settle(df, 9).small
    assert session.settle_texts(df, ["t"], 10, 1000).small
    assert not session.settle_texts(df, ["t"], 10, 999).small
    assert session.settle(df, 10).df.count() == session.settle(df, 9).df.count() == 10


@pytest.mark.parametrize("n", [0, 1, 25, 200])
def test_one_of(spark, n):
    got = spark.range(300).where(session.one_of(F.col("id"), list(range(n)))).count()
    assert got == n


def test_shared_dir_comes_from_the_session(spark, monkeypatch):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert session.fresh_path(spark, "t").startswith(named)
    # Unset: a local master gets a folder of its own, any other must name one.
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    own = session.shared_dir(spark)
    assert own == session.shared_dir(spark) != named
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(RuntimeError):
        session.shared_dir(spark)


def test_phone_column(spark):
    assert spark.range(1).select(phone_digits(F.lit("1-2-3-4-5-6-7"))).first()[0] == "1234567"
