"""Hand-made messages, dates and lines."""

import pytest
from pyspark.sql import functions as F

from mailrank.functions import mail
from mailrank.operators.parse import headers_long, parse_messages
from mailrank.sources.emails import EMAIL_COLUMNS

MESSAGES = {
    "a": "From: x@y\nSubject: one\n two\n\tthree\n\nBody\r\nl2\n\nl3\n\n",
    "b": "Subject: 1\nnocolon\n cont\nSubject: 2\n\n",
    "c": "\nbody only: x",
    "d": " lead: v\nTo: a\n   \nFrom: z",
    "e": "\n\n",
    "f": "no colon at all",
    "g": "",
    "g0": None,
    "h": "To: \nCc: c@x\nBcc: c@x\n\nhi",
    "i": "X-From: Ann Lee <ann@x>\n\n",
    "j": "Content-Type: MULTIPART/Mixed; boundary=1\n\n",
    "k": "Subject: \n two\n   \n  foo: b  \n bar\n\nx",
    "l": "junk\n  y\n: empty\n c\nA:b:c\n",
    "m": "Subject: tail  \nDate: bad\n\n \t padded \x01\n",
}


@pytest.fixture(scope="module")
def parsed(spark):
    raw = spark.createDataFrame(list(MESSAGES.items()), "file STRING, message STRING")
    rows = parse_messages(raw, on_bad_date=-1).collect()
    return {r.labels: r for r in rows}


@pytest.mark.parametrize(
    "label,expected",
    [
        ("a", {"from_email": "x@y", "subject": "one two three", "body_content": "Body\nl2\n\nl3", "timestamp_ms": -1}),
        ("b", {"subject": "2", "body_content": ""}),
        ("c", {"subject": "", "body_content": "body only: x"}),
        ("d", {"all_recipients": "a ", "from_email": "z", "body_content": ""}),
        ("e", {"body_content": "", "timestamp_ms": -1}),
        ("f", {"body_content": "", "timestamp_ms": -1}),
        ("g", {"body_content": "", "timestamp_ms": 0, "has_attachments": False}),
        ("g0", {"body_content": "", "timestamp_ms": 0, "has_attachments": False}),
        ("h", {"all_recipients": ", c@x, c@x", "body_content": "hi"}),
        ("i", {"from_name": "Ann Lee"}),
        ("j", {"has_attachments": True}),
        ("k", {"subject": " two  foo: b bar", "body_content": "x"}),
        ("m", {"subject": "tail", "body_content": "padded", "timestamp_ms": -1}),
    ],
)
def test_message(parsed, label, expected):
    row = parsed[label]
    assert {k: row[k] for k in expected} == expected


def test_all_messages_kept_with_every_column(parsed):
    assert set(parsed) == set(MESSAGES)
    assert tuple(parsed["a"].asDict()) == EMAIL_COLUMNS


def test_header_rows(spark):
    raw = spark.createDataFrame([("l", MESSAGES["l"]), ("c", MESSAGES["c"])], "file STRING, message STRING")
    rows = [tuple(r) for r in headers_long(raw).orderBy("pos").collect()]
    assert rows == [("l", 1, "", "empty c"), ("l", 2, "a", "b:c")]


def _fold(message):
    """Line-by-line reading of a header block, to compare with."""
    headers, key = [], None
    lines = message.replace("\r\n", "\n").split("\n")
    for line in lines:
        if line == "":
            break
        strip = line.strip("".join(map(chr, range(33))))
        if line[0] in " \t" and key is not None:
            headers[-1][1] += " " + strip
        elif ":" in line:
            k, v = line.split(":", 1)
            chars = "".join(map(chr, range(33)))
            headers.append([k.strip(chars).lower(), v.strip(chars)])
            key = headers[-1][0]
    return [tuple(h) for h in headers]


def test_headers_agree_with_line_by_line_reading(spark):
    import random

    rng = random.Random(7)
    pieces = ["a", "B", ":", " ", "\t", "\n", "\n", "\r\n", "x:", "\n ", "\x01", "é"]
    messages = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    raw = spark.createDataFrame([(str(i), m) for i, m in enumerate(messages)], "file STRING, message STRING")
    entries = mail.header_entries(mail.unfold_headers(mail.header_block(F.col("message"))))
    for row in raw.select("message", entries.alias("h")).collect():
        assert [(h.k, h.v) for h in row.h] == _fold(row.message), repr(row.message)


def test_crlf_changes_nothing(spark):
    rows = [(k, v) for k, v in MESSAGES.items() if v and "\r" not in v]
    raw = spark.createDataFrame(rows, "file STRING, message STRING")
    crlf = raw.withColumn("message", F.replace("message", F.lit("\n"), F.lit("\r\n")))
    assert sorted(parse_messages(raw, 0).collect()) == sorted(parse_messages(crlf, 0).collect())


@pytest.mark.parametrize("text,n", [("", 1), ("a", 1), ("a\nb", 2), ("a\r\n\r\nb\n\n", 3), ("\n\n", 0), ("\na", 2)])
def test_line_count(spark, text, n):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(F.size(mail.message_lines(F.col("t")))).first()[0] == n


@pytest.mark.parametrize(
    "text,millis",
    [
        ("Mon, 14 May 2001 16:39:00 -0700 (PDT)", 989883540000),
        ("Fri, 4 May 2001 13:51:00 -0700 (PDT)", 989009460000),
        ("Wed, 13 Dec 2000 18:41:00 -0800 (PST)", 976761660000),
        ("Mon, 1 Jan 1979 00:00:00 +0000 (UTC)", 283996800000),
        ("Mon, 14 May 2001 16:39:00 -0700", None),
        ("Tue, 14 May 2001 16:39:00 -0700 (PDT)", None),
        ("Mon, 14 May 2001 24:39:00 -0700 (PDT)", None),
        ("mon, 14 may 2001 16:39:00 -0700 (PDT)", None),
        ("Mon, 0 May 2001 16:39:00 -0700 (PDT)", None),
        ("Mon, 32 May 2001 16:39:00 -0700 (PDT)", None),
        ("Mon, 1 Jan 0000 00:00:00 +0000 (UTC)", None),
        ("14/05/2001", None),
        ("Mon, 31 Feb 2001 10:00:00 +0000 (UTC)", None),
        ("Wed, 31 Feb 2001 10:00:00 +0000 (UTC)", 983354400000),
        (None, None),
    ],
)
def test_date(spark, text, millis):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(mail.parse_mail_date(F.col("t"))).first()[0] == millis


def test_bad_date_can_be_now(spark):
    df = spark.createDataFrame([("?",)], "t STRING")
    row = df.select(mail.parse_mail_date(F.col("t"), "now"), F.unix_millis(F.current_timestamp())).first()
    assert row[0] == row[1]
