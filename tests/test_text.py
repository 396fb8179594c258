import pytest
from pyspark.sql import functions as F

from mailrank.functions import text


def value(spark, made, given):
    return spark.createDataFrame([(given,)], "t STRING").select(made(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "given,words",
    [
        ("en.46@mail5.example.com", ["en", "46", "mail5", "example.com"]),
        (
            "john@acme.com can't 3.14 1,000 a-b foo_bar x. .y",
            ["john", "acme.com", "can't", "3.14", "1,000", "a", "b", "foo_bar", "x", "y"],
        ),
        ("a1.b2 v2.0", ["a1", "b2", "v2.0"]),
        ("a:b 10:30 ..a.b..c 1;2,3", ["a:b", "10", "30", "a.b", "c", "1;2,3"]),
        ("Don’t 日本ひらab", ["don’t", "日", "本", "ひ", "ら", "ab"]),
        ("A．B x·y 1٬2", ["a．b", "x·y", "1٬2"]),
        ("É—è “q” €5", ["é", "è", "q", "5"]),
        ("", []),
        (None, []),
        (" .,; ", []),
    ],
)
def test_words(spark, given, words):
    assert value(spark, text.word_tokens, given) == words


def test_long_dotted_run_is_one_word(spark):
    assert value(spark, lambda c: F.size(text.word_tokens(c)), "ab." * 50_000) == 1


@pytest.mark.parametrize(
    "given,digits",
    [
        ("call 713-853-1234", "7138531234"),
        ("(713) 853 1234 x9 2001", "713853123492001"),
        ("a1b2c3d4e5f6g7", "1234567"),
        ("12345 6", ""),
        ("713-853-1234 and 713-853-9999", ""),
        ("no digits", ""),
        (None, ""),
    ],
)
def test_phone(spark, given, digits):
    assert value(spark, text.phone_digits, given) == digits


def test_strip(spark):
    assert value(spark, text.strip_ws, "\x00\t a   \n\x1f") == "a  "


def test_snippets(spark):
    long = " a\n\n" + "b" * 300
    assert value(spark, text.hit_snippet, long) == long[:200] + "..."
    assert value(spark, text.clean_snippet, long) == ("a " + "b" * 300)[:200] + "..."
    assert value(spark, text.hit_snippet, "x" * 200) == "x" * 200
    assert value(spark, text.hit_snippet, None) == value(spark, text.clean_snippet, None) == ""


def test_embed_text_is_cut_before_the_prefix(spark):
    cut = value(spark, lambda c: text.with_role(text.text_to_embed(F.lit(None), c), "document"), "y" * 600)
    assert cut == "document: " + " " + "y" * 511


@pytest.mark.parametrize("given,millis", [(None, 0), ("", 0), ("12", 12), ("x", -1)])
def test_millis(spark, given, millis):
    assert value(spark, lambda c: text.safe_millis(c, -1), given) == millis
