"""Column functions over text: trimming, keys, snippets and word tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STRIP_CHARS = "".join(map(chr, range(0x21)))  # U+0000..U+0020
ROLE_PREFIX = {"document": "document: ", "query": "query: "}
PHONE_MIN_DIGITS, PHONE_MAX_DIGITS = 7, 15
EMBED_CHARS = 512
SNIPPET_CHARS = 200

# Unicode word-break classes (UAX #29) that decide which punctuation joins a word.
MID_BOTH = r".'\x{2018}\x{2019}\x{2024}\x{FE52}\x{FF07}\x{FF0E}"
MID_LETTER = r":\x{00B7}\x{0387}\x{055F}\x{05F4}\x{2027}\x{FE13}\x{FE55}\x{FF1A}"
MID_NUMBER = (
    r",;\x{037E}\x{0589}\x{060C}\x{060D}\x{066C}\x{07F8}\x{2044}"
    r"\x{FE10}\x{FE14}\x{FE50}\x{FE54}\x{FF0C}\x{FF1B}"
)

# The same, as far as Latin text uses it, and blocks in which the other ones lie.
LATIN_BOTH, LATIN_LETTER, LATIN_NUMBER = r".'\x{2018}\x{2019}", r":\x{00B7}", r",;"
NOT_LATIN = (
    r"[\x{0370}-\x{07FF}\x{2024}\x{2027}\x{2044}\x{2E80}-\x{A4CF}\x{F900}-\x{FFEF}\x{16FE0}-\x{3FFFF}]"
)

# Scripts whose characters are words of their own.
_SINGLE_CHAR_WORD = r"([\p{IsHan}\p{IsHiragana}])"


def strip_ws(c: Column) -> Column:
    """Strip U+0000..U+0020 at both ends."""
    return F.btrim(c, F.lit(STRIP_CHARS))


def blank(c: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return strip_ws(F.coalesce(c, F.lit(""))) == ""


def fill_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def phone_digits(c: Column) -> Column:
    """All digits of the text joined, kept only when a phone number could be that long."""
    digits = F.regexp_replace(c, "[^0-9]+", "")
    fits = F.length(digits).between(PHONE_MIN_DIGITS, PHONE_MAX_DIGITS)
    return F.when(fits, digits).otherwise(F.lit(""))


def text_to_embed(subject: Column, body: Column, n: int = EMBED_CHARS) -> Column:
    """Subject, a space and the body, cut at ``n`` characters."""
    return F.substring(F.concat(fill_blank(subject), F.lit(" "), fill_blank(body)), 1, n)


def with_role(c: Column, role: str) -> Column:
    """Prefix text with the role the embedding model expects (``document`` or ``query``)."""
    return F.concat(F.lit(ROLE_PREFIX[role]), c)


def exact_key(c: Column) -> Column:
    """Query-side key of an exact-match lookup."""
    return strip_ws(F.lower(c))


def flag_to_int(c: Column) -> Column:
    return c.cast("int")


def flag_from_text(c: Column) -> Column:
    """True only for the stored text ``1``."""
    return F.coalesce(c == "1", F.lit(False))


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def safe_millis(c: Column, on_bad: Column | int | None = None) -> Column:
    """Stored text to epoch milliseconds: blank gives 0, a non-number gives ``on_bad`` (default now)."""
    bad = now_millis() if on_bad is None else on_bad if isinstance(on_bad, Column) else F.lit(on_bad)
    return F.when(fill_blank(c) == "", F.lit(0).cast("bigint")).otherwise(
        F.coalesce(c.try_cast("bigint"), bad.cast("bigint"))
    )


def placeholder(c: Column, mark: str = "-") -> Column:
    """A lone ``-`` stands for an empty value."""
    return F.when(c == mark, F.lit("")).otherwise(c)


def _cut(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def clean_snippet(c: Column, n: int = SNIPPET_CHARS) -> Column:
    """Whitespace runs collapsed, stripped, cut at ``n`` characters."""
    return _cut(strip_ws(F.regexp_replace(fill_blank(c), r"[ \t\n\x0b\f\r]+", " ")), n)


def hit_snippet(c: Column, n: int = SNIPPET_CHARS) -> Column:
    """The raw text cut at ``n`` characters, whitespace left as it is."""
    return _cut(fill_blank(c), n)


def _tokens(c: Column, both: str, letter: str, number: str) -> Column:
    joining = both + letter + number
    # Punctuation that does not sit between two letters or two digits.
    loose = (
        rf"[{joining}]"
        rf"(?:(?<![\p{{L}}\p{{M}}][{both}{letter}])|(?!\p{{L}}))"
        rf"(?:(?<!\p{{N}}[{both}{number}])|(?!\p{{N}}))"
    )
    word = rf"[\p{{L}}\p{{N}}\p{{Pc}}][\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}{joining}]*"
    return F.regexp_extract_all(F.lower(F.regexp_replace(c, loose, " ")), F.lit(word), F.lit(0))


def word_tokens(c: Column) -> Column:
    """Lower-cased words in text order, as an array.

    Punctuation that does not join two letters or two digits is blanked first, so
    that the second pattern is a flat character class and a very long dotted run
    cannot exhaust the regex engine's stack. Text that stays within Latin script is
    matched with short character classes, which are several times as fast.
    """
    text = fill_blank(c)
    spaced = F.regexp_replace(text, _SINGLE_CHAR_WORD, " $1 ")
    return F.when(
        text.rlike(NOT_LATIN), _tokens(spaced, MID_BOTH, MID_LETTER, MID_NUMBER)
    ).otherwise(_tokens(text, LATIN_BOTH, LATIN_LETTER, LATIN_NUMBER))
