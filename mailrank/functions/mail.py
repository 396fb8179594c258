"""Column functions over raw mail messages: lines, header block, header values, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailrank.functions.binding import let
from mailrank.functions.text import STRIP_CHARS, fill_blank, now_millis, strip_ws

# Day and month names of a mail date.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

_BLANK_IN_LINE = r"\x00-\x09\x0b-\x20"  # strip characters other than the line feed
_DATE = (
    rf"^(?:{'|'.join(WEEKDAYS)}), \d{{1,2}} (?:{'|'.join(MONTHS)}) \d{{4}}"
    r" (?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d [+-](?:0\d|1[0-8])[0-5]\d \([A-Za-z][A-Za-z0-9/_:+-]*\)\z"
)


def unix_newlines(c: Column) -> Column:
    return F.replace(fill_blank(c), F.lit("\r\n"), F.lit("\n"))


def message_lines(c: Column) -> Column:
    """Lines of a message, without the empty ones at its end."""

    def lines(text):
        kept = F.rtrim(text, F.lit("\n"))
        only_newlines = (kept == "") & (text != "")
        return F.when(only_newlines, F.array().cast("array<string>")).otherwise(F.split(kept, "\n"))

    return let(unix_newlines(c), lines)


def _gap(text: Column) -> Column:
    """Where the first empty line begins, 0 if there is none."""
    return F.locate("\n\n", text)


def header_block(c: Column) -> Column:
    """Header lines, each led by a line feed: all text before the first empty line."""
    return let(
        F.concat(F.lit("\n"), unix_newlines(c)),
        lambda t: F.when(_gap(t) > 0, F.substr(t, F.lit(1), _gap(t) - 1)).otherwise(t),
    )


def body_text(c: Column) -> Column:
    """Everything after the first empty line, stripped; empty when there is no such line."""
    return let(
        F.concat(F.lit("\n"), unix_newlines(c)),
        lambda t: F.when(_gap(t) > 0, strip_ws(F.substr(t, _gap(t) + 2))).otherwise(F.lit("")),
    )


def _from_first_key(block: Column) -> Column:
    """The block from the first line that has a colon."""
    lead = F.substring_index(block, ":", 1)
    first_key = F.ltrim(F.substring_index(lead, "\n", -1), F.lit(STRIP_CHARS))
    opened = F.concat(F.lit("\n"), first_key, F.substr(block, F.length(lead) + 1))
    return F.when(F.contains(block, F.lit(":")), opened).otherwise(F.lit(""))


def unfold_headers(block: Column) -> Column:
    """One ``\\nkey:value`` line per header.

    A few flat regex passes over the block do what a line-by-line loop would, so the
    cost is linear in its length:
    the text before the first line with a colon is dropped, lines that neither carry a
    colon nor continue a header are dropped, values are stripped, and each
    continuation line is appended to the header above it after one space.
    """
    keyed = F.regexp_replace(let(block, _from_first_key), r"\n(?![ \t])[^:\n]*+(?=\n|\z)", "")
    left = F.regexp_replace(keyed, rf"(\n(?![ \t])[^:\n]*+:)[{_BLANK_IN_LINE}]++", "$1")
    right = F.regexp_replace(left, rf"(?<=[^\x00-\x20])[{_BLANK_IN_LINE}]++(?=\n|\z)", "")
    return F.regexp_replace(right, rf"\n[ \t][{_BLANK_IN_LINE}]*+", " ")


def header_entries(unfolded: Column) -> Column:
    """``array<struct<k,v>>`` of unfolded header lines, in message order, keys lower-cased."""
    lines = F.filter(F.split(unfolded, "\n"), lambda line: line != "")
    return F.transform(
        lines,
        lambda line: F.struct(
            F.lower(strip_ws(F.substring_index(line, ":", 1))).alias("k"),
            F.substr(line, F.locate(":", line) + 1).alias("v"),
        ),
    )


def header_value(entries: Column, key: str, default: str | None = "") -> Column:
    """Value of the last header called ``key``."""
    value = F.try_element_at(F.filter(entries, lambda h: h["k"] == key), F.lit(-1))["v"]
    return value if default is None else F.coalesce(value, F.lit(default))


def sender_name(c: Column) -> Column:
    """Display name: the text before the first ``<``."""
    return strip_ws(F.substring_index(fill_blank(c), "<", 1))


def all_recipients(to: Column, cc: Column, bcc: Column) -> Column:
    """``to`` followed by ``, cc`` and ``, bcc`` where those are not empty."""

    def tail(c):
        return F.when(c != "", F.concat(F.lit(", "), c)).otherwise(F.lit(""))

    return F.concat(to, tail(cc), tail(bcc))


def has_attachments(content_type: Column) -> Column:
    return F.contains(F.lower(content_type), F.lit("multipart"))


def parse_mail_date(
    c: Column, on_bad: Column | int | str | None = None, strict_weekday: bool = True
) -> Column:
    """``Mon, 14 May 2001 16:39:00 -0700 (PDT)`` to epoch milliseconds.

    The numeric offset decides the instant. A day past the end of its month means the
    month's last day, and the weekday must then agree (``strict_weekday``). Text of any
    other shape gives ``on_bad``: null, ``"now"``, or a value.
    Plain date arithmetic, so the session time zone plays no part.
    """


    def millis_of(parts):
        # Weekday, day, month, year, hours, minutes, seconds, offset.
        def number(i):
            return F.get(parts, F.lit(i)).cast("int")

        offset = F.get(parts, F.lit(7))
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.get(parts, F.lit(2))).cast("int")
        # There is no year 0, and no day 0.
        first = F.when(number(3) > 0, F.make_date(number(3), month, F.lit(1)))
        day_of_month = F.when(number(1).between(1, 31), number(1))
        minutes = F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 4, 2).cast("int")
        clock = number(4) * 3600 + number(5) * 60 + number(6)

        def at(day):
            days = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint")
            sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
            seconds = days * 86400 + clock - sign * minutes * 60
            weekday = F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(day))
            agrees = F.get(parts, F.lit(0)) == weekday
            return F.when(agrees, seconds * 1000) if strict_weekday else seconds * 1000

        return let(first, lambda f: let(F.least(F.date_add(f, day_of_month - 1), F.last_day(f)), at))

    well_formed = F.when(c.rlike(_DATE), F.split(c, "[ ,:]+"))
    millis = let(well_formed, millis_of)
    if on_bad is None:
        return millis
    bad = now_millis() if isinstance(on_bad, str) and on_bad == "now" else on_bad
    bad = bad if isinstance(bad, Column) else F.lit(bad)
    return F.coalesce(millis, bad.cast("bigint"))
