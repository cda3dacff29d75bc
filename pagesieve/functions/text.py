"""Column expressions on urls and text that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace of Unicode but for the line feed, as the inside of a character class.
BLANKS = "\\t\\x0b\\f\\r\\x1c-\\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of blanks other than a single space, which needs no folding.
RAGGED = f"(?: [{BLANKS}]|[{BLANKS.replace('\\x1f ', '\\x1f')}])[{BLANKS}]*"
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
STRIP_SET = "\r\n\t\xa0 "


def site_of(url: Column) -> Column:
    """The host of a url in lower case without a leading www.; empty where there is no host, null for null."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), "^www\\.", "")


def stripped(text: Column) -> Column:
    """Both ends freed of CR, LF, tab, no-break space and blank."""
    return F.btrim(text, F.lit(STRIP_SET))


def _folded(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), RAGGED, " ")


def folded_line(line: Column) -> Column:
    """A line as it is compared: lower case, runs of digits as one, runs of blanks as one, trimmed."""
    return F.btrim(_folded(line), F.lit(" "))


def folded_lines(text: Column) -> Column:
    """The lines of a text as they are compared."""
    return F.transform(F.split(_folded(text), "\n", -1), lambda x: F.btrim(x, F.lit(" ")))
