"""Columns from lines of text. All are built-in expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs of anything but Unicode white space; and a URL's authority, whose host is group 1 (in brackets) or 2.
NOT_WHITE = r"([^\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+)"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(?:\[([^\]/?# |\\^`{}]*)\]|([^:/?#\[\]@ |\\^`{}]*))(?::[0-9]*)?(?:[/?#]|$)"


def go_lower(text: Column) -> Column:
    """Lower case, rune by rune: capital I with a dot gives a plain i."""
    return F.lower(F.translate(text, "İ", "i"))


def words(text: Column) -> Column:
    """All runs of ASCII letters, digits and underscores in lower-cased text."""
    return F.regexp_extract_all(go_lower(text), F.lit(r"(\w+)"), F.lit(1))


def tab_fields(line: Column) -> Column:
    """Fields between tabs, empty ones too."""
    return F.split(line, "\t")


def tab_field(line: Column, n: int) -> Column:
    """The n-th field from 0; null where a line has fewer."""
    return F.get(tab_fields(line), F.lit(n))


def white_fields(line: Column) -> Column:
    """Fields between runs of white space, never empty."""
    return F.regexp_extract_all(line, F.lit(NOT_WHITE), F.lit(1))


def host_name(url: Column) -> Column:
    """The host of a URL, its case kept, without user, port and brackets; empty where there is none or the URL is broken.

    Broken are control characters, escapes of % outside the query, and signs that hosts can't have (which
    the pattern leaves out). url should be a column or a lambda's variable, as it is used several times.
    """
    checked = F.concat(F.regexp_extract(url, "^[^?#]*", 0), F.regexp_extract(url, "#.*", 0))
    escapes = url.contains("%") & F.regexp_replace(checked, "%[0-9A-Fa-f]{2}", "").contains("%")
    host = F.concat(F.regexp_extract(url, AUTHORITY, 1), F.regexp_extract(url, AUTHORITY, 2))
    return F.when(escapes | url.rlike(r"[\x00-\x1f\x7f]"), "").otherwise(host)


def key_hash(key: Column) -> Column:
    """h = 31 h + byte over a key's bytes, in 32 bits, without the sign bit."""
    hexed = F.hex(key.cast("binary"))
    at = F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2))
    codes = F.transform(at, lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))
    folded = F.aggregate(
        codes, F.lit(0).cast("long"), lambda h, b: (h * 31 + b).bitwiseAND(F.lit(0xFFFFFFFF)), lambda h: h.bitwiseAND(F.lit(0x7FFFFFFF))
    )
    return F.when(F.octet_length(key) == 0, F.lit(0).cast("long")).otherwise(folded)


def reducer_of(key: Column, reducers: int) -> Column:
    return (key_hash(key) % reducers).cast("int")


def pair_fields(line: Column) -> Column:
    """Key and value on either side of a line's first tab; one element where there is no tab."""
    return F.split(line, "\t", 2)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def text_name(path: Column) -> Column:
    """Whether a file's name says that it is text, in any case."""
    return F.lower(path).endswith(".txt")
