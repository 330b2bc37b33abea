"""Text columns."""

from __future__ import annotations

from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every script, with the byte order mark.
SPACE = r"(?U)[\s\x{FEFF}]"


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, in which astral characters count two."""
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


def visible_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, SPACE, ""))


def normal_lines(c: Column) -> Column:
    """CR LF, CR and 0x02 become line feeds."""
    return F.regexp_replace(c, r"\r\n|\r|\x02", "\n")


def lines(c: Column) -> Column:
    return F.split(normal_lines(c), "\n")


def squeezed(c: Column) -> Column:
    """No-break spaces become spaces, runs of blanks one, runs of three line feeds and more two; trimmed."""
    c = F.regexp_replace(normal_lines(c), " ", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[ \t]{2,}", " "), "\n{3,}", "\n\n"))


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


#: Entities and what they stand for.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


def named_entities(c: Column) -> Column:
    """The five named entities, the ampersand last."""
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def escaped(c: Column) -> Column:
    """For element content and attributes, the ampersand first."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def inline(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def shortened(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def occurrences(text: Column, key: Column) -> Column:
    """Non-overlapping occurrences of key, both without white space; none for an empty key."""
    text, key = F.regexp_replace(text, SPACE, ""), F.regexp_replace(key, SPACE, "")
    return F.when(F.length(key) > 0, ((F.length(text) - F.length(F.replace(text, key, F.lit("")))) / F.length(key)).cast("long")).otherwise(0)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def file_name(url: Column) -> Column:
    """Last path segment without query and fragment."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[a-z]+://", ""), "/"), -1)


def extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def slug(c: Column) -> Column:
    """Lower-case ASCII words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normal(c: Column, form: str = "NFC") -> Column:
    """Characters in a normal form of Unicode. Only text beyond ASCII leaves the JVM, in Arrow batches."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def changed(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else normalize(form, v) for v in x.to_pylist()], pa.string())

    beyond = F.regexp_like(c, F.lit(r"[^\x00-\x7F]"))
    return F.when(beyond, changed(F.when(beyond, c))).otherwise(c)


def file_slug(c: Column, other: str = "document") -> Column:
    """Lower-case ASCII letters without accents, digits, points and lines; all else is a hyphen. other for nothing."""
    bare = F.regexp_replace(normal(F.coalesce(c, F.lit("")), "NFKD"), r"[\x{0300}-\x{036F}]", "")
    said = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "[^0-9A-Za-z._-]+", "-"), "^-+|-+$", ""), "-+", "-")
    return F.coalesce(F.nullif(F.lower(said), F.lit("")), F.lit(other))


def lookup_key(c: Column) -> Column:
    """What names are compared by: composed, trimmed, lower-case; null counts as empty."""
    return F.lower(F.trim(normal(F.coalesce(c, F.lit("")))))


def number_or_text(c: Column) -> Column:
    """(number, text) of a value: the number of whole and decimal numerals, else the text."""
    numeral = F.regexp_like(c, F.lit(r"^-?([0-9]+|[0-9]+\.[0-9]+|[0-9]+\.|\.[0-9]+)$"))
    return F.struct(F.when(numeral, c.try_cast("double")).alias("number"), F.when(~numeral, c).alias("text"))


def finite_number(c: Column) -> Column:
    """A finite number or null; blank text is 0."""
    said = F.trim(c)
    numeral = F.regexp_like(said, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"))
    number = F.when(said == "", F.lit(0.0)).when(numeral, said.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def hash_36(c: Column) -> Column:
    """FNV-1a of 32 bits over the first UTF-16 unit of each character, in base 36."""
    unit = lambda x: F.conv(F.hex(F.substring(F.encode(x, "UTF-16BE"), 1, 2)), 16, 10).cast("long")
    # offset basis and prime of the 32-bit FNV-1a
    state = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0x811C9DC5).cast("long"), lambda h, x: (h.bitwiseXOR(unit(x)) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.conv(state.cast("string"), 10, 36))
