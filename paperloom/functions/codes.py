"""Names, codes and numbers of properties as they come in files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What objects are placed against, by axis and code, and by name.
RELATIVE_TO = {"horz": ["paper", "page", "column", "para"], "vert": ["paper", "page", "para"]}
RELATIVE_NAMES = ["paper", "page", "para", "column", "absolute"]
#: Alignment of objects by axis and code, and by name.
ALIGNED = {"horz": ["left", "center", "right", "inside", "outside"], "vert": ["top", "center", "bottom", "inside", "outside"]}
ALIGNED_NAMES = ["left", "center", "right", "top", "bottom", "inside", "outside"]
#: How text goes around objects, by code.
WRAPS = ["top-and-bottom", "square", "tight", "through", "behind-text", "in-front-of-text"]
FLOWS = ["both-sides", "left-only", "right-only", "largest-only"]
#: Alignment of paragraphs by the bits 2 to 4 of an attribute.
PARAGRAPHS = ["justify", "left", "right", "center", "justify", "justify"]
#: Kinds of line spacing by code, and other names of each.
SPACING = {
    "percent": ["percent", "percentage", "ratio", "char", "chars", "character", "relative"],
    "fixed": ["fixed", "fixed-value", "fixedvalue"],
    "space-only": ["space-only", "spaceonly", "margin", "margins-only", "betweenlines", "between-lines", "only-margin"],
    "minimum": ["minimum", "minimum-value", "minimumvalue", "at-least", "at_least", "min"],
}


def by_code(code: Column, names: list[str], other: str) -> Column:
    return F.coalesce(F.when(code >= 0, F.try_element_at(F.array(*map(F.lit, names)), code.cast("int") + 1)), F.lit(other))


def dashed(value: Column) -> Column:
    """Lower case, with runs of white space and underscores as one dash."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"[_\s]+", "-")


def known_name(value: Column, names: list[str], other: str) -> Column:
    """The dashed name if it is one of names, else other."""
    return F.when(dashed(value).isin(names), dashed(value)).otherwise(other)


def spacing_type(value: Column) -> Column:
    """One name for each kind of line spacing; others as they are, in lower case."""
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.coalesce(*[F.when(raw.isin(names), kind) for kind, names in SPACING.items()], raw)


def paragraph_alignment(attribute: Column) -> Column:
    return by_code(F.shiftright(attribute, 2).bitwiseAND(7), PARAGRAPHS, "left")


def hex_colour(value: Column) -> Column:
    """#RRGGBB of six or eight hexadecimal digits (of eight the last six), nothing for none, others as they are."""
    text = F.trim(F.coalesce(value, F.lit("")))
    digits = F.regexp_replace(text, "^#", "")
    return F.when(F.lower(text).isin("", "none"), "").when(digits.rlike("^[0-9a-fA-F]{8}$"), F.concat(F.lit("#"), F.substring(digits, 3, 6))).when(digits.rlike("^[0-9a-fA-F]{6}$"), F.concat(F.lit("#"), digits)).otherwise(text)


def first_number(value: Column) -> Column:
    """The first decimal number in a text, 0 without any."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(value, F.lit("")), r"-?\d+(?:\.\d+)?", 0), F.lit("")).cast("double"), F.lit(0.0))


def page_count(value: Column, text: Column) -> Column:
    """A count above zero as it is, else the second number of "3/12쪽" in the text; null without."""
    found = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+)/(\d+)쪽", 2), F.lit("")).cast("long")
    return F.when(value > 0, value.cast("long")).otherwise(found)


def scan_score(paragraphs: Column, tables: Column, cells: Column, lines: Column, records: Column, truncated: Column) -> Column:
    """How much a scan has found: weighted counts, less 200 if it was cut short."""
    part = lambda c, w: F.coalesce(c, F.lit(0)) * w
    return part(paragraphs, 12) + part(tables, 25) + part(cells, 8) + part(lines, 4) + part(records, 1) - F.when(truncated, 200).otherwise(0)


def labelled(counts: dict[str, Column]) -> Column:
    """"name n" for each count above zero, in the order given."""
    return F.array_compact(F.array(*[F.when(c > 0, F.concat_ws(" ", F.lit(n), c.cast("string"))) for n, c in counts.items()]))
