"""Measures, colours, codes and thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Border widths in millimetres by code, 0.1 for any other.
BORDER_WIDTHS = [0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0]
#: How a table breaks over pages, by code.
BREAK_POLICIES = ["NONE", "CELL", "SPLIT", "RESERVED"]
#: A difference up to the first is close, up to the second for review.
CLOSE, REVIEW = 18, 32


def rounded(c: Column, digits: int = 0) -> Column:
    """Half rounds up, for negative numbers too."""
    scale = 10**digits
    return F.floor(c * scale + 0.5) / scale if digits else F.floor(c + 0.5)


def pixels(units: Column, least: int = 0, most: int = 1 << 30) -> Column:
    """1/7200 inch to pixels of 1/96 inch, within bounds."""
    return F.least(F.greatest(rounded(units / 75), F.lit(least)), F.lit(most)).cast("long")


def positive(c: Column) -> Column:
    """c if it is a finite number above zero, else 0."""
    return F.when((c > 0) & ~F.isnan(c.cast("double")) & (c < float("inf")), c).otherwise(0)


def colour(bgr: Column) -> Column:
    """#rrggbb of a number with red in the lowest byte."""
    part = lambda shift: F.lpad(F.lower(F.hex(F.shiftright(bgr, shift).bitwiseAND(255))), 2, "0")
    return F.concat(F.lit("#"), part(0), part(8), part(16))


def coded(code: Column, names: list, other) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, names)), code.cast("int") + 1), F.lit(other))


def border_width(code: Column) -> Column:
    return F.when(code >= 0, coded(code, BORDER_WIDTHS, 0.1)).otherwise(0.1)


def break_policy(code: Column) -> Column:
    return coded(F.pmod(code, F.lit(4)), BREAK_POLICIES, "NONE")


def verdict(difference: Column) -> Column:
    return F.when(difference.isNull(), "missing").when(difference <= CLOSE, "close").when(difference <= REVIEW, "review").otherwise("mismatch")


def in_scope(scope: Column, page: Column) -> Column:
    """Whether an area for EVEN, ODD, FIRST or all pages shows on a page counted from 0."""
    return F.when(scope == "EVEN", page % 2 == 1).when(scope == "ODD", page % 2 == 0).when(scope.isin("FIRST", "FIRST_PAGE"), page == 0).otherwise(True)


def clamped(c: Column, least: int, most: int) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), rounded(c))).cast("long")


def row_weight(height: Column, explicit: Column, xml: Column) -> Column:
    """How much of a page a table row takes. Of XML the larger of its height in weights and its explicit height in units, else its height in units."""
    height, explicit = F.coalesce(height, F.lit(0)), F.coalesce(explicit, F.lit(0))
    of_xml = F.greatest(F.lit(1), F.when(explicit > 0, clamped(explicit / 3000, 1, 40)).otherwise(0), height)
    return F.when(xml, of_xml).when(height > 0, clamped(height / 1800, 1, 40)).otherwise(1).cast("long")


def block_weight(kind: Column, inline: Column, height: Column, xml: Column, rows: Column) -> Column:
    """How much of a page a block takes: a table what its rows do, objects by their height, all else 1."""
    high = F.when(F.coalesce(height, F.lit(0)) == 0, 1200).otherwise(height) / 1000
    image = F.when(xml, clamped(F.coalesce(height, F.lit(0)) / 529, 1, 10)).otherwise(clamped(high, 1, 6))
    return F.when(kind == "table", rows).when(~kind.isin("image", "shape", "textbox", "equation", "ole") | inline, 1).when(kind == "image", image).when(kind.isin("shape", "textbox"), clamped(high, 1, 8)).otherwise(2).cast("long")


def cell_weight(text: Column, height: Column) -> Column:
    """Lines of 44 characters that a cell takes, or its height in units of 420 if that is more; 1 to 20."""
    from paperloom.functions.text import utf16_length

    lines = F.filter(F.split(F.trim(text), "\n+"), lambda x: x != "")
    chars = F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + utf16_length(x))
    wrapped = F.when(F.size(lines) > 0, F.greatest(F.size(lines), F.ceil(chars / 44))).otherwise(0)
    tall = F.when(height > 0, clamped(height / 420, 1, 20)).otherwise(0)
    return F.greatest(tall, clamped(F.coalesce(wrapped, F.lit(0)), 1, 20)).cast("long")
