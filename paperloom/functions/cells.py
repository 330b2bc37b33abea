"""Rules of table cells, paragraphs and placed objects, names of records and controls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import text as t
from paperloom.functions import units

#: Cells and characters of a compact header row, characters and lines of a group's label.
HEADER_CELLS, HEADER_TEXT, LABEL_TEXT, LABEL_LINES = (3, 6), 18, 18, 3
#: Marks of forms, and words of an approval table.
REGISTRATION, RECEIPT, NUMBERED = r"등\s*록\s*신\s*청\s*서", "접수번호|접수일시|처리기간", ["①", "②", "③"]
APPROVAL = r"결\s*재|담\s*임|교\s*무|교\s*감|전\s*결|검\s*토|승\s*인|원\s*장|부\s*장|과\s*장|팀\s*장"
#: Records of documents by number.
RECORDS = {
    16: "DOCUMENT_PROPERTIES", 17: "ID_MAPPINGS", 18: "BIN_DATA", 19: "FACE_NAME", 20: "BORDER_FILL", 21: "CHAR_SHAPE", 22: "TAB_DEF", 23: "NUMBERING", 24: "BULLET", 25: "PARA_SHAPE", 26: "STYLE",
    66: "PARA_HEADER", 67: "PARA_TEXT", 68: "PARA_CHAR_SHAPE", 69: "PARA_LINE_SEG", 71: "CTRL_HEADER", 72: "LIST_HEADER", 73: "PAGE_DEF", 74: "FOOTNOTE_SHAPE", 75: "PAGE_BORDER_FILL", 76: "PAGE_NUM_PARA", 77: "TABLE",
    78: "SHAPE_COMPONENT", 79: "SHAPE_COMPONENT_LINE", 80: "SHAPE_COMPONENT_RECTANGLE", 81: "SHAPE_COMPONENT_ELLIPSE", 82: "SHAPE_COMPONENT_ARC", 83: "SHAPE_COMPONENT_POLYGON", 84: "SHAPE_COMPONENT_OLE", 85: "SHAPE_COMPONENT_PICTURE", 86: "SHAPE_COMPONENT",
    87: "CONTAINER", 88: "EQEDIT", 89: "CTRL_DATA", 95: "CHART_DATA", 98: "VIDEO_DATA", 99: "MEMO_SHAPE",
}
#: Kinds of controls by their id, and of blocks by number.
CONTROLS = {"tbl ": "table", "gso ": "drawing", "eqed": "equation", "head": "header", "foot": "footer", "secd": "sectionDefinition", "fn  ": "footnote", "en  ": "endnote"}
BLOCKS = ["paragraph", "table", "image", "shape"]


def _among(key: Column, names: dict, other: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key], other)


def record_name(tag: Column) -> Column:
    return _among(tag.cast("int"), RECORDS, F.concat(F.lit("TAG_"), tag.cast("string")))


def control_kind(control: Column) -> Column:
    """The kind of a control; nothing for no id."""
    said = F.coalesce(control, F.lit(""))
    return _among(said, CONTROLS, F.when(said == "", "").otherwise("control"))


def block_kind(number: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, BLOCKS)), F.when(number > 0, number.cast("int"))), F.lit("unknown"))


def is_control_character(code: Column) -> Column:
    """Characters of a text that stand for a control: 1 to 9 and 11 to 23."""
    return code.between(1, 9) | code.between(11, 23)


def text_alignment(value: Column) -> Column:
    said = F.lower(F.coalesce(value, F.lit("")))
    return F.when(said.isin("center", "right", "justify"), said).otherwise("left")


def cell_alignment(value: Column) -> Column:
    said = F.lower(F.coalesce(value, F.lit("")))
    return F.when(said.isin("center", "middle"), "middle").when(said == "bottom", said).otherwise("top")


def stacked_lines(text: Column) -> Column:
    """Four to eight Hangul syllables, each on its own, as lines of two; null for any other text."""
    tokens = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens) + 1) / 2).cast("int") - 1), lambda k: F.array_join(F.slice(tokens, (k * 2 + 1).cast("int"), 2), " "))
    return F.when(F.size(tokens).between(4, 8) & F.forall(tokens, lambda x: F.regexp_like(x, F.lit("^[가-힣]$"))), pairs)


def is_compact_header(row: Column, cells: Column) -> Column:
    """Whether a table's row, counted from 0, is a header of short cells: the first one, of 3 to 6 cells (text, row_span, nested) with text, none over rows or with a table in it."""
    fits = lambda c: (t.utf16_length(t.inline(F.coalesce(c["text"], F.lit("")))).between(1, HEADER_TEXT)) & (F.coalesce(c["row_span"], F.lit(1)) == 1) & ~F.coalesce(c["nested"], F.lit(False))
    return (row == 0) & F.size(cells).between(*HEADER_CELLS) & F.forall(cells, fits)


def is_group_label(text: Column, row_span: Column, col_span: Column, col: Column, nested: Column) -> Column:
    """Whether a cell names the rows it goes over: in the first two columns, of one column, short, without digits, of three lines at most."""
    said = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(said, t.SPACE, "")
    lines = F.size(F.filter(F.split(said, "\n+"), lambda x: F.trim(x) != ""))
    shape = (F.coalesce(row_span, F.lit(1)) > 1) & (F.coalesce(col_span, F.lit(1)) == 1) & (F.coalesce(col, F.lit(0)) <= 1)
    return shape & t.utf16_length(bare).between(1, LABEL_TEXT) & ~F.regexp_like(bare, F.lit("[0-9]")) & ~F.coalesce(nested, F.lit(False)) & (lines <= LABEL_LINES)


def is_primary_form(text: Column) -> Column:
    """Whether a table's text is that of an application form."""
    numbered = F.contains(text, F.lit(NUMBERED[0])) & F.contains(text, F.lit(NUMBERED[1])) & F.contains(text, F.lit(NUMBERED[2]))
    return F.coalesce(F.regexp_like(text, F.lit(REGISTRATION)) | (F.regexp_like(text, F.lit(RECEIPT)) & numbered), F.lit(False))


def is_composite_header(row: Column, col_span: Column, columns: Column, titles: Column, approvals: Column) -> Column:
    """Whether a first row's cell over all columns is a short title beside one table of approvals. titles are its paragraphs, approvals the texts of its tables."""
    said = F.filter(titles, lambda x: F.trim(x) != "")
    title = t.inline(F.array_join(said, " "))
    short = F.size(said).between(1, 3) & t.utf16_length(title).between(1, 24) & ~F.contains(title, F.lit("등록신청서"))
    return (row == 0) & (F.coalesce(col_span, F.lit(1)) >= F.greatest(F.lit(2), F.coalesce(columns, F.lit(0)))) & (F.size(approvals) == 1) & short & F.coalesce(F.regexp_like(t.inline(F.get(approvals, F.lit(0))), F.lit(APPROVAL)), F.lit(False))


def vertical_alignment(given: Column, stacked: Column, grouped: Column, compact: Column, middle: Column) -> Column:
    """Labels stand in the middle, and so do cells of compact headers and what should where top was said or nothing."""
    return F.when(stacked | grouped | ((given == "top") & (compact | middle)), "middle").otherwise(F.coalesce(F.nullif(given, F.lit("")), F.when(middle, "middle").otherwise("top")))


def long_row_fragments(kind: Column, page_break: Column, cells: Column, columns: Column, height: Column, most: Column) -> Column:
    """Over how many pages a row of one long cell goes, 12 at most; null if it is none.

    cells are those that show something, (row_span, col_span, paragraphs, height): one, of one row, over 70 %
    of the columns, with 12 paragraphs. A page takes 10000 units for each weight of most.
    """
    one = F.get(cells, F.lit(0))
    high = F.coalesce(F.when(height > 0, height), one["height"], F.lit(0))
    pages = F.ceil(high / (F.greatest(F.lit(1), most) * 10_000))
    wide = F.coalesce(one["col_span"], F.lit(1)) / F.greatest(F.lit(1), F.coalesce(columns, F.lit(1))) >= 0.7
    fits = (kind == "hwpx") & (F.upper(page_break) == "CELL") & (F.size(cells) == 1) & (F.coalesce(one["row_span"], F.lit(1)) <= 1) & wide & (one["paragraphs"] >= 12) & (pages >= 2)
    return F.when(fits, F.least(F.lit(12), pages)).cast("long")


def continued_weight(kind: Column, text: Column, pixels: Column, table_weight: Column) -> Column:
    """What a block that goes on takes of a page: the most of its lines, its text by 120 characters and its height by 20 pixels, 1 to 30; a table 4 to 40."""
    said = F.trim(F.coalesce(text, F.lit("")))
    lines = F.size(F.filter(F.split(said, "\n+"), lambda x: x != ""))
    whole = F.greatest(F.when(said == "", 1).otherwise(lines), F.when(said == "", 1).otherwise(F.ceil(t.utf16_length(said) / 120)), F.when(pixels > 0, F.ceil(pixels / 20)).otherwise(1))
    return F.when(kind == "table", F.greatest(F.lit(4), F.least(F.lit(40), table_weight))).otherwise(F.greatest(F.lit(1), F.least(F.lit(30), whole))).cast("long")


def is_blank_paragraph(layout: Column, line: Column, listed: Column, shows: Column) -> Column:
    """Whether a paragraph can be left out: its measured heights are nothing, it is in no list and has neither text nor picture."""
    return F.coalesce(layout <= 0, F.lit(False)) & F.coalesce(line <= 0, F.lit(True)) & ~listed & ~shows


def run_size(size: Column, relative: Column) -> Column:
    """A run's size by its own percentage, to a tenth of a point; 0 without a size."""
    base = F.greatest(F.lit(0.0), F.coalesce(size, F.lit(0.0)))
    return F.when(base > 0, F.floor(base * F.when(relative > 0, relative / 100).otherwise(1.0) * 10 + 0.5) / 10).otherwise(0.0)


def line_height(kind: Column, spacing: Column, sizes: Column) -> Column:
    """A paragraph's line height as style has it: pixels for fixed, minimum and space-only, else a factor of 1 to 4; nothing without spacing. sizes are its runs' sizes in points."""
    base = F.greatest(F.lit(10.5), F.coalesce(F.array_max(sizes), F.lit(0.0))) * (96 / 72)
    px = F.least(F.lit(200), F.greatest(F.lit(0), F.floor(spacing / 75 + 0.5))).cast("long")
    extra = F.least(F.lit(112), px)
    tall = F.floor(base * 1.2 + 0.5).cast("long")
    pixels = lambda c: F.concat(c.cast("string"), F.lit("px"))
    said = F.when(kind == "fixed", F.when(px > 0, pixels(px)).otherwise("")).when(kind == "minimum", pixels(F.greatest(tall, px))).when(kind == "space-only", pixels(F.greatest(tall, F.floor(base + extra + 0.5).cast("long"))))
    factor = F.format_string("%.2f", F.greatest(F.lit(1.0), F.least(F.lit(4.0), spacing / 100)))
    return F.when(F.coalesce(spacing, F.lit(0)) <= 0, "").otherwise(F.coalesce(said, factor))


def is_placed_apart(inline: Column, horz: Column, vert: Column, wrap: Column, overlap: Column, flows: Column) -> Column:
    """Whether an object stands outside the flow of text: against paper or page, behind or before text, or over others without flowing."""
    no = F.lit(False)
    apart = horz.isin("paper", "page") | vert.isin("paper", "page") | wrap.isin("behind-text", "in-front-of-text") | (F.coalesce(overlap, no) & ~F.coalesce(flows, no))
    return ~F.coalesce(inline, no) & F.coalesce(apart, F.coalesce(overlap, no) & ~F.coalesce(flows, no))


def coordinate(align: Column, container: Column, size: Column) -> Column:
    """Where an aligned object begins in its container, never before it."""
    return F.when(align == "center", F.greatest(F.lit(0.0), (container - size) / 2)).when(align.isin("right", "bottom", "outside"), F.greatest(F.lit(0.0), (container - size).cast("double"))).otherwise(0.0)


def relative_ratio(value: Column) -> Column:
    """A share of a measure said in hundredths up to 400, in thousandths up to 4000, else in ten thousandths."""
    return F.when(value > 0, F.when(value <= 400, value / 100).when(value <= 4000, value / 1000).otherwise(value / 10_000)).otherwise(0.0)


def xml_size(units_: Column, fallback: int = 0) -> Column:
    """1/2540 inch to whole pixels of 1/96 inch, 1 at least; fallback for no size."""
    return F.when(units_ > 0, F.greatest(F.lit(1), F.floor(units_ * 96 / 2540 + 0.5))).otherwise(fallback).cast("long")


def block_height(kind: Column, xml: Column, height: Column, rows: Column, row_sum: Column, xml_sum: Column, line_sum: Column, pixels: Column, line_pixels: Column, lines: Column) -> Column:
    """A block's height in pixels for layout.

    A table takes its explicit rows' heights, else the sum of its rows' (of XML in units of
    20 pixels), else 28 a row, 1 to 20000. A paragraph takes its lines' heights, else
    its measured height, else its lines by their height or 20, 1 to 4000. Others take
    their own, 24 without one.
    """
    whole = lambda c: units.pixels(c)
    clamp = lambda c, most: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(c + 0.5)))
    least = lambda c: F.greatest(F.lit(1), whole(c))
    table = F.when(xml_sum > 0, clamp(least(xml_sum), 20_000)).when(row_sum > 0, clamp(F.when(xml, row_sum * 20).otherwise(least(row_sum)), 20_000)).otherwise(clamp(F.greatest(F.lit(1), F.coalesce(rows, F.lit(1))) * 28, 20_000))
    paragraph = F.when(line_sum > 0, least(line_sum)).when(pixels > 0, clamp(pixels, 4000)).otherwise(clamp(F.when(line_pixels > 0, line_pixels).otherwise(20) * F.greatest(F.lit(1), F.coalesce(lines, F.lit(1))), 4000))
    other = F.when(xml, xml_size(height, 24)).otherwise(F.when(height > 0, least(height)).otherwise(24))
    return F.when(kind == "table", table).when(kind == "paragraph", paragraph).otherwise(other).cast("long")


def count_label(state: Column, counts: dict[str, Column]) -> Column:
    """A state and the counts that are known, as 'fail / verify 3 / dom 4'."""
    return F.concat_ws(" / ", state, *[F.when(c.isNotNull(), F.concat(F.lit(f"{n} "), c.cast("string"))) for n, c in counts.items()])


def freshness_label(available: Column, stale: Column, strict: Column) -> Column:
    return F.concat(F.when(~available, "missing").when(stale, "stale").otherwise("fresh"), F.when(strict, " (strict)").otherwise(""))


def served(path: Column, root: str, downloads: str, inputs: str, address: str) -> Column:
    """(kind, path, url): where a sample can be fetched from. Addresses stay; files below root are served in place, others from a copy in the folder inputs below it."""
    base = F.element_at(F.split(path, "/"), -1)
    inside = F.startswith(path, F.lit(root + "/"))
    place = F.when(inside, path).otherwise(F.concat(F.lit(inputs + "/"), base))
    parts = F.transform(F.split(F.substring(place, F.lit(len(root) + 2), F.length(place)), "/"), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")))
    is_url = F.regexp_like(path, F.lit("(?i)^https?://"))
    kind = F.when(is_url, "url").when(F.startswith(path, F.lit(downloads)), "downloads").when(inside, "workspace").otherwise("external-local")
    return F.struct(kind.alias("kind"), F.when(is_url, path).otherwise(place).alias("path"), F.when(is_url, path).otherwise(F.concat(F.lit(address), F.array_join(parts, "/"))).alias("url"))
