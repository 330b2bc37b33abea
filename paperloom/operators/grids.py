"""Tables as grids: where cells stand, how wide columns and how high rows are, rows rewritten to several."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.operators.flow import streamed


def place_cells(cells: DataFrame, key: str, row: str, order: str, col_span: str, row_span: str) -> DataFrame:
    """cells with col: the first column, after the cell before in its row, that no cell from a row above reaches into. The task holds how far down each column of one table is taken."""

    def step(state, row, _, wide, high):
        last, cursor, free = state or (None, 0, [])
        at = cursor if row == last else 0
        while at < len(free) and free[at] > row:
            at += 1
        free += [row] * (at + wide - len(free))
        for c in range(at, at + wide):
            free[c] = max(free[c], row + high)
        return (row, at + wide, free), [(at,)]

    span = lambda c: F.greatest(F.lit(1), F.coalesce(F.col(c), F.lit(1))).cast("long")
    return streamed(cells, key, [F.col(row).cast("long"), F.col(order).cast("long"), span(col_span), span(row_span)], None, step, {"col": "long"})


def column_widths(cells: DataFrame, key: str, row: str, col: str, span: str, width: str) -> DataFrame:
    """(key, col, width) for every column of each table, from 0.

    A column is as wide as its widest cell of one column. Cells over several
    then come by row and column: where all of theirs have no width yet they share it
    equally; a cell wider than its columns gives what is missing to those
    without a width in equal parts, else to all in proportion. Columns that
    nothing reaches get the mean of the others, 1 if there is none. Cells of
    one column meet before the shuffle; the task holds the widths of one table.
    """
    wide = F.greatest(F.lit(1), F.coalesce(F.col(span), F.lit(1))).cast("long")
    placed = cells.where(F.col(col).isNotNull()).select(F.col(key).alias("key"), F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), wide.alias("span"), F.coalesce(F.col(width).cast("double"), F.lit(0.0)).alias("width"))
    # each cell is read once: its width (of one column: the widest counts; of several: each counts) and how far it reaches
    one = lambda kind, row, col, span, width, reach: F.struct(F.lit(kind).alias("kind"), row.cast("long").alias("row"), col.cast("long").alias("col"), span.cast("long").alias("span"), width.alias("said"), reach.alias("most"))
    zero, none = F.lit(0), F.lit(None).cast("double")
    single = F.when((F.col("span") == 1) & (F.col("width") > 0), one(0, zero, F.col("col"), F.lit(1), none, F.col("width")))
    spread = F.when((F.col("span") > 1) & (F.col("width") > 0), one(1, F.col("row"), F.col("col"), F.col("span"), F.col("width"), F.lit(0.0)))
    end = one(2, zero, zero, zero, none, (F.col("col") + F.col("span")).cast("double"))
    met = placed.select("key", F.inline(F.array_compact(F.array(single, spread, end)))).groupBy("key", "kind", "row", "col", "span", "said").agg(F.max("most").alias("most"), F.count("*").alias("n"))
    times = F.when(F.col("kind") == 1, F.col("n")).otherwise(1).cast("int")
    met = met.select("key", "kind", "row", "col", F.when(F.col("kind") == 2, F.col("most").cast("long")).otherwise(F.col("span")).alias("span"), F.when(F.col("kind") == 1, F.col("said")).otherwise(F.col("most")).alias("width"), F.explode(F.array_repeat(F.lit(0), times)).alias("_again")).drop("_again")

    def step(state, kind, _, col, span, width):
        widths = state or {}
        if kind == 0:
            widths[col] = width
        elif kind == 1:
            columns = range(col, col + span)
            known = sum(widths.get(c, 0.0) for c in columns)
            bare = [c for c in columns if not widths.get(c)]
            if len(bare) == span:
                widths.update(dict.fromkeys(columns, width / span))
            elif width > known and bare:
                widths.update(dict.fromkeys(bare, (width - known) / len(bare)))
            elif width > known:
                widths.update({c: widths[c] + (width - known) * (widths[c] / known) for c in columns})
        else:
            mean = sum(widths.values()) / len(widths) if widths else 1.0
            return widths, [(c, widths.get(c, mean)) for c in range(span)]
        return widths, []

    made = streamed(met.withColumnRenamed("col", "at").withColumnRenamed("width", "said"), "key", [F.col(c) for c in ("kind", "row", "at", "span", "said")], None, step, {"col": "long", "width": "double"})
    return made.select(F.col("key").alias(key), "col", "width")


def row_heights(cells: DataFrame, key: str, row: str, span: str, height: str) -> DataFrame:
    """(key, row, height) for every row of each table from 0 to the last one reached: the most that a cell gives it, which spreads its height over its rows, rounded up; 0 without any."""
    high = F.greatest(F.lit(1), F.coalesce(F.col(span), F.lit(1))).cast("long")
    each = cells.where(F.col(row).isNotNull()).select(key, F.col(row).cast("long").alias("row"), high.alias("span"), F.greatest(F.lit(0.0), F.coalesce(F.col(height).cast("double"), F.lit(0.0))).alias("height"))
    given = each.select(key, F.explode(F.sequence("row", F.col("row") + F.col("span") - 1)).alias("row"), F.when(F.col("height") > 0, F.greatest(F.lit(1), F.ceil(F.col("height") / F.col("span")))).otherwise(0).cast("long").alias("height"))
    found = given.groupBy(key, "row").agg(F.max("height").alias("height"))
    rows = each.groupBy(key).agg(F.max(F.col("row") + F.col("span")).alias("n")).select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("row"))
    return rows.join(found, [key, "row"], "left").select(key, "row", F.coalesce("height", F.lit(0)).cast("long").alias("height"))


def exact_pixels(units: Column) -> Column:
    """1/7200 inch to whole pixels, 1 at least; 0 for what is no size."""
    return F.when(units > 0, F.greatest(F.lit(1), F.floor(units / 75 + 0.5))).otherwise(0).cast("long")


def cell_heights(cells: DataFrame, heights: DataFrame, key: str, row: str, span: str, height: str, fallback: int = 0) -> DataFrame:
    """cells with pixels: a cell's own height, else what its rows (key, row, height) have together, else fallback. Sums are differences of running sums."""
    sums = F.sum(exact_pixels(F.col("height"))).over(W.partitionBy("key").orderBy("row").rowsBetween(W.unboundedPreceding, 0))
    upto = heights.select(F.col(key).alias("key"), F.col("row").cast("long").alias("row"), "height").withColumn("upto", sums)
    ends = upto.groupBy("key").agg(F.max("row").alias("most"))
    at = F.greatest(F.lit(0), F.coalesce(F.col(row), F.lit(0))).cast("long")
    packed = cells.select(F.struct(*cells.columns).alias("cell"), F.col(key).alias("key"), at.alias("from"), (at + F.greatest(F.lit(1), F.coalesce(F.col(span), F.lit(1))) - 1).cast("long").alias("to"), exact_pixels(F.col(height)).alias("own"))
    packed = packed.join(ends, "key", "left").withColumn("to", F.least("to", "most")).withColumn("before", F.col("from") - 1)
    low, high = upto.select("key", F.col("row").alias("before"), F.col("upto").alias("low")), upto.select("key", F.col("row").alias("to"), F.col("upto").alias("high"))
    found = packed.join(high, ["key", "to"], "left").join(low, ["key", "before"], "left")
    total = F.when(F.col("from") <= F.col("most"), F.col("high") - F.coalesce("low", F.lit(0))).otherwise(0)
    return found.select("cell.*", F.when(F.col("own") > 0, F.col("own")).when(total > 0, total).otherwise(fallback).cast("long").alias("pixels"))


def scaled(total: Column, shares: list[int]) -> list[Column]:
    """total in whole parts like shares, 1 at least each; the last one has what is left."""
    total = F.greatest(F.lit(1), F.when(total > 0, total).otherwise(sum(shares)))
    parts = [F.greatest(F.lit(1), F.floor(total * s / sum(shares) + 0.5)).cast("long") for s in shares[:-1]]
    return [*parts, F.greatest(F.lit(1), total - sum(parts, F.lit(0))).cast("long")]


#: Forms by the marks that a row's text has and how many cells it needs; what rows stand for it: role, and for each
#: cell its role, the cell it comes from (from 0), its share of the width and its text: None keeps the cell's, "" is blank.
LABEL, INPUT, BODY = "field-label", "field-input", "body"
FORMS = [
    (["①", "②", "③"], 6, [("person-form-upper", [(LABEL, 0, 4, "①성명"), (INPUT, 1, 10, ""), (LABEL, 2, 8, "②주민등록번호"), (INPUT, 3, 10, "")]), ("person-form-lower", [(LABEL, 4, 4, "③주소"), (INPUT, 1, 18, ""), ("field-inline-note", 5, 10, None)])]),
    (["④", "⑤", "⑥", "⑦"], 8, [("military-form-upper", [(LABEL, 0, 4, "④입대일자"), (INPUT, 1, 12, ""), (LABEL, 2, 4, "⑤계급"), (INPUT, 3, 12, "")]), ("military-form-lower", [(LABEL, 4, 4, "⑥군별"), (INPUT, 5, 12, ""), (LABEL, 6, 4, "⑦군번"), (INPUT, 7, 12, "")])]),
    (["⑧질병명"], 5, [(BODY, [(LABEL, 0, 4, "⑧질병명"), (None, 1, 9, None), (None, 2, 9, None), (None, 3, 10, None)])]),
    (["⑬", "⑭", "⑮"], 6, [(BODY, [(LABEL, 0, 8, "⑬고엽제후유(의)증\n환자 등과의 관계"), (LABEL, 1, 4, "⑭성명"), (LABEL, 2, 9, "⑮주민등록번호"), (LABEL, 3, 3, "학 력"), (LABEL, 4, 3, "직 업"), (LABEL, 5, 5, "월소득(천원)")])]),
]


def rewrite_rows(cells: DataFrame, key: str, row: str, col: str, span: str, text: str, forms: list = FORMS) -> DataFrame:
    """(key, row, sub, row_role, position, col, span, role, source, text) of tables whose marked rows become several.

    The first form whose marks all are in a row's text, and that has cells
    enough, stands for the row; other rows stay, with their columns. Columns
    of new rows run on from 0. source is the place of the cell it comes from. What is
    gathered is one row's cells; the rewriting is one projection.
    """
    cell = F.struct(F.col(col).cast("long").alias("col"), F.greatest(F.lit(1), F.coalesce(F.col(span), F.lit(1))).cast("long").alias("span"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = cells.groupBy(F.col(key).alias("key"), F.col(row).alias("row")).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    rows = rows.withColumn("said", F.array_join(F.transform("cells", lambda c: F.trim(F.regexp_replace(c["text"], r"\s+", " "))), " "))
    rows = rows.withColumn("total", F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c["span"]))
    nothing = F.lit(None).cast("string")

    def made(sub, row_role, position, at, span, role, source, text):
        return F.struct(F.lit(sub).alias("sub"), row_role.alias("row_role"), position.alias("position"), at.cast("long").alias("col"), span.cast("long").alias("span"), role.alias("role"), source.alias("source"), text.alias("text"))

    kept = F.transform("cells", lambda c, k: made(0, nothing, k, c["col"], c["span"], nothing, k, c["text"]))
    choice = None
    for marks, least, out in forms:
        new = []
        for sub, (row_role, parts) in enumerate(out):
            widths, at = scaled(F.col("total"), [p[2] for p in parts]), F.lit(0)
            for k, ((role, source, _, said), wide) in enumerate(zip(parts, widths)):
                own = F.get("cells", F.lit(source))["text"] if said is None else F.lit(said)
                new.append(made(sub, F.lit(row_role), F.lit(k), at, wide, F.lit(role).cast("string"), F.lit(source), own))
                at = at + wide
        holds = reduce(lambda a, b: a & b, [F.contains(F.col("said"), F.lit(m)) for m in marks], F.size("cells") >= least)
        choice = F.when(holds, F.array(*new)) if choice is None else choice.when(holds, F.array(*new))
    new = choice.otherwise(kept) if choice is not None else kept
    return rows.select(F.col("key").alias(key), F.col("row").alias(row), F.inline(new))
