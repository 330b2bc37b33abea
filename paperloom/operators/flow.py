"""Lines, blocks and pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import text as t


def spare(rows: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of rows has, whatever its case."""
    held, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a line, empty ones included: (key, line_no from 0, line)."""
    return docs.select(key, F.posexplode(t.lines(F.col(text))).alias("line_no", "line"))


def cap_blank_runs(rows: DataFrame, key: str, order: str, text: str, keep: int = 2) -> DataFrame:
    """Of each run of blank rows the first keep."""
    blank, (island, rank) = F.trim(text) == "", spare(rows, "island", "rank")
    solid = F.sum(F.when(blank, 0).otherwise(1)).over(W.partitionBy(key).orderBy(order))
    blanks = F.sum(F.when(blank, 1).otherwise(0)).over(W.partitionBy(key, island).orderBy(order))
    return rows.withColumn(island, solid).withColumn(rank, blanks).where(~blank | (F.col(rank) <= keep)).drop(island, rank)


def line_weight(text: Column) -> Column:
    """How much of a page a line takes: one for each 120 units begun, 1 to 30."""
    return F.least(F.lit(30), F.greatest(F.lit(1), F.ceil(t.utf16_length(text) / 120))).cast("int")


_KINDS = {"long": (T.LongType(), pa.int64()), "int": (T.IntegerType(), pa.int32()), "string": (T.StringType(), pa.string()), "double": (T.DoubleType(), pa.float64())}


def streamed(rows: DataFrame, key: str, by: list[Column], start, step, names: dict[str, str], gathered: bool = False, ordered: list[str] | None = None) -> DataFrame:
    """rows with the columns names that step makes of each group's rows in order.

    step(state, values of by) gives the next state and the rows that stand for
    this one, as tuples of the new columns; start is a group's first state. The
    rows of a group stream through one task, which holds a batch of them and the
    state; Python sees the values of by only. gathered says that a window over key has
    brought the groups together already, ordered the columns that it has sorted them
    by within key, so that Spark need not sort them again. Columns of rows may have any name
    but those of names.
    """
    values = F.struct(*[c.alias(f"v{k}") for k, c in enumerate(by)])
    rows = rows.sortWithinPartitions(key, *ordered) if ordered else rows
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(key).alias("key"), values.alias("by"))
    made = T.StructType([T.StructField(n, _KINDS[t][0]) for n, t in names.items()])
    schema = T.StructType([packed.schema["row"], T.StructField("made", made)])
    arrow = pa.struct([(n, _KINDS[t][1]) for n, t in names.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), start
        for batch in batches:
            at, out = [], [[] for _ in names]
            for i, (k, *values) in enumerate(zip(batch.column(1).to_pylist(), *(c.to_pylist() for c in batch.column(2).flatten()))):
                if k != last:
                    last, state = k, start
                state, rows = step(state, *values)
                at += [i] * len(rows)
                for row in rows:
                    for column, v in zip(out, row):
                        column.append(v)
            new = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], fields=list(arrow))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), new], ["row", "made"])

    # by a hash of the key: a repartition by the key itself is left out of plans whose joins seem to have it done, and those joins may change while they run
    found = packed if gathered else packed.repartition(F.xxhash64("key"))
    found = (found if ordered else found.sortWithinPartitions("key", "by")).mapInArrow(run, schema)
    return found.select("row.*", "made.*")


def paginate(rows: DataFrame, key: str, order: str, weight: str, budget: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Greedy filling: a row opens a new page when the page has rows and would pass the budget. (key, order, carried columns, page from 0)"""

    def step(state, _, w):
        page, used = state
        page, used = (page + 1, w) if used and used + w > budget else (page, used + w)
        return (page, used), [(page,)]

    placed = rows.withColumn(order, F.col(order).cast("long"))
    made = streamed(placed.select(key, order, *carry, *[F.col(weight)] * (weight not in (key, order, *carry))), key, [F.col(order), F.greatest(F.lit(1), F.col(weight)).cast("long")], (0, 0), step, {"page": "long"})
    return made.select(key, order, *carry, "page")


def layout_boxes(rows: DataFrame, key: str, order: str, height: str, page_height: int, top: int = 0, bottom: int = 0, least: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """Blocks down pages: a box on each page a block is on.

    A block is least high at least. One that doesn't fit below what its page
    has opens a page; one taller than a page's content starts on its own and
    goes on over as many pages as it needs. (key, order, carried columns, page, y,
    fragment, fragments, source_start, visible_height)
    """
    end = max(1, page_height - bottom)
    content, head = max(1, page_height - top - bottom), min(top, end - 1)

    def step(state, _, h):
        page, y, boxes = state
        if h <= content:
            if boxes and y + h > end:
                page, y = page + 1, head
            return (page, y + h, True), [(page, y, 0, 1, 0, h)]
        page, n = page + bool(boxes), -(-h // content)
        out = [(page + f, head, f, n, f * content, min(content, h - f * content)) for f in range(n)]
        return (page + n - 1, head + out[-1][-1], True), out

    placed = rows.withColumn(order, F.col(order).cast("long")).select(key, order, *carry, *[F.col(height)] * (height not in (key, order, *carry)))
    names = dict.fromkeys(("page", "y", "fragment", "fragments", "source_start", "visible_height"), "long")
    made = streamed(placed, key, [F.col(order), F.greatest(F.lit(max(1, least)), F.col(height)).cast("long")], (0, head, False), step, names)
    return made.select(key, order, *carry, *names)


def place_blocks(rows: DataFrame, key: str, order: str, height: str, content: int) -> DataFrame:
    """Where each block's first box is, without margins: (key, order, page, y, fragments)."""
    return layout_boxes(rows, key, order, height, content).where("fragment = 0").select(key, order, "page", "y", "fragments")


def split_rows(rows: DataFrame, key: str, order: str, weight: str, budget: int) -> DataFrame:
    """Rows of a table in chunks of a budget, the first row repeated on top of later ones: (key, chunk, position, order, repeated)."""
    placed = rows.select(key, F.col(order).cast("long").alias(order), F.greatest(F.lit(1), F.col(weight)).cast("long").alias("_w")).withColumn("_head", F.min(order).over(W.partitionBy(key)))

    def step(state, n, w, head):
        chunk, used, at = state
        if used and used + w > budget:
            return (chunk + 1, w, 2), [(chunk + 1, 0, head, 1), (chunk + 1, 1, n, 0)]
        return (chunk, used + w, at + 1), [(chunk, at, n, 0)]

    names = {"chunk": "long", "position": "long", "_row": "long", "repeated": "int"}
    made = streamed(placed.select(key, F.col(order).alias("_n"), "_w", "_head"), key, [F.col(c) for c in ("_n", "_w", "_head")], (0, 0, 0), step, names, gathered=True)
    return made.select(key, "chunk", F.col("_row").alias(order), "repeated", F.col("position").cast("int").alias("position"))


def table_chunks(rows: DataFrame, key: str, order: str, weight: str, span: str, budget: int, strict: bool = False, headers: int = 0) -> DataFrame:
    """Chunks of tables that break only where no cell reaches on: (key, chunk, position, row, repeated).

    A chunk ends at its last safe break once it weighs the budget; strict also
    ends it there before a row that would pass the budget. Without a safe break
    it goes on. Rows are numbered from 0 in each table; the first so many head
    rows are repeated on top of chunks that start below them. The task holds the
    weights of one open chunk.
    """
    by = W.partitionBy("_key").orderBy("_order", "_w", "_span")
    placed = rows.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.greatest(F.lit(1), F.col(weight)).cast("long").alias("_w"), F.col(span).cast("long").alias("_span")).withColumn("_n", F.row_number().over(by).cast("long") - 1)
    reach = F.max(F.col("_n") + F.col("_span") - 1).over(by.rowsBetween(W.unboundedPreceding, 0))
    placed = placed.withColumn("_safe", reach <= F.col("_n")).withColumn("_last", F.lead("_n").over(by).isNull())

    def step(state, _, w, safe, last):
        chunk, first, held, at, total, cut = state or (0, 0, [], 0, 0, 0)
        held.append((w, safe))
        out, size = [], 0
        while held:
            while at < len(held) and not size:
                w, safe = held[at]
                if strict and cut and total and total + w > budget:
                    size = cut
                    break
                at, total = at + 1, total + w
                cut = at if safe else cut
                size = cut if total >= budget else 0
            if not size and not last:
                break
            size = size or len(held)
            shown = [(r, 1) for r in range(headers if first >= headers else 0)] + [(r, 0) for r in range(first, first + size)]
            out += [(chunk, p, r, again) for p, (r, again) in enumerate(shown)]
            chunk, first, held, at, total, cut, size = chunk + 1, first + size, held[size:], 0, 0, 0, 0
        return (chunk, first, held, at, total, cut), out

    made = streamed(placed, "_key", [F.col(c) for c in ("_n", "_w", "_safe", "_last")], None, step, {"chunk": "long", "position": "long", "row": "long", "repeated": "int"}, gathered=True, ordered=["_order", "_w", "_span"])
    return made.select(F.col("_key").alias(key), "chunk", "position", "row", "repeated")


def fragments(rows: DataFrame, key: str, order: str, weight: str, wanted: str) -> DataFrame:
    """Paragraphs in about so many fragments of equal weight: (key, order, fragment from 0).

    A fragment closes before a paragraph that would pass an equal share, unless
    it is the last one or fewer paragraphs than fragments would be left.
    """
    w = W.partitionBy(key)
    placed = rows.select(key, F.col(order).cast("long").alias(order), F.greatest(F.lit(1), F.col(weight)).cast("long").alias("_w"), F.greatest(F.lit(1), F.col(wanted)).cast("long").alias("_k"))
    placed = placed.withColumn("_rows", F.count("*").over(w)).withColumn("_share", F.ceil(F.sum("_w").over(w) / F.col("_k")))

    def step(state, _, weight, wanted, rows, share):
        seen, fragment, used = state
        if used and fragment < wanted - 1 and used + weight > share and rows - seen >= wanted - fragment:
            fragment, used = fragment + 1, 0
        return (seen + 1, fragment, used + weight), [(fragment,)]

    return streamed(placed, key, [F.col(c) for c in (order, "_w", "_k", "_rows", "_share")], (0, 0, 0), step, {"fragment": "long"}, gathered=True).select(key, order, "fragment")


def list_markers(rows: DataFrame, key: str, order: str, kind: str, list_id: str, level: str, start: str, form: str) -> DataFrame:
    """rows with marker: the bullet in form, or the number that a (kind, list) of the key has come to.

    A deeper level starts anew when one above it goes on. In form ^n stands for
    the numbers of all levels, ^N for them and a point, ^^ for ^; without one
    the number of the level and a point.
    """
    group, value, joined = spare(rows, "group", "value", "joined")
    placed = rows.withColumn(group, F.struct(key, kind, list_id))
    by = [F.col(order), F.greatest(F.lit(1), F.coalesce(level, F.lit(1))).cast("int"), F.greatest(F.lit(1), F.coalesce(start, F.lit(1))).cast("long"), F.col(form)]

    def step(state, _, level, start, form):
        counters = [*state[:level], *[None] * (level - len(state))]
        counters[-1] = max(start, (counters[-1] or start - 1) + 1)
        return counters, [(counters[-1], ".".join("" if c is None else str(c) for c in counters))]

    made = streamed(placed, group, by, [], step, {value: "long", joined: "string"})
    said, plain = F.trim(F.coalesce(form, F.lit(""))), F.concat(F.col(value).cast("string"), F.lit("."))
    filled = F.replace(F.replace(F.replace(said, F.lit("^N"), F.concat(joined, F.lit("."))), F.lit("^n"), F.col(joined)), F.lit("^^"), F.lit("^"))
    filled = F.coalesce(F.nullif(F.trim(filled), F.lit("")), plain)
    return made.withColumn("marker", F.when(F.col(kind) == "bullet", F.coalesce(F.nullif(said, F.lit("")), F.lit("•"))).otherwise(filled)).select(*rows.columns, "marker")


def safe_breaks(cells: DataFrame, key: str, row: str, span: str) -> DataFrame:
    """Rows after which no cell reaches on: (key, row)."""
    reach = F.max(F.col(row) + F.col(span) - 1).over(W.partitionBy(key).orderBy(row).rangeBetween(W.unboundedPreceding, 0))
    (name,) = spare(cells, "reach")
    return cells.withColumn(name, reach).where(F.col(name) <= F.col(row)).select(key, row).distinct()


def on_pages(pages: DataFrame, areas: list[tuple[str, str]], page: str = "page") -> DataFrame:
    """Each page with the areas (name, scope) that show on it; areas are configuration."""
    from paperloom.functions.units import in_scope

    named = F.array(*[F.struct(F.lit(n).alias("area"), F.lit(s).alias("scope")) for n, s in areas])
    (area,) = spare(pages, "areas")
    return pages.withColumn(area, F.explode(named)).where(in_scope(F.col(f"{area}.scope"), F.col(page))).select(*pages.columns, f"{area}.*")


def first_by_priority(found: DataFrame, key: list[str], priority: dict[str, int], scope: str = "scope") -> DataFrame:
    """The row of each key whose scope comes first."""
    rank = F.coalesce(*[F.when(F.col(scope) == s, r) for s, r in priority.items()], F.lit(len(priority)))
    (n,) = spare(found, "place")
    return found.withColumn(n, F.row_number().over(W.partitionBy(*key).orderBy(rank, *[c for c in found.columns if c not in key]))).where(F.col(n) == 1).drop(n)
