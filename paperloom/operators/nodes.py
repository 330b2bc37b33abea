"""Trees of nested elements as rows: nodes numbered in pre-order, axes as joins.

A node and what is below it have the numbers node .. last, so an axis is a
containment of intervals. Only the order of tags needs a stack; a small loop
over the tags of each document keeps it, and names the tags in passing, which costs
less there than expressions over arrays; everything else is joins and windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import text as t
from paperloom.sources import tables

#: What is a tag; its name; its attributes, whose quoted values are the second group.
TAG = "<[^<>]+>"
NAME = r"^<\s*/?\s*(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)"
ATTRIBUTE = r"""([A-Za-z_:][\w:.-]*)\s*=\s*("[^"]*"|'[^']*')"""
_TAG, _NAMED, _ATTRIBUTE = (re.compile(x, re.ASCII) for x in (TAG, NAME, ATTRIBUTE))
_CLOSING, _END, _EMPTY = (re.compile(x, re.ASCII) for x in (r"<\s*/", r"<\s*/\s*[A-Za-z_][\w:.-]*\s*>\Z", r"/\s*>\Z"))
_NUMBER, _HEXADECIMAL, _SPECIAL = (re.compile(x, re.ASCII) for x in (r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[fFdD]?", r"([+-]?0[xX](?:[\da-fA-F]+\.?|[\da-fA-F]*\.[\da-fA-F]+)[pP][+-]?\d+)[fFdD]?", "[+-]?(?:NaN|(?i:inf|infinity))|(?i:nan)"))
_BLANKS = "".join(map(chr, range(33)))
_LEAST = [("node", T.IntegerType()), ("name", T.StringType()), ("parent", T.IntegerType()), ("depth", T.IntegerType()), ("last", T.IntegerType()), ("closed", T.BooleanType())]
_HELD = {"start": T.StringType(), "attributes": T.MapType(T.StringType(), T.StringType())}
#: How many characters of markup are worked on at a time.
PART = 1 << 20


def _kind(tag: str, void: set[str], only: set[str] | None) -> tuple[int, str]:
    """What a tag is (0 nothing, 1 start, 2 end, 3 empty element) and its name."""
    found = _NAMED.match(tag)
    name = found[1].lower() if found else ""
    if tag[1] in "?!" or not name or only and name not in only:
        return 0, name
    if _CLOSING.match(tag):
        return (2 if _END.match(tag) else 0), name
    return (3 if name in void or _EMPTY.search(tag) else 1), name


def _valued(tag: str) -> dict[str, str]:
    """As attributes() has them."""
    out = {}
    if "=" not in tag:
        return out
    for name, value in _ATTRIBUTE.findall(tag):
        value = value[1:-1]
        if "&" in value:
            for entity, char in t.ENTITIES:
                value = value.replace(entity, char)
        out[name.rsplit(":", 1)[-1]] = value
    return out


def _double(text: str | None) -> float | None:
    """As try_cast of a text to double."""
    text = (text or "").strip(_BLANKS)
    found = _NUMBER.fullmatch(text)
    if found or _SPECIAL.fullmatch(text):
        return float(found[1] if found else text)
    found = _HEXADECIMAL.fullmatch(text)
    try:
        return float.fromhex(found[1]) if found else None
    except OverflowError:
        return float("-inf" if text[0] == "-" else "inf")


def _higher(a: float | None, b: float | None) -> float | None:
    """As max: null is less, NaN more than any number."""
    return b if a is None or b is not None and (b > a or b != b) else a


def _lists(offsets: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _in_parts(work: Callable[[pa.Array, list[str]], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work(keys, pages) over batches of (key, markup), about PART characters at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, pages = 0, 0, []
            for k, page in enumerate(batch.column(1)):
                pages.append(page.as_py())
                size += len(pages[-1])
                if size >= PART or k + 1 == batch.num_rows:
                    yield work(batch.column(0).slice(at, len(pages)), pages)
                    at, size, pages = k + 1, 0, []

    return run


def parsed(docs: DataFrame, key: str, markup: str, void: list[str] = [], only: list[str] | None = None, held: tuple[str, ...] = ("texts", "start"), told: list[str] | None = None) -> DataFrame:  # noqa: B006
    """(key, nodes, texts, owners): each document's nodes, what stands between its tags and the open node after each tag (-1: none).

    An end tag closes what is open down to the nearest element of its name,
    all of it if there is none. What never ends reaches to the last node. Names
    are local and lower-case; elements of void names have no content; with
    only, tags of other names count for nothing. Null markup has no nodes.
    held says what comes along: texts (with owners), and of each node its start tag or its attributes.
    With told, nodes of other names are numbered but left out of nodes.
    """
    fields = _LEAST + [(n, k) for n, k in _HELD.items() if n in held]
    rows = docs.select(F.col(key).alias("key"), F.col(markup).alias("markup")).where("markup is not null")
    schema = T.StructType([rows.schema["key"], T.StructField("nodes", T.ArrayType(T.StructType([T.StructField(n, k) for n, k in fields])))])
    if "texts" in held:
        schema = schema.add("texts", T.ArrayType(T.StringType())).add("owners", T.ArrayType(T.IntegerType()))
    void, only, told = set(void), set(only) if only else None, set(told) if told else None

    def work(keys: pa.Array, pages: list[str]) -> pa.RecordBatch:
        seen: dict[str, tuple[int, str, dict | None]] = {}
        columns = {n: [] for n, _ in fields if n != "attributes"}
        node, name_of, parent, depth, last, closed = (columns[n] for n, _ in _LEAST)
        starts, pairs, names, values = columns.get("start"), [0], [], []
        texts, owners, ends, text_ends, owner_ends = [], [], [0], [0], [0]
        for page in pages:
            count, stack = 0, []  # of what is open: node, name, place among the told ones
            for tag in _TAG.findall(page):
                what = seen.get(tag)
                if what is None:
                    kind, name = _kind(tag, void, only)
                    tells = kind in (1, 3) and (not told or name in told)
                    what = seen[tag] = kind, name, (_valued(tag) if "attributes" in held else {}) if tells else None
                kind, name, found = what
                if kind == 2:
                    while stack:
                        _, opened, place = stack.pop()
                        if place >= 0:
                            last[place], closed[place] = count - 1, True
                        if opened == name:
                            break
                elif kind:
                    if found is not None:
                        node.append(count)
                        name_of.append(name)
                        parent.append(stack[-1][0] if stack else None)
                        depth.append(len(stack) + 1)
                        last.append(count)
                        closed.append(kind == 3)
                        if starts is not None:
                            starts.append(tag)
                        names += found
                        values += found.values()
                        pairs.append(len(names))
                    if kind == 1:
                        stack.append((count, name, len(node) - 1 if found is not None else -1))
                    count += 1
                if "texts" in held:
                    owners.append(stack[-1][0] if stack else -1)
            for _, _, place in stack:
                if place >= 0:
                    last[place] = count - 1
            ends.append(len(node))
            if "texts" in held:
                texts += _TAG.split(page)
                text_ends.append(len(texts))
                owner_ends.append(len(owners))
        kinds = {"name": pa.string(), "start": pa.string(), "closed": pa.bool_()}
        made = [pa.array(columns[n], kinds.get(n, pa.int32())) if n != "attributes" else pa.MapArray.from_arrays(pa.array(pairs, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string())) for n, _ in fields]
        out = [keys, _lists(ends, pa.StructArray.from_arrays(made, [n for n, _ in fields]))]
        if "texts" in held:
            out += [_lists(text_ends, pa.array(texts, pa.string())), _lists(owner_ends, pa.array(owners, pa.int32()))]
        return pa.RecordBatch.from_arrays(out, schema.names)

    return rows.mapInArrow(_in_parts(work), schema).withColumnRenamed("key", key)


def node_table(pages: DataFrame, key: str) -> DataFrame:
    """(key, node, name, parent, depth, last, closed, start): a row for each node of parsed documents; start is its tag, or there are attributes where these are held. key tells documents apart."""
    return pages.select(key, F.inline("nodes"))


def attributes(start: Column) -> Column:
    """A start tag's attributes by local name, of several the last; values without quotes and entities."""
    names = F.transform(F.regexp_extract_all(start, F.lit(ATTRIBUTE), F.lit(1)), lambda n: F.element_at(F.split(n, ":"), -1))
    values = F.transform(F.regexp_extract_all(start, F.lit(ATTRIBUTE), F.lit(2)), lambda v: t.named_entities(F.substring(v, F.lit(2), F.length(v) - 2)))
    last = lambda n, k: ~F.array_contains(F.slice(names, k + 2, F.size(names)), n)
    pairs = F.filter(F.transform(F.arrays_zip(names.alias("name"), values.alias("value")), lambda p, k: F.struct(p["name"].alias("key"), p["value"].alias("value"), last(p["name"], k).alias("last"))), lambda p: p["last"])
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["key"], p["value"])))


def children(nodes: DataFrame, key: str, name: str) -> DataFrame:
    """(key, node, children, named, first): how many children a node has, how many of a name, and the first of these."""
    is_named = F.col("name") == name
    found = nodes.where("parent is not null").groupBy(key, F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.count_if(is_named).alias("named"), F.min(F.when(is_named, F.col("node"))).alias("first"))
    return nodes.select(key, "node").join(found, [key, "node"], "left").fillna(0, ["children", "named"])


def within(nodes: DataFrame, around: DataFrame, key: str) -> DataFrame:
    """(key, node, ancestor): every pair of a node and one of around that it is below.

    Intervals are cut into dyadic blocks, at most two of a size, and a node
    meets the block of each size that it is in, so the join is one of equals and
    makes the pairs only, each once.
    """
    low, high = F.col("ancestor") + 1, F.col("last") + 1
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.lit(1), high - low) + 0.5)).cast("int"))
    cut = around.where("last > node").select(key, F.col("node").alias("ancestor"), "last").withColumn("level", F.explode(levels))
    first, end = F.expr(f"shiftright(cast(ancestor + 1 + shiftleft(1L, level) - 1 as long), level)"), F.expr("shiftright(cast(last + 1 as long), level)") - 1
    blocks = cut.withColumn("first", first).withColumn("end", end).where("first <= end")
    blocks = blocks.select(key, "ancestor", "level", F.explode(F.array_compact(F.array(F.when(F.col("first") % 2 == 1, F.col("first")), F.when(F.col("end") % 2 == 0, F.col("end"))))).alias("block"))
    deepest = blocks.groupBy(key).agg(F.max("level").alias("deepest"))
    met = nodes.select(key, "node").join(deepest, key).select(key, "node", F.explode(F.sequence(F.lit(0), F.col("deepest"))).alias("level")).withColumn("block", F.expr("shiftright(cast(node as long), level)"))
    return met.join(blocks, [key, "level", "block"]).select(key, "node", "ancestor")


def nearest(nodes: DataFrame, around: DataFrame, key: str) -> DataFrame:
    """(key, node, ancestor, ancestors): the nearest of around that each node is below, null if none, and how many there are."""
    found = within(nodes, around, key).groupBy(key, "node").agg(F.max("ancestor").alias("ancestor"), F.count("*").alias("ancestors"))
    return nodes.select(key, "node").join(found, [key, "node"], "left").fillna(0, ["ancestors"])


def descendants(nodes: DataFrame, key: str, of: Column, name: str) -> DataFrame:
    """(key, node, descendants): how many nodes of a name are below each node that of holds for, by differences of running counts."""
    upto = F.count_if(F.col("name") == name).over(W.partitionBy(key).orderBy("node").rowsBetween(W.unboundedPreceding, 0))
    counted = nodes.withColumn("upto", upto)
    ends = counted.select(key, F.col("node").alias("last"), F.col("upto").alias("end"))
    return counted.where(of).join(ends, [key, "last"]).select(key, "node", (F.col("end") - F.col("upto")).alias("descendants"))


def any_within(nodes: DataFrame, key: str, holds: Column) -> DataFrame:
    """(key, node, holds): whether holds is true of a node or of any below it, by differences of running counts."""
    flagged = nodes.select(key, "node", "last", F.coalesce(holds, F.lit(False)).cast("long").alias("flag"))
    flagged = flagged.withColumn("upto", F.sum("flag").over(W.partitionBy(key).orderBy("node").rowsBetween(W.unboundedPreceding, 0)))
    ends = flagged.select(key, F.col("node").alias("last"), F.col("upto").alias("end"))
    return flagged.join(ends, [key, "last"]).select(key, "node", (F.col("end") - F.col("upto") + F.col("flag") > 0).alias("holds"))


def row_summaries(docs: DataFrame, key: str, markup: str, row: str = "tr", cell: str = "tc", size: str = "cellsz") -> DataFrame:
    """(key, node, cells, max_height, paragraphs, text_length) of the rows of tables in XML that have cells: their cells, the greatest height among sizes below, and paragraphs and characters anywhere in them.

    Rows are summed up in the loop over a document's tags, an inner one into the
    row around it, so nodes and texts are no rows to shuffle and a task holds the open
    rows only. Nodes are numbered and closed as parsed() has them.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(markup).alias("markup")).where("markup is not null")
    kinds = {"node": (T.IntegerType(), pa.int32()), "cells": (T.LongType(), pa.int64()), "max_height": (T.DoubleType(), pa.float64()), "paragraphs": (T.LongType(), pa.int64()), "text_length": (T.LongType(), pa.int64())}
    schema = T.StructType([rows.schema["key"], *[T.StructField(n, k) for n, (k, _) in kinds.items()]])

    def work(keys: pa.Array, pages: list[str]) -> pa.RecordBatch:
        seen: dict[str, tuple[int, str, float | None]] = {}
        at, made = [], []

        def close(open_rows: list[list], document: int) -> None:
            found = open_rows.pop()
            if found[1]:
                at.append(document)
                made.append((*found[:2], 0.0 if found[2] is None else found[2], *found[3:]))
            if open_rows:
                around = open_rows[-1]
                around[2] = _higher(around[2], found[2])
                around[3] += found[3]
                around[4] += found[4]

        for k, page in enumerate(pages):
            count, end, stack, open_rows = 0, 0, [], []  # of what is open: names; node, cells, height, paragraphs and characters of rows
            for match in _TAG.finditer(page):
                tag = match[0]
                if open_rows:
                    open_rows[-1][4] += match.start() - end
                end = match.end()
                what = seen.get(tag)
                if what is None:
                    kind, name = _kind(tag, set(), None)
                    what = seen[tag] = kind, name, _double(_valued(tag).get("height")) if name == size else None
                kind, name, height = what
                if kind == 2:
                    while stack:
                        opened = stack.pop()
                        if opened == row:
                            close(open_rows, k)
                        if opened == name:
                            break
                elif kind:
                    if open_rows:
                        around = open_rows[-1]
                        if name == cell:
                            around[1] += stack[-1] == row
                        elif name == size:
                            around[2] = _higher(around[2], height)
                        elif name == "p":
                            around[3] += 1
                    if kind == 1:
                        stack.append(name)
                        if name == row:
                            open_rows.append([count, 0, None, 0, 0])
                    count += 1
            if open_rows:
                open_rows[-1][4] += len(page) - end
            while open_rows:
                close(open_rows, k)
        columns = list(zip(*made)) or [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *[pa.array(c, a) for c, (_, a) in zip(columns, kinds.values())]], schema.names)

    return rows.mapInArrow(_in_parts(work), schema).withColumnRenamed("key", key)


#: What stands for objects without text.
PLACEHOLDERS = {"image": "[이미지]", "shape": "[도형]", "textbox": "[텍스트박스]", "equation": "[수식]", "ole": "[OLE 개체]"}


def walk_blocks(pages: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """Nested blocks in pre-order: (key, node, kind, parent, depth, path, table_index, parent_table, nesting).

    kinds says what elements stand for: table, row, cell, paragraph or an object.
    pages were parsed with these names only. path leads from the document to the block by
    kind and place among its parent's children of that sort; table_index numbers
    tables, parent_table is the one that a block is in, nesting in how many.
    """
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("name")]
    blocks = node_table(pages, key).withColumn("kind", kind)
    sort = F.when(F.col("kind").isin("row", "cell"), F.col("kind")).otherwise("block")
    place = F.row_number().over(W.partitionBy(key, "parent", "sort").orderBy("node")) - 1
    blocks = blocks.withColumn("sort", sort).withColumn("step", F.concat("sort", F.lit("["), place.cast("string"), F.lit("]")))
    tables = F.sum((F.col("kind") == "table").cast("int")).over(W.partitionBy(key).orderBy("node").rowsBetween(W.unboundedPreceding, 0)) - 1
    blocks = blocks.withColumn("table_index", F.when(F.col("kind") == "table", tables))
    above = blocks.select(key, F.col("node").alias("ancestor"), F.col("step").alias("above"), "table_index")
    pairs = within(blocks, blocks, key).join(above, [key, "ancestor"])
    way = pairs.groupBy(key, "node").agg(F.sort_array(F.collect_list(F.struct("ancestor", "above"))).alias("way"), F.max("table_index").alias("parent_table"), F.count("table_index").alias("nesting"))
    found = blocks.join(way, [key, "node"], "left")
    path = F.array_join(F.concat(F.coalesce(F.transform("way", lambda x: x["above"]), F.array().cast("array<string>")), F.array("step")), "/")
    return found.select(key, "node", "kind", "parent", "depth", path.alias("path"), "table_index", "parent_table", F.coalesce("nesting", F.lit(0)).alias("nesting"))


def block_texts(pages: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """(key, node, kind, text) of nested blocks, folded from the deepest up.

    A cell has its blocks' texts that are not empty in lines, a row its cells between spaces, a
    table its rows in lines, a textbox its blocks in lines, trimmed. Text
    that stands in a block itself comes first. Objects without text have a name in brackets.
    Each level is a table in the shared folder and one join.
    """
    own = pages.select(key, F.posexplode(F.arrays_zip(F.col("owners").alias("node"), F.slice("texts", 2, F.size("texts")).alias("text"))).alias("at", "o")).select(key, "at", "o.node", "o.text").where("node >= 0 and text <> ''")
    own = own.groupBy(key, "node").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "").alias("own"))
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("name")]
    blocks = node_table(pages, key).withColumn("kind", kind).join(own, [key, "node"], "left")
    blocks = blocks.select(key, "node", "parent", "depth", "kind", F.coalesce(t.named_entities(F.trim("own")), F.lit("")).alias("own"))
    blocks = tables.saved(blocks, "blocks")
    deepest = blocks.agg(F.max("depth")).first()[0] or 0
    empty, out, below = F.array().cast("array<struct<node:int,kind:string,text:string>>"), None, None
    for level in range(deepest, 0, -1):
        here = blocks.where(F.col("depth") == level)
        if below is None:
            here = here.withColumn("below", empty)
        else:
            kids = below.groupBy(key, F.col("parent").alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "kind", "text"))).alias("below"))
            here = here.join(kids, [key, "node"], "left").withColumn("below", F.coalesce("below", empty))
        of = lambda *kinds: F.transform(F.filter("below", lambda b: b["kind"].isin(*kinds)), lambda b: b["text"])
        blocks_of = F.transform(F.filter("below", lambda b: ~b["kind"].isin("row", "cell")), lambda b: b["text"])
        first = F.filter(F.array("own"), lambda x: x != "")
        said = F.when(F.col("kind") == "table", F.array_join(of("row"), "\n")).when(F.col("kind") == "row", F.array_join(of("cell"), " "))
        said = said.when(F.col("kind") == "cell", F.array_join(F.filter(F.concat(first, blocks_of), lambda x: x != ""), "\n"))
        said = said.when(F.col("kind") == "textbox", F.trim(F.array_join(F.concat(first, blocks_of), "\n")))
        said = said.when(F.col("kind").isin("image", "shape"), "").otherwise(F.col("own"))
        names = F.create_map(*[F.lit(x) for pair in PLACEHOLDERS.items() for x in pair])
        below = tables.saved(here.select(key, "node", "parent", "kind", F.when((said == "") & F.map_contains_key(names, F.col("kind")), names[F.col("kind")]).otherwise(said).alias("text")), "texts")
        out = below if out is None else out.unionByName(below)
    return (out if out is not None else blocks.select(key, "node", "parent", "kind", F.col("own").alias("text"))).drop("parent")
