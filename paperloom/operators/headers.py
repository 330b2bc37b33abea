"""Dictionaries of style from the elements of a header: rows of a node table pivoted by what stands below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import codes
from paperloom.operators import nodes
from paperloom.sources import tables

#: Attributes of a font reference in the order in which the main and the Latin font look for one.
MAIN = ["hangul", "other", "latin", "hanja", "japanese", "symbol", "user"]
LATIN = ["latin", "hangul", "other", "hanja", "japanese", "symbol", "user"]


def described(pages: DataFrame, key: str) -> DataFrame:
    """The node table of parsed headers with attributes as a map."""
    tree = nodes.node_table(pages, key)
    return tree if "attributes" in tree.columns else tree.withColumn("attributes", nodes.attributes(F.col("start"))).drop("start")


def pivoted(tree: DataFrame, key: str, name: str | list[str], children: dict[str, tuple[str, str | None]], below: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, node, attributes, a column for each entry) of the elements of a name or some: the attribute of their first child of a name, or of the first element of a name anywhere below. Null where there is none; a child without attribute in its entry gives an empty text."""
    own = F.col("name").isin(name)
    of_children, of_below = ({c for c, _ in x.values()} for x in (children, below))
    rows = tree.where(F.col("name").isin(*([name] if isinstance(name, str) else name), *of_children, *of_below))
    later = W.partitionBy(key).orderBy(F.desc("node")).rowsBetween(W.unboundedPreceding, -1)
    for k, c in enumerate(sorted(of_below)):
        # numbers are in pre-order: the next element of the name is the first one below, or none is
        next_one = F.last(F.when(F.col("name") == c, F.struct("node", F.col("attributes").alias("held"))), ignorenulls=True).over(later)
        rows = rows.withColumn(f"below_{k}", next_one)
    found = {n: F.when(F.col(f"below_{k}.node") <= F.col("last"), F.try_element_at(F.col(f"below_{k}.held"), F.lit(a))) for n, (c, a) in below.items() for k in [sorted(of_below).index(c)]}
    # an element meets its children under its own number; it may be a child of another as well
    itself = F.struct(F.col("node").alias("of"), F.lit(None).cast("int").alias("inner"), F.struct("attributes", *[v.alias(n) for n, v in found.items()]).alias("own"))
    child = F.struct(F.col("parent").alias("of"), F.col("node").alias("inner"), F.lit(None).cast(rows.select(itself.own.alias("own")).schema["own"].dataType).alias("own"))
    is_child = F.col("name").isin(*of_children) & F.col("parent").isNotNull() if of_children else F.lit(False)
    # one struct for each name of a child, so that what is aggregated doesn't grow with the attributes asked for
    asked = {c: [(n, a) for n, (of, a) in children.items() if of == c] for c in sorted(of_children)}
    said = lambda c: F.struct(*[(F.lit("") if a is None else F.try_element_at("attributes", F.lit(a))).alias(n) for n, a in asked[c]])
    told = rows.select(key, F.explode(F.array_compact(F.array(F.when(own, itself), F.when(is_child, child)))).alias("m"), *[F.when(F.col("name") == c, said(c)).alias(f"child_{k}") for k, c in enumerate(asked)])
    told = told.select(key, F.col("m.of").alias("node"), F.col("m.inner").alias("inner"), F.col("m.own").alias("own"), *[f"child_{k}" for k in range(len(asked))])
    # the least number is the first child of the name, whatever it says
    met = told.groupBy(key, "node").agg(F.first("own", ignorenulls=True).alias("own"), *[F.min_by(f"child_{k}", F.when(F.col(f"child_{k}").isNotNull(), F.col("inner"))).alias(f"child_{k}") for k in range(len(asked))])
    return met.where("own is not null").select(key, "node", "own.*", *[F.col(f"child_{list(asked).index(c)}.{n}").alias(n) for n, (c, _) in children.items()])


def fonts(tree: DataFrame, key: str) -> DataFrame:
    """(key, lang, id, face): fonts by language, HANGUL where none is said, and number; the last of a number."""
    is_face, of = F.col("name") == "fontface", lambda n: F.try_element_at("attributes", F.lit(n))
    rows = tree.where(F.col("name").isin("fontface", "font")).select(key, F.when(is_face, F.col("node")).otherwise(F.col("parent")).alias("of"), F.when(is_face, F.upper(F.coalesce(F.nullif(of("lang"), F.lit("")), F.lit("HANGUL")))).alias("lang"), F.when(~is_face & of("id").isNotNull(), F.struct(of("id").alias("id"), "node", F.coalesce(of("face"), F.lit("")).alias("face"))).alias("font"))
    met = rows.where("of is not null").groupBy(key, "of").agg(F.max("lang").alias("lang"), F.collect_list("font").alias("fonts")).where("lang is not null")
    return met.select(key, "lang", F.inline("fonts")).groupBy(key, "lang", "id").agg(F.max_by("face", "node").alias("face"))


def _first(attributes: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(attributes, F.lit(n)), F.lit("")) for n in names])


def _number(c: Column, other: int | None = 0) -> Column:
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(other))


def character_styles(tree: DataFrame, key: str) -> DataFrame:
    """(key, id, font, latin, size, bold, italic): characters' styles by number, the last of a number.

    The main font is the one that the reference's first attribute names among
    HANGUL, else OTHER, else LATIN fonts; the Latin one is told where it is
    another. Empty where no dictionary has it. Sizes are tenths of a point.
    """
    held = tree.where(F.col("name").isin("charpr", "fontref", "bold", "italic", "fontface", "font"))
    tree = tables.saved(held.select(key, "node", "parent", "name", "attributes"), "styles")
    flag = lambda n: F.coalesce(F.bool_or(F.col("name") == n), F.lit(False)).alias(n)
    # a style meets what is in it under its own number
    is_style = F.col("name") == "charpr"
    rows = tree.where(F.col("name").isin("charpr", "fontref", "bold", "italic")).withColumn("of", F.explode(F.array_compact(F.array(F.when(is_style, F.col("node")), F.when(~is_style, F.col("parent"))))))
    rows = rows.groupBy(key, F.col("of").alias("node")).agg(F.first(F.when(is_style, F.col("attributes")), ignorenulls=True).alias("attributes"), F.min_by("attributes", F.when(F.col("name") == "fontref", F.col("node"))).alias("refs"), flag("bold"), flag("italic")).where("attributes is not null")
    rows = rows.select(key, "node", _number(F.try_element_at("attributes", F.lit("id")), None).cast("long").alias("id"), _number(F.try_element_at("attributes", F.lit("height"))).alias("height"), _first(F.col("refs"), MAIN).alias("main"), _first(F.col("refs"), LATIN).alias("other"), F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("italic", F.lit(False)).alias("italic")).where("id is not null")
    known = fonts(tree, key).withColumn("face", F.nullif("face", F.lit("")))

    def named(rows, by, langs, out):
        table = known.where(F.col("lang").isin(*langs)).groupBy(key, F.col("id").alias(by)).agg(*[F.max(F.when(F.col("lang") == lang, F.col("face"))).alias(f"in_{lang}") for lang in langs])
        return rows.join(table, [key, by], "left").withColumn(out, F.coalesce(*[F.col(f"in_{lang}") for lang in langs], F.lit(""))).drop(*[f"in_{lang}" for lang in langs])

    rows = named(named(rows, "main", ["HANGUL", "OTHER", "LATIN"], "font"), "other", ["LATIN"], "latin")
    size = F.when(F.col("height") > 0, F.floor(F.col("height") / 10 + 0.5) / 10).otherwise(0.0)
    said = F.struct("font", F.when(F.col("latin") != F.col("font"), F.col("latin")).otherwise("").alias("latin"), size.alias("size"), "bold", "italic")
    return rows.groupBy(key, "id").agg(F.max_by(said, "node").alias("style")).select(key, "id", "style.*")


def border_fills(tree: DataFrame, key: str) -> DataFrame:
    """(key, id, left, right, top, bottom, fill): types of the borders, NONE where none is said, and the colour of the brush anywhere below; by number, the last of a number."""
    sides = ("left", "right", "top", "bottom")
    rows = pivoted(tree, key, "borderfill", {s: (f"{s}border", "type") for s in sides}, {"fill": ("winbrush", "faceColor")})
    said = F.struct(*[F.coalesce(F.nullif(s, F.lit("")), F.lit("NONE")).alias(s) for s in sides], "fill")
    rows = rows.select(key, "node", _number(F.try_element_at("attributes", F.lit("id")), None).cast("long").alias("id"), said.alias("style")).where("id is not null")
    return rows.groupBy(key, "id").agg(F.max_by("style", "node").alias("style")).select(key, "id", "style.*")


def _signed(c: Column) -> Column:
    """A number stored as 32 bits without sign."""
    low = F.coalesce(F.trim(c).try_cast("long"), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low > 0x7FFFFFFF, low - (1 << 32)).otherwise(F.coalesce(F.trim(c).try_cast("long"), F.lit(0)))


def placements(tree: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, node, name of each measure) of placed objects: in line or not, what they are placed against and how, signed offsets, protection, order.

    Offsets are those of pos, or where an object has none, of offset.
    """
    entries = {n: ("pos", a) for n, a in (("treat", "treatAsChar"), ("spacing", "affectLSpacing"), ("flow", "flowWithText"), ("over", "allowOverlap"), ("hold", "holdAnchorAndSO"), ("horz", "horzRelTo"), ("vert", "vertRelTo"), ("across", "horzAlign"), ("down", "vertAlign"), ("pos_x", "horzOffset"), ("pos_y", "vertOffset"))}
    entries |= {"x": ("offset", "x"), "y": ("offset", "y"), "protect": ("sz", "protect"), "left": ("outmargin", "left"), "right": ("outmargin", "right")}
    rows = pivoted(tree, key, names, entries | {"has_pos": ("pos", None)}, {})
    has = F.col("has_pos").isNotNull()
    on = lambda c: F.coalesce(F.col(c) == "1", F.lit(False))
    return rows.select(
        key, "node", on("treat").alias("inline"), on("spacing").alias("affects_spacing"), on("flow").alias("flows"), on("over").alias("overlap"), on("hold").alias("keep"), on("protect").alias("protected"),
        codes.known_name(F.col("horz"), codes.RELATIVE_NAMES, "column").alias("horz"), codes.known_name(F.col("vert"), codes.RELATIVE_NAMES, "para").alias("vert"), codes.known_name(F.col("across"), codes.ALIGNED_NAMES, "left").alias("across"), codes.known_name(F.col("down"), codes.ALIGNED_NAMES, "top").alias("down"),
        _signed(F.when(has, F.col("pos_x")).otherwise(F.col("x"))).alias("x"), _signed(F.when(has, F.col("pos_y")).otherwise(F.col("y"))).alias("y"),
        _number(F.try_element_at("attributes", F.lit("zOrder"))).alias("order"), _number(F.col("left")).alias("margin_left"), _number(F.col("right")).alias("margin_right"),
    )


def pictures(tree: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """(key, node, ref, source, width, height) of pictures whose image is known; images has (key, ref, source). The current size counts where both measures are above 0, else both of the original one."""
    entries = {n: (e, a) for n, e, a in (("cw", "cursz", "width"), ("ch", "cursz", "height"), ("ow", "orgsz", "width"), ("oh", "orgsz", "height"))}
    rows = pivoted(tree, key, "pic", entries, {"ref": ("img", "binaryItemIDRef")})
    known = images.where("source <> ''").groupBy(key, "ref").agg(F.max("source").alias("source"))
    size = {c: _number(F.col(c)) for c in ("cw", "ch", "ow", "oh")}
    current = (size["cw"] > 0) & (size["ch"] > 0)
    return rows.join(known, [key, "ref"]).select(key, "node", "ref", "source", F.when(current, size["cw"]).otherwise(size["ow"]).alias("width"), F.when(current, size["ch"]).otherwise(size["oh"]).alias("height"))


def table_metrics(cells: DataFrame, tables: DataFrame, key: str, table: str) -> DataFrame:
    """(key, table, rows, cells, merged, row_heights, policy, breaks) of tables: what their cells say and how they break.

    cells has (key, table, row, col, row_span, col_span, height), tables (key, table, page_break, split).
    row_heights has each row's highest cell, null without any; merged counts cells
    over rows or columns. The policy is the one said, unless nothing or 0 is, then split's:
    CELL, SPLIT, RESERVED, else NONE. Tables without cells have no rows.
    """
    over = (F.col("row_span") > 1) | (F.col("col_span") > 1)
    rows = cells.groupBy(key, table, "row").agg(F.count("*").alias("n"), F.count_if(over).alias("merged"), F.max(F.when(F.col("height") > 0, F.col("height"))).alias("height"))
    whole = rows.groupBy(key, table).agg(F.count("*").alias("rows"), F.sum("n").alias("cells"), F.sum("merged").alias("merged"), F.transform(F.sort_array(F.collect_list(F.struct("row", "height"))), lambda r: r["height"]).alias("row_heights"))
    said = F.upper(F.trim(F.coalesce("page_break", F.lit(""))))
    split = F.coalesce("split", F.lit(0))
    policy = F.when(~said.isin("", "0"), said).otherwise(codes.by_code(split, ["NONE", "CELL", "SPLIT", "RESERVED"], "NONE"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    found = tables.withColumn("policy", policy).join(whole, [key, table], "left")
    return found.select(key, table, zero("rows"), zero("cells"), zero("merged"), F.coalesce("row_heights", F.array().cast("array<double>")).alias("row_heights"), "policy", ((split > 0) | (F.col("policy") != "NONE")).alias("breaks"))


def spine_order(files: DataFrame, spine: DataFrame, key: str, pattern: str = r"(?:^|/)section([0-9]+)\.xml$") -> DataFrame:
    """(key, path, place): files (key, path) that pattern fits, in the order of a spine (key, pos, href), then the others by number; each once.

    A spine entry finds the file of its name, else the first that differs in case or slashes only; entries
    without a file count for nothing, of several for one file the first counts.
    """
    plain = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    number = F.regexp_extract(plain(F.col("path")), f"(?i){pattern}", 1)
    held = files.select(key, "path").distinct().withColumn("number", number.try_cast("long")).where("number is not null").withColumn("folded", F.lower(plain(F.col("path"))))
    wanted = spine.select(key, "pos", F.col("href").alias("href"), F.lower(plain(F.col("href"))).alias("folded"))
    met = wanted.join(held.select(key, "folded", "path"), [key, "folded"])
    chosen = met.groupBy(key, "pos", "href").agg(F.min(F.struct((F.col("path") != F.col("href")).alias("other"), "path")).alias("best"))
    first = chosen.groupBy(key, F.col("best.path").alias("path")).agg(F.min("pos").alias("pos"))
    order = W.partitionBy(key).orderBy(F.asc_nulls_last("pos"), "number", "path")
    return held.join(first, [key, "path"], "left").withColumn("place", F.row_number().over(order) - 1).select(key, "path", "place")


def first_existing(rows: DataFrame, key: str, candidates: Column, existing: DataFrame, path: str = "path") -> DataFrame:
    """(key, found, exists): the first of each row's candidate paths that exists, else its first candidate; null without one. Null and empty candidates and repeats don't count; existing is a listing of paths."""
    listed = F.array_distinct(F.filter(candidates, lambda c: c.isNotNull() & (c != "")))
    tried = rows.select(F.col(key).alias("key"), listed.alias("tried"))
    held = existing.select(F.col(path).alias("candidate")).distinct()
    found = tried.select("key", F.posexplode("tried").alias("n", "candidate")).join(held, "candidate").groupBy("key").agg(F.min_by("candidate", "n").alias("first"))
    return tried.join(found, "key", "left").select(F.col("key").alias(key), F.coalesce("first", F.get("tried", F.lit(0))).alias("found"), F.col("first").isNotNull().alias("exists"))
