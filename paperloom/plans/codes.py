"""Property codes, names and numbers, on values derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import codes, units
from paperloom.plans.pages import _DIAG, _diagnosed
from paperloom.sources.tables import table

_WORDS = ["Center", "RIGHT", " in_side ", "outside", "Top And_Bottom", "page", "COLUMN", "", "at_least", "Ratio", "fixedvalue", "between-lines", "exactly"]


def _parts(spark, sf_dir):
    key = F.col("p_partkey")
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (key % len(_WORDS)).cast("int") + 1)
    digits = F.lpad(F.hex(key * 7919 % 16777216), 6, "0")
    colour = F.when(key % 6 == 0, "none").when(key % 6 == 1, F.concat(F.lit("#"), digits)).when(key % 6 == 2, F.concat(F.lit("FF"), digits)).when(key % 6 == 3, " ").when(key % 6 == 4, "red")
    return table(spark, sf_dir, "part").select(key.cast("long").alias("p_partkey"), F.col("p_size").cast("long").alias("p_size"), word.alias("word"), colour.alias("colour"))


def colour_names(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", codes.hex_colour(F.col("colour")).alias("colour"))


def object_names(spark, sf_dir):
    word = F.col("word")
    return _parts(spark, sf_dir).select("p_partkey", codes.known_name(word, codes.RELATIVE_NAMES, "column").alias("relative"), codes.known_name(word, codes.ALIGNED_NAMES, "left").alias("aligned"), codes.spacing_type(word).alias("spacing"))


def object_codes(spark, sf_dir):
    code = F.col("p_size") % 8
    return _parts(spark, sf_dir).select(
        "p_partkey",
        codes.by_code(code, codes.RELATIVE_TO["horz"], "column").alias("across"),
        codes.by_code(code, codes.RELATIVE_TO["vert"], "para").alias("down"),
        codes.by_code(code, codes.ALIGNED["vert"], "top").alias("aligned"),
        codes.by_code(code, codes.WRAPS, codes.WRAPS[0]).alias("wrap"),
        codes.by_code(code, codes.FLOWS, codes.FLOWS[0]).alias("flow"),
        codes.by_code(code, list(codes.SPACING), "").alias("spacing"),
        codes.paragraph_alignment(F.col("p_partkey")).alias("paragraph"),
    )


def page_counts(spark, sf_dir):
    key = F.col("o_orderkey")
    said = F.concat(F.lit("p "), (key % 7).cast("string"), F.lit("/"), (key % 13).cast("string"), F.when(key % 5 != 0, "쪽").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", codes.page_count(key % 3 - 1, said).alias("pages"))


def first_numbers(spark, sf_dir):
    said = F.concat(F.lit("w="), F.when(F.col("p_partkey") % 4 == 0, "auto").otherwise(F.concat((F.col("p_size") - 20).cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit("mm"))))
    return _parts(spark, sf_dir).select("p_partkey", codes.first_number(said).alias("mm"))


def scan_scores(spark, sf_dir):
    """Orders as scans: lines as paragraphs, other columns as what was found in them."""
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("tables"), F.sum(F.col("l_quantity").cast("long")).alias("cells"))
    return found.select("l_orderkey", codes.scan_score(F.col("n"), F.col("tables"), F.col("cells"), F.col("n") * 2, F.col("n") * 3, F.col("n") >= 6).alias("score"))


def line_metrics(spark, sf_dir):
    """Line and layout heights in pixels from an order's lines of 200 to 14400 units, those of objects (every fifth part) left out; 0 without any."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey"), (F.col("l_quantity") * 300).cast("long").alias("height"))
    objects = lines.where("l_partkey % 5 = 0").select("l_orderkey", "l_linenumber").distinct()
    kept = lines.join(objects, ["l_orderkey", "l_linenumber"], "left_anti").where("height between 200 and 14400")
    sums = kept.groupBy("l_orderkey").agg(F.sum("height").alias("all"), F.count("*").alias("n"))
    clamped = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), units.rounded(c / 75))).cast("long")
    found = sums.select("l_orderkey", clamped(F.col("all") / F.col("n"), 11, 96).alias("line_px"), clamped(F.col("all"), 12, 480).alias("layout_px"))
    every = lines.select("l_orderkey").distinct()
    return every.join(found, "l_orderkey", "left").select("l_orderkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("line_px", "layout_px")])


def page_labels(spark, sf_dir):
    """What a page has, as labels of the counts above zero."""
    return _diagnosed(spark, sf_dir).select("doc_id", "page", F.concat_ws(", ", codes.labelled({n: F.col(n) for n in ("tables", "links", "tall", "text_runs")})).alias("labels"))


def natural_sections(spark, sf_dir):
    """Sections of each size class in the order of the number in their names, and in that of their names as text."""
    from pyspark.sql import Window as W

    name = F.concat(F.lit("Contents/section"), F.col("p_partkey").cast("string"), F.lit(".xml"))
    rows = _parts(spark, sf_dir).select("p_size", name.alias("name"))
    number = F.regexp_extract("name", r"section(\d+)\.xml$", 1).cast("long")
    return rows.select("p_size", "name", F.row_number().over(W.partitionBy("p_size").orderBy(number)).alias("natural"), F.row_number().over(W.partitionBy("p_size").orderBy("name")).alias("as_text"))


QUERIES = {f.__name__: f for f in (colour_names, object_names, object_codes, page_counts, first_numbers, scan_scores, line_metrics, page_labels, natural_sections)}


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_SQL = f"""p AS (SELECT p_partkey::BIGINT AS p_partkey, p_size::BIGINT AS p_size, {_list(_WORDS)}[p_partkey % {len(_WORDS)} + 1] AS word, printf('%06X', (p_partkey * 7919 % 16777216)::BIGINT) AS digits FROM part),
d AS (SELECT *, regexp_replace(lower(trim(word)), '[_\\s]+', '-', 'g') AS dashed, lower(trim(word)) AS raw FROM p)"""

ORACLES = {
    "colour_names": f"WITH {_SQL} SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '#' || digits WHEN 2 THEN '#' || digits WHEN 3 THEN '' WHEN 4 THEN 'red' ELSE '' END AS colour FROM p",
    "object_names": f"""WITH {_SQL} SELECT p_partkey, CASE WHEN dashed IN ({", ".join(f"'{x}'" for x in codes.RELATIVE_NAMES)}) THEN dashed ELSE 'column' END AS relative, CASE WHEN dashed IN ({", ".join(f"'{x}'" for x in codes.ALIGNED_NAMES)}) THEN dashed ELSE 'left' END AS aligned,
        CASE {" ".join(f"WHEN list_contains({_list(v)}, raw) THEN '{k}'" for k, v in codes.SPACING.items())} ELSE raw END AS spacing FROM d""",
    "object_codes": f"""WITH {_SQL}, c AS (SELECT p_partkey, p_size % 8 + 1 AS c FROM p)
        SELECT p_partkey, coalesce({_list(codes.RELATIVE_TO["horz"])}[c], 'column') AS across, coalesce({_list(codes.RELATIVE_TO["vert"])}[c], 'para') AS down, coalesce({_list(codes.ALIGNED["vert"])}[c], 'top') AS aligned, coalesce({_list(codes.WRAPS)}[c], 'top-and-bottom') AS wrap,
        coalesce({_list(codes.FLOWS)}[c], 'both-sides') AS flow, coalesce({_list(codes.SPACING)}[c], '') AS spacing, coalesce({_list(codes.PARAGRAPHS)}[((p_partkey >> 2) & 7) + 1], 'left') AS paragraph FROM c""",
    "page_counts": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 1 WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 13 END AS pages FROM orders",
    "first_numbers": f"WITH {_SQL} SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE ((p_size - 20) || '.' || (p_partkey % 10))::DOUBLE END AS mm FROM p",
    "scan_scores": "SELECT l_orderkey, count(*) * 12 + count(*) FILTER (l_quantity > 25) * 25 + sum(l_quantity::BIGINT) * 8 + count(*) * 8 + count(*) * 3 - CASE WHEN count(*) >= 6 THEN 200 ELSE 0 END AS score FROM lineitem GROUP BY 1",
    "line_metrics": """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity * 300)::BIGINT AS h FROM lineitem), k AS (SELECT * FROM l a WHERE h BETWEEN 200 AND 14400 AND NOT EXISTS (SELECT 1 FROM l b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.l_partkey % 5 = 0)),
        s AS (SELECT l_orderkey, greatest(11, least(96, floor(sum(h) / count(*)::DOUBLE / 75 + 0.5))) AS line_px, greatest(12, least(480, floor(sum(h) / 75.0 + 0.5))) AS layout_px FROM k GROUP BY 1)
        SELECT l_orderkey, coalesce(line_px, 0)::BIGINT AS line_px, coalesce(layout_px, 0)::BIGINT AS layout_px FROM (SELECT DISTINCT l_orderkey FROM l) LEFT JOIN s USING (l_orderkey)""",
    "page_labels": f"{_DIAG} SELECT doc_id, page, concat_ws(', ', CASE WHEN tables > 0 THEN 'tables ' || tables END, CASE WHEN links > 0 THEN 'links ' || links END, CASE WHEN tall > 0 THEN 'tall ' || tall END, CASE WHEN text_runs > 0 THEN 'text_runs ' || text_runs END) AS labels FROM diag",
    "natural_sections": f"WITH {_SQL}, n AS (SELECT p_size, p_partkey, 'Contents/section' || p_partkey || '.xml' AS name FROM p) SELECT p_size, name, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey)::INT AS natural, row_number() OVER (PARTITION BY p_size ORDER BY name)::INT AS as_text FROM n",
}
