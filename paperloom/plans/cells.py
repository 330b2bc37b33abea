"""Lines of orders as cells, paragraphs and objects: rules, measures, names; pages' elements that show something."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import cells as f
from paperloom.functions import text as t
from paperloom.operators import nodes, reports
from paperloom.plans.trees import _tree
from paperloom.plans.web import VOID
from paperloom.sources.tables import table

c = F.col


def _pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)


_TEXTS = ["가 나 다 라", "가 나 다", "합 계", " 구분 ", "질병으로\n인한\n결석", "1. 항목", "a very long cell text indeed", "", "가 나 다 라 마", "x\n\ny\nz\nw"]


def _cells(spark, sf_dir):
    p, s = c("l_partkey"), c("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", ((c("l_linenumber") - 1) / 4).cast("long").alias("row"), (c("l_linenumber") * 10_000_000 + p).cast("long").alias("place"), _pick(_TEXTS, p).alias("text"), F.when(s % 3 > 0, 1 + s % 4 % 3).alias("row_span"), (1 + p % 2).alias("col_span"), (p % 3).alias("col"), (s % 5 == 0).alias("nested"))
    return rows.groupBy("l_orderkey", "row", "place", "text", "col_span", "col").agg(F.max("row_span").alias("row_span"), F.max("nested").alias("nested"))


def cell_rules(spark, sf_dir):
    """Labels, stacked texts and where cells stand, and whether their row is a compact header."""
    rows = _cells(spark, sf_dir)
    heads = rows.groupBy("l_orderkey", "row").agg(F.collect_list(F.struct("text", "row_span", "nested")).alias("cells")).select("l_orderkey", "row", f.is_compact_header(c("row"), c("cells")).alias("compact"))
    found = rows.join(heads, ["l_orderkey", "row"]).withColumn("stacked", f.stacked_lines(c("text"))).withColumn("grouped", f.is_group_label(c("text"), c("row_span"), c("col_span"), c("col"), c("nested")))
    given = _pick(["top", "bottom", "", "middle"], c("place"))
    return found.select("l_orderkey", "place", "compact", F.array_join("stacked", "|").alias("stacked"), "grouped", f.vertical_alignment(given, c("stacked").isNotNull(), c("grouped"), c("compact"), c("place") % 5 == 0).alias("stands"))


_FORM = ["등 록 신청서", "접수번호", "①", "②", "③", "담 임", "제목", "x"]


def form_tables(spark, sf_dir):
    """Orders as tables that may be forms or have a title beside approvals."""
    p = c("l_partkey")
    said = _pick(_FORM, p)
    tables = table(spark, sf_dir, "lineitem").select("l_orderkey", p, "l_suppkey", said.alias("said")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("said")).alias("said"), F.min("l_suppkey").alias("s"), F.count("*").alias("n"))
    text = F.array_join("said", " ")
    titles, approvals = F.filter("said", lambda x: x.isin("제목", "x", "①")), F.filter("said", lambda x: F.startswith(x, F.lit("담")) | (x == "②"))
    return tables.select("l_orderkey", f.is_primary_form(text).alias("form"), f.is_composite_header(c("s") % 2, c("n"), c("s") % 5, titles, approvals).alias("composite"))


def long_rows(spark, sf_dir):
    """Over how many pages rows of one cell go."""
    p, s, q = c("l_partkey"), c("l_suppkey"), c("l_quantity").cast("long")
    cell = F.struct((1 + p % 8 % 2).alias("row_span"), (s % 4 + 1).alias("col_span"), (q).alias("paragraphs"), (q * 4000).alias("height"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p, s, f.long_row_fragments(_pick(["hwpx", "hwpx", "hwp"], p), _pick(["cell", "CELL", "NONE"], s), F.array_repeat(cell, F.when(p % 7 == 0, 2).otherwise(1)), F.lit(4), F.when(p % 5 == 0, q * 9000), s % 3).alias("fragments"))
    return rows.where("fragments is not null").groupBy("l_orderkey").agg(F.count("*").alias("rows"), F.sum("fragments").alias("fragments"))


def paragraph_measures(spark, sf_dir):
    """Weights, heights, sizes and line heights of lines as blocks."""
    p, s, q = c("l_partkey"), c("l_suppkey"), c("l_quantity").cast("long")
    kind = _pick(["paragraph", "table", "image"], p)
    size = f.run_size((q / 4).cast("double"), F.when(s % 3 > 0, s % 3 * 75))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", p, s,
        f.continued_weight(kind, F.repeat(F.lit("word\n\n"), (q % 9).cast("int")), F.when(s % 2 > 0, q * 30), q).alias("weight"),
        f.block_height(kind, p % 2 == 0, F.when(s % 3 > 0, q * 100), q % 4, F.when(s % 5 > 1, q * 90), F.when(s % 5 == 0, q * 70), F.when(s % 7 == 0, q * 110), F.when(s % 7 == 1, q * 100), F.when(s % 7 == 2, q), q % 3).alias("height"),
        size.alias("size"),
        f.line_height(_pick(["percent", "fixed", "minimum", "space-only"], s), F.when(p % 6 > 0, q * 20), F.array(size)).alias("line_height"),
        f.is_blank_paragraph(F.when(s % 4 > 0, p % 3 - 1), F.when(p % 4 > 0, p % 4 - 2), s % 5 == 0, p % 5 == 0).alias("blank"),
    )
    return rows.distinct()


def object_places(spark, sf_dir):
    """Where objects stand, and which stand apart from text."""
    p, s, q = c("l_partkey"), c("l_suppkey"), c("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", p, s,
        f.is_placed_apart(p % 4 == 0, _pick(["column", "paper", "para"], p), _pick(["para", "page", "para", "para"], s), _pick(["square", "behind-text", "tight"], s), p % 3 == 0, s % 2 == 0).alias("apart"),
        f.coordinate(_pick(["left", "center", "right", "outside", "inside"], p), F.lit(25), q).cast("double").alias("x"),
        f.relative_ratio((p * 37 % 12_000).cast("double")).alias("ratio"), f.xml_size(q * 100 - 300, 7).alias("pixels"),
    )
    return rows.distinct()


def record_names(spark, sf_dir):
    p, s = c("p_partkey"), c("p_size")
    return table(spark, sf_dir, "part").select(p, f.record_name(p % 105).alias("record"), f.control_kind(_pick(["tbl ", "gso ", "eqed", "head", "foot", "secd", "fn  ", "en  ", "", "abcd"], p)).alias("control"), f.block_kind(s % 6).alias("block"), f.is_control_character(s % 30).alias("inline"), f.text_alignment(_pick(["CENTER", "Right", "x", "justify"], p)).alias("text"), f.cell_alignment(_pick(["CENTER", "Middle", "bottom", "x"], s)).alias("cell"), t.hash_36(c("p_name")).alias("hash"))


def status_labels(spark, sf_dir):
    """Labels of page counts and freshness, and where samples are served from."""
    p, n = c("p_partkey"), c("p_size")
    path = F.concat(_pick(["https://h/", "/root/in/", "/root/Down loads/", "/away/"], p), c("p_brand"), F.lit(".hwp"))
    at = f.served(path, "/root", "/root/Down loads", "/root/output/inputs", "http://localhost/")
    label = f.count_label(_pick(["ok", "fail"], p), {"verify": n, "diag": F.when(p % 3 > 0, n + 1), "dom": F.when(p % 4 > 0, p % 4), "visual": F.when(p % 5 == 0, n)})
    return table(spark, sf_dir, "part").select(p, label.alias("label"), f.freshness_label(p % 3 > 0, p % 2 == 0, p % 5 == 0).alias("freshness"), at["kind"].alias("kind"), at["path"].alias("path"), at["url"].alias("url"))


def visual_elements(spark, sf_dir):
    """Elements of pages that show something: text of their own or of what is in them, or a picture."""
    pages = nodes.parsed(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html", VOID)
    tree = nodes.node_table(pages, "page_id")
    said = pages.select("page_id", F.inline(F.arrays_zip(c("owners").alias("node"), F.slice("texts", 2, F.size("texts")).alias("text")))).where(F.regexp_like("text", F.lit(r"\S"))).groupBy("page_id", "node").agg(F.lit(True).alias("said"))
    marked = tree.join(said, ["page_id", "node"], "left")
    found = nodes.any_within(marked, "page_id", F.coalesce("said", F.lit(False)) | (c("name") == "img"))
    return found.join(tree.select("page_id", "node", "name"), ["page_id", "node"]).groupBy("name").agg(F.count("*").alias("elements"), F.count_if("holds").alias("visual"))


def tall_rows(spark, sf_dir):
    """The 20 tallest rows of each size class, of orders written as XML tables."""
    line = F.struct(c("l_linenumber").alias("n"), c("l_partkey").alias("p"), "l_suppkey", c("l_quantity").cast("long").alias("q"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    row = lambda x: ((x["n"] - 1) / 2).cast("long")
    cell = lambda x: F.concat(F.lit("<hp:tc><hp:p>"), F.repeat(F.lit("x"), F.coalesce(x["p"] % 5, F.lit(0)).cast("int")), F.lit('</hp:p><hp:cellSz height="'), F.coalesce((x["q"] * 100).cast("string"), F.lit("")), F.lit('"/></hp:tc>'))
    head = lambda x, k: F.when(k == 0, "<hp:tr>").when(row(x).eqNullSafe(row(F.get("lines", k - 1))), "").otherwise("</hp:tr><hp:tr>")
    tables = orders.select("l_orderkey", F.concat(F.lit("<hp:tbl>"), F.array_join(F.transform("lines", lambda x, k: F.concat(head(x, k), cell(x))), ""), F.lit("</hp:tr></hp:tbl>")).alias("xml"))
    found = nodes.row_summaries(tables, "l_orderkey", "xml").withColumn("size_class", c("l_orderkey") % 3)
    ranked = reports.top_by(found, ["size_class"], [F.desc("max_height"), F.desc("text_length"), F.asc("l_orderkey"), F.asc("node")], 20)
    return ranked.select("size_class", "rank", "l_orderkey", "cells", "max_height", "paragraphs", "text_length")


QUERIES = {g.__name__: g for g in (cell_rules, form_tables, long_rows, paragraph_measures, object_places, record_names, status_labels, visual_elements, tall_rows)}

_SQL_RECORDS = "CASE p_partkey % 105 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in [(16, "DOCUMENT_PROPERTIES"), (17, "ID_MAPPINGS"), (18, "BIN_DATA"), (19, "FACE_NAME"), (20, "BORDER_FILL"), (21, "CHAR_SHAPE"), (22, "TAB_DEF"), (23, "NUMBERING"), (24, "BULLET"), (25, "PARA_SHAPE"), (26, "STYLE"), (66, "PARA_HEADER"), (67, "PARA_TEXT"), (68, "PARA_CHAR_SHAPE"), (69, "PARA_LINE_SEG"), (71, "CTRL_HEADER"), (72, "LIST_HEADER"), (73, "PAGE_DEF"), (74, "FOOTNOTE_SHAPE"), (75, "PAGE_BORDER_FILL"), (76, "PAGE_NUM_PARA"), (77, "TABLE"), (78, "SHAPE_COMPONENT"), (79, "SHAPE_COMPONENT_LINE"), (80, "SHAPE_COMPONENT_RECTANGLE"), (81, "SHAPE_COMPONENT_ELLIPSE"), (82, "SHAPE_COMPONENT_ARC"), (83, "SHAPE_COMPONENT_POLYGON"), (84, "SHAPE_COMPONENT_OLE"), (85, "SHAPE_COMPONENT_PICTURE"), (86, "SHAPE_COMPONENT"), (87, "CONTAINER"), (88, "EQEDIT"), (89, "CTRL_DATA"), (95, "CHART_DATA"), (98, "VIDEO_DATA"), (99, "MEMO_SHAPE")]) + " ELSE 'TAG_' || p_partkey % 105 END"
_BASE = "(greatest(10.5, size) * (96.0 / 72.0))::DOUBLE"

ORACLES = {
    "cell_rules": f"""WITH l AS (SELECT l_orderkey AS k, (l_linenumber - 1) // 4 AS r, l_linenumber::BIGINT * 10000000 + l_partkey AS o, l_partkey % 10 AS i, 1 + l_partkey % 2 AS cs, l_partkey % 3 AS col, max(CASE WHEN l_suppkey % 3 > 0 THEN 1 + l_suppkey % 4 % 3 END) AS rs, bool_or(l_suppkey % 5 = 0) AS nested FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6),
        h AS (SELECT k, r, r = 0 AND count(*) BETWEEN 3 AND 6 AND bool_and(i NOT IN (6, 7) AND coalesce(rs, 1) = 1 AND NOT nested) AS compact FROM l GROUP BY 1, 2),
        g AS (SELECT l.*, compact, CASE i WHEN 0 THEN '가 나|다 라' WHEN 8 THEN '가 나|다 라|마' END AS stacked, coalesce(rs, 1) > 1 AND cs = 1 AND col <= 1 AND i NOT IN (5, 6, 7, 9) AND NOT nested AS grouped, ['top', 'bottom', '', 'middle'][o % 4 + 1] AS given, o % 5 = 0 AS mid FROM l JOIN h USING (k, r))
        SELECT k AS l_orderkey, o AS place, compact, stacked, grouped, CASE WHEN stacked IS NOT NULL OR grouped OR (given = 'top' AND (compact OR mid)) THEN 'middle' WHEN given <> '' THEN given WHEN mid THEN 'middle' ELSE 'top' END AS stands FROM g""",
    "form_tables": """WITH s AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey % 8) AS i, min(l_suppkey) AS s, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT k AS l_orderkey, list_contains(i, 0) OR list_has_all(i, [1, 2, 3, 4]) AS form, s % 2 = 0 AND n >= greatest(2, s % 5) AND len(list_filter(i, lambda x: x IN (3, 5))) = 1 AND list_contains(i, 5) AND len(list_filter(i, lambda x: x IN (2, 6, 7))) BETWEEN 1 AND 3 AS composite FROM s""",
    "long_rows": """WITH l AS (SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, l_quantity::BIGINT AS q FROM lineitem), h AS (SELECT *, ceil(CASE WHEN p % 5 = 0 THEN q * 9000 ELSE q * 4000 END / (greatest(1, s % 3) * 10000.0)) AS pages FROM l WHERE p % 3 < 2 AND s % 3 < 2 AND p % 7 > 0 AND p % 8 % 2 = 0 AND (s % 4 + 1) / 4.0 >= 0.7 AND q >= 12)
        SELECT k AS l_orderkey, count(*) AS rows, sum(least(12, pages))::BIGINT AS fragments FROM h WHERE pages >= 2 GROUP BY 1""",
    "paragraph_measures": f"""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey AS p, l_suppkey AS s, l_quantity::BIGINT AS q, l_partkey % 3 AS kind FROM lineitem),
        z AS (SELECT *, CASE WHEN q > 0 THEN floor(q / 4.0 * CASE WHEN s % 3 > 0 THEN s % 3 * 75 / 100.0 ELSE 1 END * 10 + 0.5) / 10 ELSE 0 END::DOUBLE AS size, CASE WHEN p % 6 > 0 THEN q * 20 ELSE 0 END AS sp FROM l)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN kind = 1 THEN greatest(4, least(40, q)) ELSE greatest(1, least(30, greatest(greatest(1, q % 9), CASE WHEN s % 2 > 0 AND q > 0 THEN ceil(q * 30 / 20.0) ELSE 1 END))) END::BIGINT AS weight,
            (CASE kind WHEN 1 THEN CASE WHEN s % 5 = 0 AND q > 0 THEN least(20000, greatest(1, floor(q * 70 / 75.0 + 0.5))) WHEN s % 5 > 1 AND q > 0 THEN CASE WHEN p % 2 = 0 THEN least(20000, q * 90 * 20) ELSE greatest(1, floor(q * 90 / 75.0 + 0.5)) END ELSE greatest(1, q % 4) * 28 END
                WHEN 0 THEN CASE WHEN s % 7 = 0 AND q > 0 THEN greatest(1, floor(q * 110 / 75.0 + 0.5)) WHEN s % 7 = 1 AND q > 0 THEN least(4000, q * 100) ELSE CASE WHEN s % 7 = 2 AND q > 0 THEN q ELSE 20 END * greatest(1, q % 3) END
                ELSE CASE WHEN s % 3 > 0 AND q > 0 THEN greatest(1, floor(q * 100 * CASE WHEN p % 2 = 0 THEN 96.0 / 2540 ELSE 1 / 75.0 END + 0.5)) ELSE 24 END END)::BIGINT AS height,
            size, CASE WHEN sp <= 0 THEN '' WHEN s % 4 = 1 THEN CASE WHEN floor(sp / 75.0 + 0.5) > 0 THEN least(200, floor(sp / 75.0 + 0.5)::BIGINT) || 'px' ELSE '' END WHEN s % 4 = 2 THEN greatest(floor({_BASE} * 1.2 + 0.5)::BIGINT, least(200, floor(sp / 75.0 + 0.5)::BIGINT)) || 'px'
                WHEN s % 4 = 3 THEN greatest(floor({_BASE} * 1.2 + 0.5)::BIGINT, floor({_BASE} + least(112, floor(sp / 75.0 + 0.5)) + 0.5)::BIGINT) || 'px' ELSE printf('%.2f', greatest(1.0, least(4.0, sp / 100.0))::DOUBLE) END AS line_height,
            s % 4 > 0 AND p % 3 - 1 <= 0 AND (p % 4 = 0 OR p % 4 - 2 <= 0) AND s % 5 <> 0 AND p % 5 <> 0 AS blank FROM z""",
    "object_places": """SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 4 <> 0 AND (l_partkey % 3 = 1 OR l_suppkey % 4 = 1 OR l_suppkey % 3 = 1 OR (l_partkey % 3 = 0 AND l_suppkey % 2 <> 0)) AS apart, CASE l_partkey % 5 WHEN 1 THEN greatest(0, (25 - l_quantity) / 2) WHEN 2 THEN greatest(0, 25 - l_quantity) WHEN 3 THEN greatest(0, 25 - l_quantity) ELSE 0 END::DOUBLE AS x,
            CASE WHEN l_partkey * 37 % 12000 <= 400 THEN l_partkey * 37 % 12000 / 100.0 WHEN l_partkey * 37 % 12000 <= 4000 THEN l_partkey * 37 % 12000 / 1000.0 ELSE l_partkey * 37 % 12000 / 10000.0 END::DOUBLE AS ratio, CASE WHEN l_quantity * 100 - 300 > 0 THEN greatest(1, floor((l_quantity * 100 - 300) * 96 / 2540 + 0.5))::BIGINT ELSE 7 END AS pixels FROM lineitem""",
    "record_names": f"""SELECT p_partkey, {_SQL_RECORDS} AS record, ['table', 'drawing', 'equation', 'header', 'footer', 'sectionDefinition', 'footnote', 'endnote', '', 'control'][p_partkey % 10 + 1] AS control, ['unknown', 'paragraph', 'table', 'image', 'shape', 'unknown'][p_size % 6 + 1] AS block, p_size % 30 BETWEEN 1 AND 9 OR p_size % 30 BETWEEN 11 AND 23 AS inline, ['center', 'right', 'left', 'justify'][p_partkey % 4 + 1] AS text, ['middle', 'middle', 'bottom', 'top'][p_size % 4 + 1] AS cell,
            (WITH RECURSIVE h AS (SELECT list_reduce(list_transform(string_split(p_name, ''), lambda x: ascii(x)::BIGINT), lambda a, b: (xor(a, b) * 16777619) & 4294967295, 2166136261::BIGINT) AS v), d AS (SELECT v AS rest, '' AS said FROM h UNION ALL SELECT rest // 36, '0123456789abcdefghijklmnopqrstuvwxyz'[rest % 36 + 1] || said FROM d WHERE rest > 0) SELECT said FROM d WHERE rest = 0) AS hash FROM part""",
    "status_labels": """WITH p AS (SELECT p_partkey AS p, p_size AS n, p_brand AS b, replace(p_brand, '#', '%23') AS e FROM part)
        SELECT p AS p_partkey, ['ok', 'fail'][p % 2 + 1] || ' / verify ' || n || CASE WHEN p % 3 > 0 THEN ' / diag ' || (n + 1) ELSE '' END || CASE WHEN p % 4 > 0 THEN ' / dom ' || p % 4 ELSE '' END || CASE WHEN p % 5 = 0 THEN ' / visual ' || n ELSE '' END AS label, CASE WHEN p % 3 = 0 THEN 'missing' WHEN p % 2 = 0 THEN 'stale' ELSE 'fresh' END || CASE WHEN p % 5 = 0 THEN ' (strict)' ELSE '' END AS freshness,
            ['url', 'workspace', 'downloads', 'external-local'][p % 4 + 1] AS kind, ['https://h/' || b || '.hwp', '/root/in/' || b || '.hwp', '/root/Down loads/' || b || '.hwp', '/root/output/inputs/' || b || '.hwp'][p % 4 + 1] AS path, ['https://h/' || b || '.hwp', 'http://localhost/in/' || e || '.hwp', 'http://localhost/Down%20loads/' || e || '.hwp', 'http://localhost/output/inputs/' || e || '.hwp'][p % 4 + 1] AS url FROM p""",
    "visual_elements": f"""{_tree()}, f AS (SELECT r.page_id, r.pos, max(k.i) AS i FROM r JOIN k ON k.page_id = r.page_id AND k.pos <= r.pos WHERE regexp_matches(r.text, '\\S') GROUP BY 1, 2),
        v AS (SELECT f.page_id, unnest(s.ids) AS node FROM f JOIN s ON s.page_id = f.page_id AND s.i = f.i UNION SELECT page_id, node FROM n WHERE name = 'img' UNION SELECT page_id, unnest(above) FROM n WHERE name = 'img')
        SELECT name, count(*) AS elements, count(v.node) AS visual FROM n LEFT JOIN v ON v.page_id = n.page_id AND v.node = n.node GROUP BY 1""",
    "tall_rows": """WITH l AS (SELECT l_orderkey AS k, (l_linenumber - 1) // 2 AS r, l_partkey % 5 AS x, l_quantity::BIGINT * 100 AS h FROM lineitem), w AS (SELECT k, r, count(*) AS cells, max(h)::DOUBLE AS max_height, count(*) AS paragraphs, sum(x)::BIGINT AS text_length FROM l GROUP BY 1, 2)
        SELECT k % 3 AS size_class, row_number() OVER (PARTITION BY k % 3 ORDER BY max_height DESC, text_length DESC, k, r) AS rank, k AS l_orderkey, cells, max_height, paragraphs, text_length FROM w QUALIFY rank <= 20""",
}
