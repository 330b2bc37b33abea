"""Lines, pages, layout and page diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import text as t
from paperloom.functions import units
from paperloom.operators import flow, reports
from paperloom.sources.tables import table

BUDGET = 8
AREAS = [("head", "BOTH"), ("left", "EVEN"), ("right", "ODD"), ("title", "FIRST")]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.text_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def doc_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


def clean_blank_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n\n\n")).alias("text"))
    return flow.cap_blank_runs(flow.text_lines(docs), "doc_id", "line_no", "line")


def _weighted(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", "line", t.utf16_length(F.col("line")).alias("units"), flow.line_weight(F.col("line")).alias("weight"))


def line_weights(spark, sf_dir):
    return _weighted(spark, sf_dir).drop("line")


def paginate_docs(spark, sf_dir):
    return flow.paginate(_weighted(spark, sf_dir), "doc_id", "line_no", "weight", BUDGET)


def _diagnosed(spark, sf_dir):
    """Counters of pages. Lines are asked what they hold before they are put on pages, so no text is shuffled."""
    lines = _weighted(spark, sf_dir).select("doc_id", "line_no", "units", "weight", F.contains("line", F.lit("|")).alias("table"), F.contains("line", F.lit("http")).alias("link"), (F.trim("line") != "").alias("said"))
    paged = flow.paginate(lines, "doc_id", "line_no", "weight", BUDGET, ("units", "weight", "table", "link", "said"))
    return paged.groupBy("doc_id", "page").agg(
        F.count("*").alias("blocks"),
        F.count_if("table").alias("tables"),
        F.count_if("link").alias("links"),
        F.count_if("said").alias("text_runs"),
        F.count_if(F.col("weight") >= 4).alias("tall"),
        F.sum("units").cast("long").alias("units"),
    )


def page_diagnostics(spark, sf_dir):
    return _diagnosed(spark, sf_dir)


def doc_rollup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    joined = _diagnosed(spark, sf_dir).join(docs, "doc_id")
    return joined.rollup("lang", "source").agg(F.count("*").alias("pages"), F.countDistinct("doc_id").alias("docs"), F.sum("tables").alias("tables"), F.sum("text_runs").alias("text_runs"), F.max("units").alias("largest"))


def page_hotspots(spark, sf_dir):
    score = (F.col("tables") + F.col("links")) * 1000 + F.col("tables") * 100 + F.col("tall") * 18 + F.when((F.col("text_runs") == 0) & (F.col("tables") > 0), 75.0).otherwise(F.least(F.col("text_runs"), F.lit(400)) / 4)
    scored = _diagnosed(spark, sf_dir).withColumn("score", score.cast("double"))
    return reports.top_by(scored, ["doc_id"], [F.desc("score"), F.asc("text_runs"), F.asc("page")], 5).select("doc_id", "page", "score", "rank")


def page_budgets(spark, sf_dir):
    content = F.col("n_chars") * 40
    return table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(200), F.greatest(F.lit(16), units.rounded(content / 1500))).cast("long").alias("budget"), F.least(F.lit(200), F.greatest(F.lit(16), units.rounded(content / 2250))).cast("long").alias("budget_xml"))


def layout_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_quantity") * 40).cast("long").alias("height"))
    return flow.place_blocks(rows, "l_orderkey", "l_linenumber", "height", 1000)


def layout_boxes(spark, sf_dir):
    """A box for each page that a line item is on, on pages of 1100 with margins of 50 and a content width of 800."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_quantity") * 40).cast("long").alias("height"), (F.col("l_quantity") * 20).cast("long").alias("width"))
    boxes = flow.layout_boxes(rows, "l_orderkey", "l_linenumber", "height", 1100, top=50, bottom=50, least=12, carry=("width",))
    return boxes.withColumn("width", F.greatest(F.lit(1), F.least(F.lit(800), F.col("width"))))


def split_order_tables(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.ceil(F.col("l_quantity") / 10).alias("weight"))
    return flow.split_rows(rows, "l_orderkey", "l_linenumber", "weight", BUDGET).select("l_orderkey", "chunk", "position", "l_linenumber", "repeated")


def safe_breaks(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (1 + F.col("l_quantity").cast("long") % 3).alias("span"))
    return flow.safe_breaks(cells, "l_orderkey", "l_linenumber", "span")


def _doc_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 2000))).alias("page"))


def header_scope(spark, sf_dir):
    return flow.on_pages(_doc_pages(spark, sf_dir), AREAS).select("doc_id", "page", "area")


def border_priority(spark, sf_dir):
    found = flow.on_pages(_doc_pages(spark, sf_dir), [("b0", "BOTH"), ("b1", "EVEN"), ("b2", "ODD"), ("b3", "FIRST")])
    return flow.first_by_priority(found, ["doc_id", "page"], {"FIRST": 0, "FIRST_PAGE": 1, "ODD": 2, "EVEN": 3, "BOTH": 4}).select("doc_id", "page", "area")


def page_numbers(spark, sf_dir):
    n = F.col("page") + 1 + F.col("doc_id") % 5
    return _doc_pages(spark, sf_dir).select("doc_id", "page", F.concat(F.lit("- "), n.cast("string"), F.lit(" -")).alias("label"))


def long_row_fragments(spark, sf_dir):
    pages = F.least(F.lit(12), F.ceil(F.col("n_chars") / 4000)).cast("long")
    docs = table(spark, sf_dir, "documents").where("n_chars >= 8000").select("doc_id", "n_chars", pages.alias("fragments"))
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fragments") - 1)).alias("fragment"), "fragments", F.ceil(F.col("n_chars") / F.col("fragments")).cast("long").alias("height"))


def spread_widths(spark, sf_dir):
    """Proportional whole-number split of 1000 over an order's quantities, the remainder to the last."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    w = W.partitionBy("l_orderkey")
    part = F.floor(F.lit(1000) * F.col("l_quantity") / F.sum("l_quantity").over(w)).cast("long")
    rows = rows.withColumn("part", part).withColumn("_rest", 1000 - F.sum("part").over(w)).withColumn("_last", F.max("l_linenumber").over(w))
    return rows.select("l_orderkey", "l_linenumber", (F.col("part") + F.when(F.col("l_linenumber") == F.col("_last"), F.col("_rest")).otherwise(0)).alias("width"))


QUERIES = {f.__name__: f for f in (doc_lines, clean_blank_runs, line_weights, paginate_docs, page_diagnostics, doc_rollup, page_hotspots, page_budgets, layout_orders, layout_boxes, split_order_tables, safe_breaks, header_scope, border_priority, page_numbers, long_row_fragments, spread_widths)}

_LINES = r"""lines AS (SELECT doc_id, unnest(string_split(txt, chr(10))) AS line, unnest(range(len(string_split(txt, chr(10))))) AS line_no
    FROM (SELECT doc_id, regexp_replace(text, '\r\n|\r|\x02', chr(10), 'g') AS txt FROM documents))"""
_WEIGHTS = f"""{_LINES},
weighted AS (SELECT doc_id, line_no, line, length(line) + length(regexp_replace(line, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS units FROM lines),
weights AS (SELECT *, least(30, greatest(1, ceil(units / 120.0)))::INT AS weight FROM weighted)"""


def _greedy(source: str, key: str, order: str, budget: int) -> str:
    """Recursive fold over source(key, order, w)."""
    return f"""ordered AS (SELECT {key}, {order}, w, row_number() OVER (PARTITION BY {key} ORDER BY {order}, w) AS n FROM {source}),
fold AS (SELECT {key}, {order}, n, 0::BIGINT AS page, w AS used FROM ordered WHERE n = 1
    UNION ALL SELECT o.{key}, o.{order}, o.n, CASE WHEN f.used > 0 AND f.used + o.w > {budget} THEN f.page + 1 ELSE f.page END,
        CASE WHEN f.used > 0 AND f.used + o.w > {budget} THEN o.w ELSE f.used + o.w END
    FROM fold f JOIN ordered o ON o.{key} = f.{key} AND o.n = f.n + 1)"""


_PAGES = f"""WITH RECURSIVE {_WEIGHTS}, src AS (SELECT doc_id, line_no, greatest(1, weight)::BIGINT AS w FROM weights), {_greedy("src", "doc_id", "line_no", BUDGET)}"""
_DIAG = f"""{_PAGES}, diag AS (SELECT doc_id, page, count(*) AS blocks, count(*) FILTER (contains(line, '|')) AS tables, count(*) FILTER (contains(line, 'http')) AS links,
    count(*) FILTER (trim(line) <> '') AS text_runs, count(*) FILTER (weight >= 4) AS tall, sum(units)::BIGINT AS units
    FROM weights JOIN fold USING (doc_id, line_no) GROUP BY doc_id, page)"""
_DOC_PAGES = "doc_pages AS (SELECT doc_id, unnest(range(n_chars // 2000 + 1)) AS page FROM documents)"

_LAYOUT = """ordered AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (l_quantity * 40)::BIGINT AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS n FROM lineitem),
        fold AS (SELECT l_orderkey, l_linenumber, n, 0::BIGINT AS page, 0::BIGINT AS y, greatest(1, (h + 999) // 1000) AS fragments,
            greatest(1, (h + 999) // 1000) - 1 AS end_page, CASE WHEN h > 1000 THEN h - ((h + 999) // 1000 - 1) * 1000 ELSE h END AS end_y FROM ordered WHERE n = 1
            UNION ALL SELECT o.l_orderkey, o.l_linenumber, o.n, CASE WHEN f.end_y > 0 AND f.end_y + o.h > 1000 THEN f.end_page + 1 ELSE f.end_page END,
                CASE WHEN f.end_y > 0 AND f.end_y + o.h > 1000 THEN 0 ELSE f.end_y END, greatest(1, (o.h + 999) // 1000),
                CASE WHEN f.end_y > 0 AND f.end_y + o.h > 1000 THEN f.end_page + 1 ELSE f.end_page END + greatest(1, (o.h + 999) // 1000) - 1,
                CASE WHEN o.h > 1000 THEN o.h - ((o.h + 999) // 1000 - 1) * 1000 WHEN f.end_y > 0 AND f.end_y + o.h > 1000 THEN o.h ELSE f.end_y + o.h END
            FROM fold f JOIN ordered o ON o.l_orderkey = f.l_orderkey AND o.n = f.n + 1)"""

ORACLES = {
    "doc_lines": f"WITH {_LINES} SELECT doc_id, line_no, line FROM lines",
    "clean_blank_runs": """WITH lines AS (SELECT doc_id, unnest(string_split(txt, chr(10))) AS line, unnest(range(len(string_split(txt, chr(10))))) AS line_no
        FROM (SELECT doc_id, replace(text, '. ', '.' || repeat(chr(10), 4)) AS txt FROM documents)),
        islands AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM lines),
        ranked AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, island ORDER BY line_no) AS r FROM islands)
        SELECT doc_id, line_no, line FROM ranked WHERE trim(line) <> '' OR r <= 2""",
    "line_weights": f"WITH {_WEIGHTS} SELECT doc_id, line_no, units, weight FROM weights",
    "paginate_docs": f"{_PAGES} SELECT doc_id, line_no, page FROM fold",
    "page_diagnostics": f"{_DIAG} SELECT * FROM diag",
    "doc_rollup": f"{_DIAG} SELECT lang, source, count(*) AS pages, count(DISTINCT doc_id) AS docs, sum(tables) AS tables, sum(text_runs) AS text_runs, max(units) AS largest FROM diag JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)",
    "page_hotspots": f"""{_DIAG}, scored AS (SELECT *, ((tables + links) * 1000 + tables * 100 + tall * 18 + CASE WHEN text_runs = 0 AND tables > 0 THEN 75.0 ELSE least(text_runs, 400) / 4.0 END)::DOUBLE AS score FROM diag)
        SELECT doc_id, page, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, text_runs, page) AS rank FROM scored QUALIFY rank <= 5""",
    "page_budgets": "SELECT doc_id, least(200, greatest(16, floor(n_chars * 40 / 1500.0 + 0.5)))::BIGINT AS budget, least(200, greatest(16, floor(n_chars * 40 / 2250.0 + 0.5)))::BIGINT AS budget_xml FROM documents",
    "layout_boxes": f"""WITH RECURSIVE {_LAYOUT}, f AS (SELECT l_orderkey, l_linenumber, page, y, fragments, unnest(range(fragments)) AS fragment, h, width FROM fold JOIN (SELECT l_orderkey, n, h, greatest(1, least(800, h // 2)) AS width FROM ordered) USING (l_orderkey, n))
        SELECT l_orderkey, l_linenumber, page + fragment AS page, CASE WHEN fragment = 0 THEN y ELSE 0 END + 50 AS y, fragment, fragments, fragment * 1000 AS source_start, least(1000, h - fragment * 1000) AS visible_height, width FROM f""",
    "layout_orders": f"""WITH RECURSIVE {_LAYOUT}
        SELECT l_orderkey, l_linenumber, page, y, fragments FROM fold""",
    "split_order_tables": f"""WITH RECURSIVE src AS (SELECT l_orderkey, l_linenumber, greatest(1, ceil(l_quantity / 10))::BIGINT AS w FROM lineitem), {_greedy("src", "l_orderkey", "l_linenumber", BUDGET)},
        every AS (SELECT l_orderkey, page AS chunk, l_linenumber::BIGINT AS l_linenumber, 0 AS repeated FROM fold
            UNION ALL SELECT c.l_orderkey, c.page, h.first_line, 1 FROM (SELECT DISTINCT l_orderkey, page FROM fold WHERE page > 0) c JOIN (SELECT l_orderkey, min(l_linenumber)::BIGINT AS first_line FROM lineitem GROUP BY 1) h USING (l_orderkey))
        SELECT l_orderkey, chunk, row_number() OVER (PARTITION BY l_orderkey, chunk ORDER BY repeated DESC, l_linenumber) - 1 AS position, l_linenumber, repeated FROM every""",
    "safe_breaks": """WITH c AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, 1 + l_quantity::BIGINT % 3 AS span FROM lineitem)
        SELECT DISTINCT l_orderkey, l_linenumber FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber <= a.l_linenumber AND b.l_linenumber + b.span - 1 > a.l_linenumber)""",
    "header_scope": f"""WITH {_DOC_PAGES} SELECT doc_id, page, area FROM doc_pages, (VALUES ('head', 'BOTH'), ('left', 'EVEN'), ('right', 'ODD'), ('title', 'FIRST')) a(area, scope)
        WHERE CASE scope WHEN 'EVEN' THEN page % 2 = 1 WHEN 'ODD' THEN page % 2 = 0 WHEN 'FIRST' THEN page = 0 ELSE true END""",
    "border_priority": f"WITH {_DOC_PAGES} SELECT doc_id, page, CASE WHEN page = 0 THEN 'b3' WHEN page % 2 = 0 THEN 'b2' ELSE 'b1' END AS area FROM doc_pages",
    "page_numbers": f"WITH {_DOC_PAGES} SELECT doc_id, page, '- ' || (page + 1 + doc_id % 5) || ' -' AS label FROM doc_pages",
    "long_row_fragments": """WITH d AS (SELECT doc_id, n_chars, least(12, ceil(n_chars / 4000.0))::BIGINT AS fragments FROM documents WHERE n_chars >= 8000)
        SELECT doc_id, unnest(range(fragments)) AS fragment, fragments, ceil(n_chars / fragments::DOUBLE)::BIGINT AS height FROM d""",
    "spread_widths": """WITH p AS (SELECT l_orderkey, l_linenumber, floor(1000 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey))::BIGINT AS part FROM lineitem)
        SELECT l_orderkey, l_linenumber, part + CASE WHEN l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) THEN (1000 - sum(part) OVER (PARTITION BY l_orderkey))::BIGINT ELSE 0 END AS width FROM p""",
}
