"""Rules of verification reports, risk scores of pages, weights, table chunks and list markers, with orders as documents and their lines as pages, rows and paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import codes, units
from paperloom.functions import text as t
from paperloom.operators import flow, reports
from paperloom.plans.pages import _WEIGHTS, _weighted
from paperloom.sources.tables import table

#: Signals of a page's layout, with their labels in order of display and their weights.
SIGNALS = {
    "floating_tables": ("부동표", 220),
    "floating_pictures": ("부동그림", 180),
    "repeat_header_tables": ("반복머리행", 140),
    "page_break_tables": ("셀나눔", 160),
    "overlap_allowed": ("겹침허용", 180),
    "keep_with_anchor": ("anchor고정", 70),
    "page_anchored": ("쪽기준", 110),
    "column_anchored": ("단기준", 80),
    "paragraph_anchored": ("문단기준", 0),
    "merged_cells": ("병합셀", 3),
    "tall_cells": ("큰셀", 18),
    "captioned_pictures": ("캡션", 0),
    "cropped_pictures": ("자르기", 50),
    "rotated_pictures": ("회전", 30),
    "flipped_pictures": ("반전", 30),
    "wrapped_controls": ("본문배치", 0),
}
OBJECTS = ["tables", "pictures", "equations", "charts", "forms", "shapes", "oles", "videos"]


def _pages(spark, sf_dir):
    """Three lines of an order a page; what a line counts for goes by its part and supplier."""
    lines = table(spark, sf_dir, "lineitem").withColumn("page", F.floor((F.col("l_linenumber") - 1) / 3))
    signals = [F.count_if(F.col("l_partkey") % len(SIGNALS) == i).alias(n) for i, n in enumerate(SIGNALS)]
    objects = [F.count_if(F.col("l_suppkey") % len(OBJECTS) == i).alias(n) for i, n in enumerate(OBJECTS)]
    return lines.groupBy("l_orderkey", "page").agg(F.count_if(F.col("l_quantity") > 10).alias("controls"), (F.count_if(F.col("l_quantity") <= 40) * 90).alias("text_runs"), *objects, *signals)


def risk_hotspots(spark, sf_dir):
    """The five pages of each document that are hardest to lay out, with what they hold."""
    risk = sum((F.col(n) * weight for n, (_, weight) in SIGNALS.items() if weight), F.lit(0))
    text = F.when((F.col("text_runs") == 0) & (F.col("controls") > 0), 75.0).otherwise(F.least(F.col("text_runs"), F.lit(400)) / 4)
    score = F.col("controls") * 1000 + sum(map(F.col, OBJECTS), F.lit(0)) * 100 + risk + text
    labels = F.concat_ws(", ", codes.labelled({label: F.col(n) for n, (label, _) in SIGNALS.items()}))
    scored = _pages(spark, sf_dir).withColumn("score", score.cast("double")).withColumn("labels", labels)
    return reports.top_by(scored, ["l_orderkey"], [F.desc("score"), F.asc("text_runs"), F.asc("page")], 5).select("l_orderkey", "page", "score", "labels", "rank")


def _reports(spark, sf_dir):
    """A verification report of each order; what is known of it goes by its key and its lines."""
    key = F.col("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_linestatus") == "O").alias("o"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").fillna(0, ["n", "r", "o"])
    return rows.select(
        "o_orderkey",
        (key % 23 == 0).alias("fatal"),
        F.col("n").alias("pages"),
        F.when(key % 4 == 1, F.col("n") + F.col("r") % 2).when(key % 4 > 1, F.col("n")).alias("diagnostic_pages"),
        F.col("r").alias("sections"),
        F.col("n").alias("controls"),
        (F.col("n") + F.when(key % 11 == 0, 1).otherwise(0)).alias("controls_of_pages"),
        (F.col("n") + F.when(key % 9 == 0, 1).otherwise(0)).alias("dom_pages"),
        (F.col("n") - key % 3).alias("thumbnails"),
        F.when(key % 5 == 0, F.col("n") + F.col("o") % 2).alias("expected_pages"),
        F.when(key % 6 == 0, F.col("n") + F.col("r") % 2).alias("visual_pages"),
        (key % 8 != 0).alias("walked"),
        F.when(key % 7 != 0, key % 5).alias("geometry_off"),
        F.when(key % 13 == 0, 2).otherwise(0).alias("console_errors"),
        (key % 10 == 0).alias("keywords_missing"),
        (key % 17 != 0).alias("screenshot"),
        F.when(key % 19 == 0, 1).otherwise(0).alias("unresolved_fonts"),
    )


def shown_issues(spark, sf_dir):
    return reports.shown_issues(_reports(spark, sf_dir)).select("o_orderkey", F.posexplode("issues").alias("n", "issue"))


def guard_failures(spark, sf_dir):
    return reports.guard_failures(reports.shown_issues(_reports(spark, sf_dir))).select("o_orderkey", F.posexplode("failures").alias("n", "failure"))


def page_count_status(spark, sf_dir):
    return reports.page_states(_reports(spark, sf_dir)).select("o_orderkey", "state", F.concat_ws(", ", "count_issues").alias("issues"))


def _keys(name, file, path):
    """Keys of a document, composed and lower-cased: its id, its file's name, the name in its path, the name without extension."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    return F.array(*[t.lookup_key(k) for k in (name, file, base(path), F.regexp_replace(base(file), r"(?<=.)\.[^.]*$", ""))])


def audit_lookup(spark, sf_dir):
    """The supplier's audit that each part's report meets by the first of its keys that any audit has."""
    p, s = F.col("p_partkey").cast("string"), F.col("s_suppkey")
    parts, audits = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    wanted = _keys(F.concat(F.lit("doc-"), p), F.concat("p_brand", F.lit("_"), F.col("p_size").cast("string"), F.lit(".hwp")), F.concat(F.lit("/in/"), "p_brand", F.lit("/File"), F.col("p_size").cast("string"), F.lit(".hwpx")))
    brand = F.concat(F.lit("BRAND#"), (s % 5 + 1).cast("string"), (s % 3 + 1).cast("string"))
    held = _keys(F.concat(F.lit("DOC-"), (s * 7).cast("string")), F.concat(brand, F.lit("_"), (s % 50).cast("string"), F.lit(".hwp")), F.concat(F.lit("/out/file"), (s % 40).cast("string"), F.lit(".HWPX")))
    return reports.first_key_match(parts, "p_partkey", wanted, audits, "s_suppkey", held)


def page_pairs(spark, sf_dir):
    """Captured pages of each user beside the page rendered last under the same number."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 7).alias("page"))
    rendered = events.where("event_id % 3 = 0").groupBy("user_id", "page").agg(F.max("event_id").alias("rendered"))
    return events.where("event_id % 3 <> 0").join(rendered, ["user_id", "page"], "left").select("event_id", "user_id", "page", "rendered")


def _blocks(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["table", "image", "shape", "textbox", "equation", "ole", "paragraph"]))
    kind = F.element_at(kinds, (F.col("l_partkey") % 7).cast("int") + 1)
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), kind.alias("kind"), (F.col("l_returnflag") == "A").alias("inline"), (F.col("l_quantity").cast("long") % 40 * 450).alias("height"), (F.col("l_linestatus") == "O").alias("xml"), (F.col("l_suppkey") % 4).alias("rows"))


def block_weights(spark, sf_dir):
    row = units.row_weight(F.when(F.col("xml"), F.col("rows")).otherwise(F.col("height")), F.col("height"), F.col("xml"))
    weighed = _blocks(spark, sf_dir).withColumn("row_weight", row)
    return weighed.select("l_orderkey", "l_linenumber", "kind", "row_weight", units.block_weight(F.col("kind"), F.col("inline"), F.col("height"), F.col("xml"), F.col("row_weight") * F.col("rows")).alias("weight"))


def cell_weights(spark, sf_dir):
    """Conversations as table rows, their turns as cells: the heaviest cell with text says what a row takes."""
    turns = table(spark, sf_dir, "conversations")
    cell = F.when(F.trim("text") != "", units.cell_weight(F.col("text"), F.col("turn") * 900))
    return turns.groupBy("conv_id").agg(F.coalesce(F.max(cell), F.lit(1)).cast("long").alias("weight"))


def paragraph_fragments(spark, sf_dir):
    """Lines of documents over as many fragments as pages of 4000 characters, 12 at most."""
    wanted = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(12), F.ceil(F.col("n_chars") / 4000)).alias("wanted"))
    return flow.fragments(_weighted(spark, sf_dir).join(wanted, "doc_id"), "doc_id", "line_no", "weight", "wanted")


def safe_table_chunks(spark, sf_dir):
    """Orders as tables in chunks of 6, with and without the strict rule, the first row repeated."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.ceil(F.col("l_quantity") / 12).alias("weight"), (1 + F.col("l_partkey") % 3).alias("span"))
    chunks = [flow.table_chunks(rows, "l_orderkey", "l_linenumber", "weight", "span", 6, strict, headers=1).withColumn("strict", F.lit(strict)) for strict in (False, True)]
    return chunks[0].unionByName(chunks[1])


_FORMS = ["", "^N", "(^n)", " ^n^^ "]


def list_templates(spark, sf_dir):
    forms = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("l_suppkey") % len(_FORMS)).cast("int") + 1)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.when(F.col("l_returnflag") == "R", "bullet").otherwise(F.col("l_returnflag")).alias("kind"), F.col("l_linestatus").alias("list"), (F.col("l_partkey") % 3 + 1).alias("level"), (F.col("l_quantity").cast("long") % 2 + 1).alias("start"), forms.alias("form"))
    return flow.list_markers(rows, "l_orderkey", "l_linenumber", "kind", "list", "level", "start", "form")


QUERIES = {f.__name__: f for f in (risk_hotspots, shown_issues, guard_failures, page_count_status, audit_lookup, page_pairs, block_weights, cell_weights, paragraph_fragments, safe_table_chunks, list_templates)}

_R = """l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1),
q AS (SELECT o_orderkey, o_orderkey AS k, coalesce(n, 0) AS n, coalesce(r, 0) AS r, coalesce(o, 0) AS o FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
v AS (SELECT *, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN n + r % 2 ELSE n END AS diag, CASE WHEN k % 5 = 0 THEN n + o % 2 END AS want FROM q),
w AS (SELECT *, list_filter([CASE WHEN k % 8 = 0 THEN 'page walk failed' END, CASE WHEN k % 10 = 0 THEN 'keywords not found' END, CASE WHEN k % 13 = 0 THEN 'console errors' END, CASE WHEN k % 17 = 0 THEN 'screenshot failed' END,
    CASE WHEN diag IS NULL THEN 'no diagnostics' END, CASE WHEN diag <> n THEN 'diagnostic pages differ' END, CASE WHEN diag >= 0 AND r = 0 THEN 'no sections' END, CASE WHEN diag >= 0 AND k % 11 = 0 THEN 'control sums differ' END,
    CASE WHEN diag >= 0 AND k % 7 <> 0 AND k % 5 IN (3, 4) THEN 'page size differs' END, CASE WHEN k % 19 = 0 THEN 'unresolved fonts' END, CASE WHEN want <> n THEN 'expected pages differ' END], lambda x: x IS NOT NULL) AS issues FROM v)"""
_G = f"""{_R}, g AS (SELECT k, CASE WHEN k % 23 = 0 THEN ['not loaded'] ELSE list_filter([CASE WHEN len(issues) > 0 THEN 'has issues' END, CASE WHEN n = 0 THEN 'invalid page count' END, CASE WHEN want <> n THEN 'expected pages differ' END,
    CASE WHEN diag IS DISTINCT FROM n THEN 'diagnostic pages differ' END, CASE WHEN n > 0 AND k % 9 = 0 THEN 'dom pages differ' END, CASE WHEN n > 0 AND k % 3 BETWEEN 1 AND n - 1 THEN 'thumbnails missing' END,
    CASE WHEN k % 7 = 0 OR k % 5 > 2 THEN 'page size differs' END, CASE WHEN k % 17 = 0 THEN 'no screenshot' END], lambda x: x IS NOT NULL) END AS failures FROM w)"""
_SCORE = " + ".join([*(f"{w} * count(*) FILTER (l_partkey % 16 = {i})" for i, (_, w) in enumerate(SIGNALS.values()) if w)])
_LABELS = ", ".join(f"CASE WHEN count(*) FILTER (l_partkey % 16 = {i}) > 0 THEN '{label} ' || count(*) FILTER (l_partkey % 16 = {i}) END" for i, (label, _) in enumerate(SIGNALS.values()))

ORACLES = {
    "risk_hotspots": f"""WITH p AS (SELECT l_orderkey, (l_linenumber - 1) // 3 AS page, count(*) FILTER (l_quantity > 10) AS controls, 90 * count(*) FILTER (l_quantity <= 40) AS runs, 100 * count(*) + {_SCORE} AS risk, concat_ws(', ', {_LABELS}) AS labels FROM lineitem GROUP BY 1, 2),
        s AS (SELECT *, (controls * 1000 + risk + CASE WHEN runs = 0 AND controls > 0 THEN 75.0 ELSE least(runs, 400) / 4.0 END)::DOUBLE AS score FROM p)
        SELECT l_orderkey, page, score, labels, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, runs, page) AS rank FROM s QUALIFY rank <= 5""",
    "shown_issues": f"WITH {_R} SELECT o_orderkey, unnest(range(len(issues))) AS n, unnest(issues) AS issue FROM w",
    "guard_failures": f"WITH {_G} SELECT k AS o_orderkey, unnest(range(len(failures))) AS n, unnest(failures) AS failure FROM g",
    "page_count_status": f"""WITH {_R}, c AS (SELECT k, n = 0 AS p0, n > 0 AND diag <> n AS p1a, n > 0 AND diag IS NULL AS p2a, n > 0 AND k % 9 = 0 AS p1b, n > 0 AND want <> n AS p1c, n > 0 AND k % 6 = 0 AND r % 2 = 1 AS p1d, n > 0 AND k % 3 BETWEEN 1 AND n - 1 AS p2b, k % 8 = 0 AS p2c FROM w)
        SELECT k AS o_orderkey, CASE WHEN p0 OR coalesce(p1a, false) OR p1b OR coalesce(p1c, false) OR p1d THEN 'fail' WHEN p2a OR p2b OR p2c THEN 'warn' ELSE 'ok' END AS state, concat_ws(', ', CASE WHEN p0 THEN 'P0 invalid' END, CASE WHEN p1a THEN 'P1 diagnostics' END, CASE WHEN p2a THEN 'P2 no diagnostics' END,
            CASE WHEN p1b THEN 'P1 dom' END, CASE WHEN p1c THEN 'P1 baseline' END, CASE WHEN p1d THEN 'P1 visual' END, CASE WHEN p2b THEN 'P2 thumbnails' END, CASE WHEN p2c THEN 'P2 walk' END) AS issues FROM c""",
    "audit_lookup": """WITH a AS (SELECT s_suppkey, 'brand#' || (s_suppkey % 5 + 1) || (s_suppkey % 3 + 1) || '_' || (s_suppkey % 50) AS stem FROM supplier),
        i AS (SELECT s_suppkey, 'doc-' || (s_suppkey * 7) AS key FROM a UNION ALL SELECT s_suppkey, stem || '.hwp' FROM a UNION ALL SELECT s_suppkey, 'file' || (s_suppkey % 40) || '.hwpx' FROM a UNION ALL SELECT s_suppkey, stem FROM a),
        p AS (SELECT p_partkey, lower(p_brand) || '_' || p_size AS stem, p_size FROM part),
        k AS (SELECT p_partkey, 0 AS n, 'doc-' || p_partkey AS key FROM p UNION ALL SELECT p_partkey, 1, stem || '.hwp' FROM p UNION ALL SELECT p_partkey, 2, 'file' || p_size || '.hwpx' FROM p UNION ALL SELECT p_partkey, 3, stem FROM p),
        f AS (SELECT p_partkey, n, min(s_suppkey) AS s_suppkey FROM k JOIN i USING (key) GROUP BY 1, 2), b AS (SELECT p_partkey, arg_min(s_suppkey, n) AS s_suppkey FROM f GROUP BY 1)
        SELECT p_partkey, s_suppkey FROM part LEFT JOIN b USING (p_partkey)""",
    "page_pairs": "SELECT a.event_id, a.user_id, a.event_id % 7 AS page, max(b.event_id) AS rendered FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_id % 7 = a.event_id % 7 AND b.event_id % 3 = 0 WHERE a.event_id % 3 <> 0 GROUP BY ALL",
    "block_weights": """WITH b AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, ['table', 'image', 'shape', 'textbox', 'equation', 'ole', 'paragraph'][l_partkey % 7 + 1] AS kind, l_returnflag = 'A' AS inline, l_quantity::BIGINT % 40 * 450 AS h, l_linestatus = 'O' AS xml, l_suppkey % 4 AS rows FROM lineitem),
        w AS (SELECT *, CASE WHEN xml THEN greatest(1, rows, least(40, floor(h / 3000.0 + 0.5))) ELSE greatest(1, least(40, floor(h / 1800.0 + 0.5))) END::BIGINT AS row_weight, CASE WHEN h = 0 THEN 1200 ELSE h END / 1000.0 AS high FROM b)
        SELECT l_orderkey, l_linenumber, kind, row_weight, CASE WHEN kind = 'table' THEN row_weight * rows WHEN kind = 'paragraph' OR inline THEN 1 WHEN kind = 'image' AND xml THEN greatest(1, least(10, floor(h / 529.0 + 0.5)))
            WHEN kind = 'image' THEN greatest(1, least(6, floor(high + 0.5))) WHEN kind IN ('shape', 'textbox') THEN greatest(1, least(8, floor(high + 0.5))) ELSE 2 END::BIGINT AS weight FROM w""",
    "cell_weights": r"""WITH c AS (SELECT conv_id, turn, list_filter(string_split_regex(trim(text), '\n+'), lambda x: x <> '') AS ls FROM conversations),
        w AS (SELECT conv_id, CASE WHEN len(ls) > 0 THEN greatest(CASE WHEN turn > 0 THEN greatest(1, least(20, floor(turn * 900 / 420.0 + 0.5))) ELSE 0 END, least(20, greatest(len(ls), ceil(list_sum(list_transform(ls, lambda x: length(x) + length(regexp_replace(x, '[^\x{10000}-\x{10FFFF}]', '', 'g')))) / 44.0)))) END AS weight FROM c)
        SELECT conv_id, coalesce(max(weight), 1)::BIGINT AS weight FROM w GROUP BY 1""",
    "paragraph_fragments": f"""WITH RECURSIVE {_WEIGHTS}, o AS (SELECT doc_id, line_no, weight AS w, greatest(1, least(12, ceil(n_chars / 4000.0))) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i, count(*) OVER (PARTITION BY doc_id) AS m, sum(weight) OVER (PARTITION BY doc_id) AS total FROM weights JOIN documents USING (doc_id)),
        f AS (SELECT doc_id, line_no, i, 0::BIGINT AS fragment, w::BIGINT AS used FROM o WHERE i = 1
            UNION ALL SELECT o.doc_id, o.line_no, o.i, CASE WHEN f.fragment < k - 1 AND f.used + w > ceil(total / k) AND m - o.i + 1 >= k - f.fragment THEN f.fragment + 1 ELSE f.fragment END,
                CASE WHEN f.fragment < k - 1 AND f.used + w > ceil(total / k) AND m - o.i + 1 >= k - f.fragment THEN w ELSE f.used + w END FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1)
        SELECT doc_id, line_no, fragment FROM f""",
    "safe_table_chunks": """WITH RECURSIVE t AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, ceil(l_quantity / 12), 1 + l_partkey % 3) - 1 AS n, ceil(l_quantity / 12)::BIGINT AS w, 1 + l_partkey % 3 AS span FROM lineitem),
        s AS (SELECT k, n, w, max(n + span - 1) OVER (PARTITION BY k ORDER BY n) <= n AS safe, count(*) OVER (PARTITION BY k) AS m FROM t),
        d AS (SELECT a.k, a.n AS first, a.m, b.n, b.w, sum(b.w) OVER z AS cw, max(CASE WHEN b.safe THEN b.n + 1 END) OVER z AS cut, max(CASE WHEN b.safe THEN b.n + 1 END) OVER (PARTITION BY a.k, a.n ORDER BY b.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
            FROM s a JOIN s b ON b.k = a.k AND b.n >= a.n WINDOW z AS (PARTITION BY a.k, a.n ORDER BY b.n)),
        e AS (SELECT k, first, strict, coalesce(arg_min(CASE WHEN strict AND cw > 6 AND before IS NOT NULL THEN before ELSE cut END, n) FILTER (cut IS NOT NULL AND cw >= 6), any_value(m)) AS stop FROM d, (VALUES (false), (true)) y(strict) GROUP BY 1, 2, 3),
        c AS (SELECT k, strict, 0::BIGINT AS chunk, first, stop FROM e WHERE first = 0 UNION ALL SELECT e.k, e.strict, c.chunk + 1, e.first, e.stop FROM c JOIN e ON e.k = c.k AND e.strict = c.strict AND e.first = c.stop)
        SELECT k AS l_orderkey, strict, chunk, row - first + CASE WHEN chunk > 0 THEN 1 ELSE 0 END AS position, row, 0 AS repeated FROM (SELECT *, unnest(range(first, stop)) AS row FROM c) UNION ALL SELECT k, strict, chunk, 0, 0, 1 FROM c WHERE chunk > 0""",
    "list_templates": """WITH RECURSIVE o AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'bullet' ELSE l_returnflag END AS kind, l_linestatus AS list, l_partkey % 3 + 1 AS level, l_quantity::BIGINT % 2 + 1 AS start, trim(['', '^N', '(^n)', ' ^n^^ '][l_suppkey % 4 + 1]) AS said, ['', '^N', '(^n)', ' ^n^^ '][l_suppkey % 4 + 1] AS form FROM lineitem),
        i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, kind, list ORDER BY l_linenumber, level, start, form) AS i FROM o),
        f AS (SELECT i.*, list_append(list_resize([]::BIGINT[], level - 1), start) AS c FROM i WHERE i = 1
            UNION ALL SELECT i.*, list_append(list_resize(f.c, i.level - 1), greatest(i.start, coalesce(f.c[i.level], i.start - 1) + 1)) FROM f JOIN i ON i.l_orderkey = f.l_orderkey AND i.kind = f.kind AND i.list = f.list AND i.i = f.i + 1),
        j AS (SELECT *, array_to_string(list_transform(c, lambda x: coalesce(x::VARCHAR, '')), '.') AS joined FROM f)
        SELECT l_orderkey, l_linenumber, kind, list, level, start, form, CASE WHEN kind = 'bullet' THEN CASE WHEN said = '' THEN '•' ELSE said END WHEN said = '' THEN c[level] || '.' ELSE replace(replace(replace(said, '^N', joined || '.'), '^n', joined), '^^', '^') END AS marker FROM j""",
}
